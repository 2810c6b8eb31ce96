"""Columns over one line of exposition text. Quantifiers are possessive, so that matching
never recurses, however long a label value is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrapelake.schema import LABEL_NAME, METRIC_NAME

# The white space of the text format.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_SPACES}]"
INK = f"[^{_SPACES}]"

_LABEL_TEXT = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_LABEL = rf'{LABEL_NAME}+{WS}*+={WS}*+"{_LABEL_TEXT}"'
_LABEL_LIST = rf"{WS}*+(?:{_LABEL}(?:{WS}*+,{WS}*+{_LABEL})*+{WS}*+,?+{WS}*+)?+"
_TOKEN = r"[0-9A-Za-z.+-]++"

BLANK = rf"\A{WS}*+\z"
COMMENT = rf"\A{WS}*+#"
NAME = rf"\A{WS}*+({METRIC_NAME})"
SAMPLE = (
    rf"(?s)\A{WS}*+{METRIC_NAME}+(?:{WS}*+\{{{_LABEL_LIST}\}}{WS}*+|{WS}++)"
    rf"{_TOKEN}(?:{WS}++{_TOKEN})?+{WS}*+\z"
)
LABEL_PAIR = rf'(?s)({LABEL_NAME}+){WS}*+={WS}*+"({_LABEL_TEXT})"'
DIRECTIVE = (
    rf"(?s)\A{WS}*+#{WS}++(HELP|TYPE|UNIT)(?:{WS}++({INK}++)(?:{WS}++({INK}.*?))?)?{WS}*+\z"
)


def metric_name(line: Column) -> Column:
    """Leading metric name of a line, the empty string when it has none."""
    return F.regexp_extract(line, NAME, 1)


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, rf"\A({INK}++)", 1)


def is_sample(line: Column) -> Column:
    """Whether a line is well-formed, but for the numbers in it."""
    return line.rlike(SAMPLE)


def sample_tokens(line: Column) -> Column:
    """``[value]`` or ``[value, timestamp]`` of a well-formed line. The tokens hold no brace,
    so they follow the last one; a line without braces has them after the name."""
    tail = F.when(
        F.contains(line, F.lit("}")), F.substring_index(line, "}", -1)
    ).otherwise(F.regexp_replace(line, NAME, ""))
    return F.regexp_extract_all(tail, F.lit(f"({_TOKEN})"), F.lit(1))


def label_text(line: Column) -> Column:
    """What follows the first brace of a well-formed line; empty without labels."""
    brace = F.instr(line, "{")
    return F.when(brace > 0, F.substring(line, brace + 1, F.length(line))).otherwise("")


def _unescape(value: Column) -> Column:
    """``\\\\``, ``\\"`` and ``\\n`` are escapes; any other backslash is itself."""
    pieces = F.transform(
        F.split(value, r"\\\\"),
        lambda piece: F.replace(
            F.replace(piece, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")
        ),
    )
    return F.when(F.contains(value, F.lit("\\")), F.array_join(pieces, "\\")).otherwise(value)


def label_names(labels_text: Column) -> Column:
    return F.regexp_extract_all(labels_text, F.lit(LABEL_PAIR), F.lit(1))


def label_values(labels_text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(labels_text, F.lit(LABEL_PAIR), F.lit(2)), _unescape
    )


def timestamp_ms(number: Column) -> Column:
    """Source time in ms, NULL when the number is not finite or does not fit a BIGINT."""
    rounded = F.rint(number / 1000.0 * 1000.0)
    return F.when(F.abs(rounded) < float(1 << 63), rounded.cast("bigint"))
