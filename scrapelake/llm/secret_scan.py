"""Secret scans by a trigram inverted index.

Each rule is a regular expression. From its syntax tree a Boolean query over lower-case trigrams is
derived that every match fulfils. Documents are indexed in segments of a few megabytes: a segment's
postings tell which of its documents hold each trigram that a query asks for. Postings are
intersected and united as the query says, and only the documents left are verified by the regular
expression. A rule without mandatory trigrams scans every document. A segment lives as long as
its rules take, since the rules are known beforehand; nothing is shuffled, whatever the corpus.

A null text is empty and has no span. Texts of any length are scanned whole. Repeated rows are
scanned one by one. An empty table gives no rows. Other columns are carried along by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_BYTES = 4 << 20
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of ``group`` in a match; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[0-9A-Za-z]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query is True (every document), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _all(queries: Sequence[Query]) -> Query:
    flat = tuple(dict.fromkeys(q for q in queries if q is not True))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(queries: Sequence[Query]) -> Query:
    flat = tuple(dict.fromkeys(queries))
    return True if True in flat or not flat else flat[0] if len(flat) == 1 else ("or", flat)


def _of_strings(strings: frozenset[str]) -> Query:
    """All trigrams of one of the strings; those outside ASCII go without."""
    cut = [[s[i : i + 3] for i in range(len(s) - 2)] for s in sorted(strings)]
    return _any([_all([t for t in c if t.isascii()]) for c in cut])


def _product(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a in left for b in right)


def _characters(items: list) -> frozenset[str] | None:
    """The lower-case characters of a class, None if they are many."""
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _sequence(nodes: Sequence) -> tuple[frozenset[str] | None, Query]:
    """The strings that a sequence can match, if they are few, and a query for it."""
    queries: list[Query] = []
    strings: frozenset[str] = frozenset([""])
    whole = True
    for op, value in nodes:
        exact: frozenset[str] | None
        query: Query = True
        if op is C.LITERAL:
            exact = frozenset([chr(value).lower()])
        elif op is C.IN:
            exact = _characters(value)
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            exact = frozenset([""])
        elif op is C.SUBPATTERN:
            exact, query = _sequence(value[3])
        elif op is C.BRANCH:
            parts = [_sequence(p) for p in value[1]]
            query = _any([q for _, q in parts])
            exact = None
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            exact, query = _sequence(inner)
            if (low, high) == (0, 1) and exact is not None:
                exact, query = exact | {""}, True
            elif (low, high) != (1, 1):
                exact, query = None, query if low else True
        else:
            exact = None
        if exact is None or len(exact) * len(strings) > _MOST_STRINGS:
            whole = False
            queries += [_of_strings(strings), query]
            strings = exact if exact is not None else frozenset([""])
        else:
            strings = _product(strings, exact)
            queries.append(query)
    queries.append(_of_strings(strings))
    return (strings if whole else None), _all(queries)


def trigram_query(pattern: str) -> Query:
    """A query that holds for the lower-cased form of every text that the pattern matches in."""
    return _sequence(list(parser.parse(pattern, re.ASCII)))[1]


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(trigrams(q) for q in query[1]))


class Scanner:
    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        named = sorted(set().union(*map(trigrams, self.queries)))
        self.names = {t: i + 1 for i, t in enumerate(named)}
        self.lookup = np.zeros(1 << 24, np.uint16)
        for t, i in self.names.items():
            a, b, c = t.encode("ascii")
            self.lookup[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """A row for each trigram (row 0 unused), a column for each document of the segment."""
        held = np.zeros((len(self.names) + 1, len(texts)), bool)
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        for at in range(0, len(data), SEGMENT_BYTES):
            part = data[at : at + SEGMENT_BYTES + 2].astype(np.uint32)
            if len(part) < 3:
                break
            found = self.lookup[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            places = np.flatnonzero(found)
            document = np.searchsorted(ends, places + at, "right")
            inside = places + at + 3 <= ends[document]
            held[found[places[inside]], document[inside]] = True
        return held

    def candidates(self, query: Query, held: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(held.shape[1], bool)
        if isinstance(query, str):
            return held[self.names[query]]
        combine = np.logical_and if query[0] == "and" else np.logical_or
        return combine.reduce([self.candidates(q, held) for q in query[1]])

    def segment(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule, end) of each document, sorted."""
        held = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern) in enumerate(zip(self.rules, self.patterns, strict=True)):
            for i in np.flatnonzero(self.candidates(self.queries[number], held)).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), number, m.end()))
        return [sorted(s) for s in spans]

    def scan(self, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= SEGMENT_BYTES:
                yield from self.segment(group)
                group, size = [], 0
        if group:
            yield from self.segment(group)


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The worker's scanner of a set of rules, kept between batches and tasks."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], base_only: bool = False) -> str:
    return ",".join(
        f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if rules[k].base or not base_only
    )


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, a count ``n_<kind>`` for each base rule, ``base_sha256`` and ``spans``."""
    base = [k for k, r in enumerate(rules) if r.base]
    names = ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            found = list(scan.scan([t or "" for t in batch["text"].to_pylist()]))
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in base]
            digest = [hashlib.sha256(joined(f, rules, True).encode()).hexdigest() for f in found]
            spans = [joined(f, rules) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string())], names
            )

    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'bigint'}" for n in names)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span, or run of spans that overlap, replaced by a mark; ``n_chars``, if
    there, follows the text."""

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = scan.scan([t or "" for t in texts])
            hidden = [t if t is None else hide(t, f) for t, f in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(hidden, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
