"""Instant and range selectors over the series and samples tables."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.functions import values as V
from scrapelake.functions.labels import label
from scrapelake.schema import Limits
from scrapelake.session import materialize, scratch_folder

OPERATORS = ("=", "!=", "=~", "!~")


class SelectorError(ValueError):
    """A selector argument that no plan can be built from."""


class ResultLimitError(RuntimeError):
    """A result has more series or samples than the caller allows."""


@dataclass(frozen=True)
class Matcher:
    """A condition on one label. An absent label counts as the empty string."""

    name: str
    operator: str
    value: str

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise SelectorError(f"unknown matcher operator {self.operator!r}")

    def column(self) -> Column:
        return self.holds(label(F.col("labels"), self.name))

    def holds(self, actual: Column) -> Column:
        """Whether the matcher holds on a value of its label."""
        if self.operator == "=":
            return actual == self.value
        if self.operator == "!=":
            return actual != self.value
        matched = actual.rlike(full_match_pattern(self.value))
        return matched if self.operator == "=~" else ~matched


# What a letter escape of the pattern syntax is in a Java pattern, outside and
# inside a character class. Digits are back references or octal codes and are handled apart.
_SAME_ESCAPES = "dDsSwWbBnrtfa"
_ESCAPES = {"A": "\\A", "Z": "\\z", "v": "\\x0B"}


def _class_end(pattern: str, at: int) -> int:
    """Where the character class that opens at ``at`` closes."""
    at += 1
    if pattern[at : at + 1] == "^":
        at += 1
    if pattern[at : at + 1] == "]":
        at += 1
    while pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at


def _escape(pattern: str, at: int, in_class: bool) -> tuple[str, int]:
    """The escape at ``at`` in a Java pattern, and where it ends."""
    code = pattern[at + 1]
    if code in "xuU":
        digits = {"x": 2, "u": 4, "U": 8}[code]
        value = pattern[at + 2 : at + 2 + digits]
        return f"\\x{{{value}}}", at + 2 + digits
    if code.isdigit():
        number = re.match(r"\d{1,3}", pattern[at + 1 :])[0]
        octal = code == "0" or in_class or re.fullmatch("[0-3][0-7]{2}", number)
        if octal:
            number = re.match("[0-7]{1,3}", number)[0]
            return f"\\x{{{int(number, 8):x}}}", at + 1 + len(number)
        number = number[:2]
        return f"(?:\\{number})", at + 1 + len(number)
    if in_class and code == "b":
        return "\\x08", at + 2
    if code == "N":
        raise SelectorError("named characters have no equal")
    if code in _SAME_ESCAPES:
        return f"\\{code}", at + 2
    return _ESCAPES.get(code, re.escape(code) if not code.isalnum() else f"\\{code}"), at + 2


def _java_class(body: str) -> str:
    """The inside of a character class. ``[``, ``&`` and ``^`` mean nothing special there."""
    out, at = [], 0
    if body[:1] == "^":
        out, at = ["^"], 1
    while at < len(body):
        if body[at] == "\\":
            text, at = _escape(body, at, True)
            out.append(text)
        else:
            out.append(f"\\{body[at]}" if body[at] in "[]&^~|" else body[at])
            at += 1
    return "".join(out)


def _java_pattern(pattern: str) -> str:
    """A pattern in Java's syntax, by one walk that knows escapes, classes and groups. Named
    groups become numbered ones."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        numbers = re.compile(pattern).groupindex
    out, at = [], 0
    while at < len(pattern):
        rest = pattern[at:]
        if rest[0] == "\\":
            text, at = _escape(pattern, at, False)
            out.append(text)
        elif rest[0] == "[":
            end = _class_end(pattern, at)
            out.append(f"[{_java_class(pattern[at + 1 : end])}]")
            at = end + 1
        elif named := re.match(r"\(\?P<\w+>", rest):
            out.append("(")
            at += len(named[0])
        elif named := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"(?:\\{numbers[named[1]]})")
            at += len(named[0])
        elif comment := re.match(r"\(\?#[^)]*\)", rest):
            at += len(comment[0])
        elif re.match(r"\(\?\(|\(\?[aLux-]*[aLux][a-zA-Z-]*[:)]", rest):
            raise SelectorError(f"no equal for {rest[:8]!r}")
        elif rest[0] == "{" and not re.match(r"\{\d*(,\d*)?\}", rest) or rest.startswith(("{}", "{,}")):
            out.append("\\{")
            at += 1
        elif low := re.match(r"\{,(\d+)\}", rest):
            out.append(f"{{0,{low[1]}}}")
            at += len(low[0])
        elif rest[0] == "}" and not re.search(r"\{\d+(,\d*)?$|\{0,\d+$", "".join(out)):
            out.append("\\}")
            at += 1
        else:
            out.append(rest[0])
            at += 1
    return "".join(out)


def full_match_pattern(pattern: str) -> str:
    """A user pattern as a Java pattern that must match the whole value.

    The flags make ``.``, ``$`` and the classes behave as users of the pattern syntax expect
    (only ``\\n`` ends a line, Unicode classes). What has no equal is refused.
    """
    try:
        with warnings.catch_warnings():
            # Of what a later syntax may read otherwise; here it means what it does now.
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern)
    except re.error as error:
        # Fixed value: the text of the error.
        raise SelectorError(f"invalid regular expression {pattern!r}: {error}") from error
    java = rf"(?dU)\A(?:{_java_pattern(pattern)})\z"
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sql("SELECT rlike('', :pattern)", args={"pattern": java}).collect()
        except PySparkException as error:
            raise SelectorError(f"unsupported regular expression {pattern!r}") from error
    return java


def match_labels(series: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """Series on which every matcher holds."""
    conditions = [m.column() for m in matchers]
    return series.filter(reduce(Column.__and__, conditions)) if conditions else series


def _on_days(samples: DataFrame, first_ms: int | None, last_ms: int) -> DataFrame:
    """Time bounds, repeated on the partition column: Spark prunes by it but cannot derive
    it from the millisecond column."""
    ts = F.col("sample_timestamp_ms")
    bounds = [ts <= last_ms] + ([ts >= first_ms] if first_ms is not None else [])
    if "sample_date" in samples.columns:
        day = F.col("sample_date")
        bounds.append(day <= F.lit(V.date_of(last_ms)))
        if first_ms is not None:
            bounds.append(day >= F.lit(V.date_of(first_ms)))
    return samples.filter(reduce(Column.__and__, bounds))


def _write_order(samples: DataFrame) -> Column:
    """Time and, in a write log, order of the write below it, as one wide number."""
    ts = F.col("sample_timestamp_ms")
    if "order_key" not in samples.columns:
        return ts
    wide = [F.lit(str(1 << 63)), ts, F.col("order_key")]
    power, time, write = (c.cast("decimal(19,0)") for c in wide)
    return time * power + write


def latest_writes(log: DataFrame, *keys: str) -> DataFrame:
    """The last write of the latest time of every series, with its place in the write order; for each
    value of ``keys`` if there are any."""
    order = _write_order(log)
    latest = log.groupBy("series_id", "metric_name", *keys).agg(
        F.max("sample_timestamp_ms").alias("sample_timestamp_ms"),
        F.max_by(V.number(F.col("value"), F.col("value_repr")), order).alias("number"),
        *(F.max_by(c, order).alias(c) for c in ("scrape_id", "collected_at_ms", "order_key")),
    )
    number = F.col("number")
    return latest.withColumns(
        {"value": V.finite_value(number), "value_repr": V.special_text(number)}
    ).drop("number")


def latest_writes_through(log: DataFrame, place: str, places: int) -> DataFrame:
    """What ``latest_writes`` has for the rows up to a place, for each place from 0 to ``places`` - 1.

    A series is reduced to one row per place before it meets its other places, and stands for those
    up to its next row.
    """
    rows = latest_writes(log, place)
    series = W.partitionBy("series_id", "metric_name").orderBy(place)
    so_far = series.rowsBetween(W.unboundedPreceding, W.currentRow)
    order = _write_order(rows)
    latest = rows.select(
        "series_id",
        "metric_name",
        F.sequence(F.col(place), F.lead(place, 1, places).over(series) - 1).alias("places"),
        F.max("sample_timestamp_ms").over(so_far).alias("sample_timestamp_ms"),
        F.max_by(V.number(F.col("value"), F.col("value_repr")), order).over(so_far).alias("number"),
        *(F.max_by(c, order).over(so_far).alias(c) for c in ("scrape_id", "collected_at_ms", "order_key")),
    )
    number = F.col("number")
    return latest.select(
        F.explode("places").alias(place),
        "*",
        V.finite_value(number).alias("value"),
        V.special_text(number).alias("value_repr"),
    ).drop("places", "number")


def latest_samples(samples: DataFrame, at_ms: int, max_age_ms: int | None = None) -> DataFrame:
    """Latest sample of every series at or before ``at_ms``.

    ``samples`` may be a write log: where it has an ``order_key``, the last write of the latest
    time counts, by one wide number for time and write. All buffers are fixed-width, so this is a
    hash aggregate that keeps one row per series and task before the shuffle, however many
    samples a hot series has. ``max_age_ms`` only removes a series whose latest sample is older;
    that sample is then not in the time window either, so the bound can go under the aggregate,
    where it prunes partitions.
    """
    first_ms = None if max_age_ms is None else at_ms - max_age_ms
    ts = F.col("sample_timestamp_ms")
    order = _write_order(samples)
    latest = (
        _on_days(samples, first_ms, at_ms)
        .groupBy("series_id")
        .agg(
            F.max(ts).alias("sample_timestamp_ms"),
            F.max_by(V.number(F.col("value"), F.col("value_repr")), order).alias("number"),
            F.max_by("scrape_id", order).alias("scrape_id"),
            F.max_by("collected_at_ms", order).alias("collected_at_ms"),
        )
    )
    number = F.col("number")
    return latest.select(
        "series_id",
        "sample_timestamp_ms",
        V.finite_value(number).alias("value"),
        V.special_text(number).alias("value_repr"),
        "scrape_id",
        "collected_at_ms",
        (F.lit(at_ms) - F.col("sample_timestamp_ms")).alias("age_ms"),
    )


def window_samples(samples: DataFrame, at_ms: int, range_ms: int) -> DataFrame:
    """Raw samples in ``(at_ms - range_ms, at_ms]``."""
    return _on_days(samples, at_ms - range_ms + 1, at_ms).select(
        "series_id",
        "sample_timestamp_ms",
        "value",
        "value_repr",
        "scrape_id",
        "collected_at_ms",
        (F.lit(at_ms) - F.col("sample_timestamp_ms")).alias("age_ms"),
    )


def select_samples(
    samples: DataFrame, at_ms: int, range_ms: int | None, max_age_ms: int | None = None
) -> DataFrame:
    if range_ms is not None:
        if range_ms <= 0:
            raise SelectorError("range_ms must be positive")
        return window_samples(samples, at_ms, range_ms)
    if max_age_ms is not None and max_age_ms < 0:
        raise SelectorError("max_age_ms must be non-negative")
    return latest_samples(samples, at_ms, max_age_ms)


def instant(
    series: DataFrame,
    samples: DataFrame,
    metric: str,
    matchers: Sequence[Matcher] = (),
    *,
    at_ms: int,
    max_age_ms: int | None = None,
) -> DataFrame:
    """One row per series of ``metric``: its latest sample at or before ``at_ms``."""
    matched, picked = _picked(series, samples, metric, matchers)
    return _join_series(matched, select_samples(picked, at_ms, None, max_age_ms))


def range_samples(
    series: DataFrame,
    samples: DataFrame,
    metric: str,
    matchers: Sequence[Matcher] = (),
    *,
    at_ms: int,
    range_ms: int,
) -> DataFrame:
    """Every raw sample of ``metric`` in ``(at_ms - range_ms, at_ms]``."""
    matched, picked = _picked(series, samples, metric, matchers)
    return _join_series(matched, select_samples(picked, at_ms, range_ms))


def _picked(
    series: DataFrame, samples: DataFrame, metric: str, matchers: Sequence[Matcher]
) -> tuple[DataFrame, DataFrame]:
    """The matching series, and the samples of the metric that belong to them, filtered before
    anything is aggregated."""
    matched = match_labels(series.filter(F.col("metric_name") == metric), matchers)
    picked = samples.filter(F.col("metric_name") == metric)
    if matchers:
        picked = picked.join(matched.select("series_id"), "series_id", "left_semi")
    return matched, picked


def _join_series(series: DataFrame, selected: DataFrame) -> DataFrame:
    """No hint: Spark broadcasts the series below its size threshold and otherwise merges,
    splitting skewed partitions."""
    return selected.join(series, "series_id").select(
        "series_id",
        "metric_name",
        "family_name",
        "metric_type",
        "labels",
        "labels_key",
        "sample_timestamp_ms",
        "value",
        "value_repr",
        "scrape_id",
        "collected_at_ms",
        "age_ms",
    )


def result_counts(result: DataFrame) -> DataFrame:
    """Series and samples of a result, as the limits count them."""
    per_series = result.groupBy("series_id").agg(F.count("*").alias("n"))
    return per_series.agg(
        F.count("*").alias("series_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"),
    )


#: Sample limits up to this number also end the computation early.
EARLY_END = 1_000_000


def limited(
    result: DataFrame, series_limit: int | None = None, sample_limit: int | None = None
) -> DataFrame:
    """The whole result, or an error if it exceeds a limit: never a part of it.

    The result is computed once, into the shared folder, and its samples are counted as they are
    written; the returned frame reads what was stored. No more than one sample beyond the limit is
    written, so a result that is far too large ends early. If both limits are exceeded, the error names
    the series.
    """
    defaults = Limits()
    series_limit = defaults.query_series if series_limit is None else series_limit
    sample_limit = defaults.query_samples if sample_limit is None else sample_limit
    if series_limit <= 0 or sample_limit <= 0:
        raise SelectorError("query limits must be positive")
    counted = Observation()
    bounded = result.limit(sample_limit + 1) if sample_limit < EARLY_END else result
    observed = bounded.observe(counted, F.count(F.lit(1)).alias("samples"))
    stored = materialize(observed, scratch_folder(result.sparkSession, "limited"))
    samples = counted.get["samples"]
    # A result that was cut has more series than were stored.
    whole = stored if samples <= sample_limit else result
    series = whole.select("series_id").distinct().limit(series_limit + 1).count()
    # The texts of the errors.
    if series > series_limit:
        raise ResultLimitError(f"series limit ({series_limit}) exceeded")
    if samples > sample_limit:
        raise ResultLimitError(f"sample limit ({sample_limit}) exceeded")
    return stored


def in_result_order(result: DataFrame) -> DataFrame:
    return result.orderBy("metric_name", "labels_key", "sample_timestamp_ms")
