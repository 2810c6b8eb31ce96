"""Stored histograms and summaries, put together from their component samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrapelake.functions import labels as L
from scrapelake.functions import messages as M
from scrapelake.functions import values as V
from scrapelake.operators.selector import Matcher, match_labels, select_samples

SAMPLE_FIELDS = [
    "sample_timestamp_ms",
    "value",
    "value_repr",
    "scrape_id",
    "collected_at_ms",
    "age_ms",
]


def family_components(
    series: DataFrame,
    samples: DataFrame,
    family: str,
    metric_type: str,
    matchers: Sequence[Matcher],
    at_ms: int,
    range_ms: int | None,
) -> DataFrame:
    """Selected samples of all component series of a family.

    Each series takes its own latest sample, so an instant view may mix timestamps. The
    samples are filtered by the component names, which prunes the scan. A series of the family
    under any other name is reported if it has a sample here. Whether there are any is asked of the
    series first; in a sound store there are none, and the samples are scanned once.
    """
    names = [family] + [f"{family}_{part}" for part in ("bucket", "count", "sum")]
    matched = match_labels(
        series.filter((F.col("family_name") == family) & (F.col("metric_type") == metric_type)),
        matchers,
    ).withColumn(
        "component",
        F.when(F.col("metric_name") == family, "")
        .when(F.col("metric_name").isin(*names), F.substring("metric_name", len(family) + 2, 99))
        .otherwise("other"),
    )
    named = samples.filter(F.col("metric_name").isin(*names))
    if matchers:
        named = named.join(matched.select("series_id"), "series_id", "left_semi")
    other = matched.filter("component = 'other'")
    parts = [(named, matched.filter("component <> 'other'"))]
    if not other.isEmpty():
        parts.append((samples.join(other.select("series_id"), "series_id", "left_semi"), other))
    columns = ["metric_name", "component", "labels"]
    found = [
        select_samples(part, at_ms, range_ms).join(of, "series_id").select(*columns, *SAMPLE_FIELDS)
        for part, of in parts
    ]
    return reduce(DataFrame.unionByName, found)


def _bound_order(text: Column) -> list[Column]:
    """Sort fields of a bound: numbers by value, then other text."""
    bound = V.number_from_text(text)
    return [bound.isNull().alias("is_text"), bound.alias("bound")]


def _grouped(components: DataFrame, array: str, bound_label: str, part: str, ranged: bool) -> DataFrame:
    """One row per label set without the bound (and per timestamp for ranges).

    A group holds one sample per component series, so it grows with the number of bounds of a
    histogram, not with the data.
    """
    text = F.col("labels")[bound_label]
    sample = F.struct(*SAMPLE_FIELDS)
    component = F.col("component")
    entry = F.struct(
        (text == "+Inf").alias("is_inf") if part == "bucket" else F.lit(False).alias("is_inf"),
        *_bound_order(text),
        text.alias(bound_label),
        sample.alias("sample"),
    )
    group_labels = L.without_label(F.col("labels"), bound_label)
    time = F.col("sample_timestamp_ms") if ranged else F.lit(None).cast("bigint")
    prepared = components.select(
        L.labels_key(group_labels).alias("labels_key"),
        time.alias("timestamp_ms"),
        L.sort_labels(group_labels).alias("labels"),
        F.when((component == part) & text.isNotNull(), entry).alias("entry"),
        F.when(component == "count", F.struct(L.labels_key(F.col("labels")), sample.alias("s"))).alias("count"),
        F.when(component == "sum", F.struct(L.labels_key(F.col("labels")), sample.alias("s"))).alias("sum"),
        ((component == part) & text.isNull()).alias("no_bound"),
        F.when(~component.isin(part, "count", "sum"), F.col("metric_name")).alias("unexpected"),
    )
    return prepared.groupBy("labels_key", "timestamp_ms").agg(
        F.any_value("labels").alias("labels"),
        F.sort_array(F.collect_list("entry")).alias(array),
        F.max("count")["s"].alias("count"),
        F.max("sum")["s"].alias("sum"),
        F.max("no_bound").alias("no_bound"),
        F.min("unexpected").alias("unexpected"),
    )


def _finish(grouped: DataFrame, array: str, bound_label: str, error: Column, strict: bool) -> DataFrame:
    """``strict`` raises on the first broken group; otherwise ``error`` tells about each. The check
    is a filter, so it runs whatever columns a caller goes on to read."""
    if strict:
        broken = F.raise_error(error).cast("boolean")
        grouped = grouped.filter(F.when(error.isNotNull(), broken).otherwise(F.lit(True)))
    entries = F.transform(
        array,
        lambda e: F.struct(e[bound_label].alias(bound_label), e["sample"].alias("sample")),
    )
    return (
        grouped.withColumns({"error": error, array: entries})
        .select("labels", "labels_key", "timestamp_ms", array, "count", "sum", "error")
    )


def histogram_view(
    series: DataFrame,
    samples: DataFrame,
    family: str,
    matchers: Sequence[Matcher] = (),
    *,
    at_ms: int,
    range_ms: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Buckets by ascending bound, count and sum of every stored histogram of ``family``."""
    components = family_components(
        series, samples, family, "histogram", matchers, at_ms, range_ms
    )
    grouped = _grouped(components, "buckets", "le", "bucket", range_ms is not None)
    infinity = F.try_element_at(F.filter("buckets", lambda b: b["le"] == "+Inf"), F.lit(-1))["sample"]

    def stored(sample: Column) -> Column:
        return V.number(sample["value"], sample["value_repr"])

    error = (
        F.when(F.col("no_bound"), F.lit(M.VIEW_BUCKET_WITHOUT_LE))
        .when(
            F.col("unexpected").isNotNull(),
            M.text(M.VIEW_UNEXPECTED, "histogram", F.col("unexpected")),
        )
        .when(
            (F.size("buckets") == 0) | F.col("count").isNull() | F.col("sum").isNull(),
            F.lit(M.VIEW_INCOMPLETE_HISTOGRAM),
        )
        .when(infinity.isNull(), F.lit(M.VIEW_NO_INFINITY))
        .when(
            ~stored(infinity).eqNullSafe(stored(F.col("count"))),
            F.lit(M.VIEW_COUNT_MISMATCH),
        )
    )
    return _finish(grouped, "buckets", "le", error, strict)


def summary_view(
    series: DataFrame,
    samples: DataFrame,
    family: str,
    matchers: Sequence[Matcher] = (),
    *,
    at_ms: int,
    range_ms: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Stored quantiles in ascending order, count and sum of every summary of ``family``."""
    components = family_components(series, samples, family, "summary", matchers, at_ms, range_ms)
    grouped = _grouped(components, "quantiles", "quantile", "", range_ms is not None)
    error = (
        F.when(F.col("no_bound"), F.lit(M.VIEW_QUANTILE_MISSING))
        .when(
            F.col("unexpected").isNotNull(),
            M.text(M.VIEW_UNEXPECTED, "summary", F.col("unexpected")),
        )
        .when(
            (F.size("quantiles") == 0) | F.col("count").isNull() | F.col("sum").isNull(),
            F.lit(M.VIEW_INCOMPLETE_SUMMARY),
        )
    )
    return _finish(grouped, "quantiles", "quantile", error, strict)


def in_group_order(view: DataFrame) -> DataFrame:
    """Groups by their sorted label pairs, then by time."""
    pairs = F.transform(
        F.sort_array(F.map_entries("labels")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    return view.orderBy(pairs, F.coalesce("timestamp_ms", F.lit(-1)))
