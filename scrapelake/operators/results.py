"""Result shapes: flat rows and JSON documents of selector results and views."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrapelake.functions.labels import labels_of, sort_labels
from scrapelake.functions.values import display_value
from scrapelake.operators.selector import Matcher
from scrapelake.operators.views import SAMPLE_FIELDS

_WITH_NULLS = {"ignoreNullFields": "false"}


def _sample(source: str | None = None) -> Column:
    prefix = f"{source}." if source else ""
    return F.struct(
        F.col(f"{prefix}sample_timestamp_ms").alias("timestamp_ms"),
        *[F.col(f"{prefix}{name}").alias(name) for name in SAMPLE_FIELDS[1:]],
    )


def flat_result(result: DataFrame) -> DataFrame:
    """One row per sample, with the value as text."""
    return result.select(
        F.col("metric_name").alias("metric"),
        F.col("labels_key").alias("labels"),
        F.col("sample_timestamp_ms").alias("sample_ms"),
        F.col("collected_at_ms").alias("collected_ms"),
        "age_ms",
        display_value(F.col("value"), F.col("value_repr")).alias("value"),
    )


def nested_result(result: DataFrame) -> DataFrame:
    """One JSON document per series, its samples by time.

    A document holds every sample of its series, so a range result goes through ``limited``
    first; an instant result has one sample per series anyway.
    """
    return (
        result.groupBy("series_id")
        .agg(
            F.sort_array(F.collect_list(_sample())).alias("samples"),
            F.any_value("metric_name").alias("metric_name"),
            F.any_value("family_name").alias("family_name"),
            F.any_value("metric_type").alias("metric_type"),
            F.any_value("labels_key").alias("labels_key"),
            F.any_value("labels").alias("labels"),
        )
        .select(
            "metric_name",
            "labels_key",
            F.to_json(
                F.struct(
                    F.col("series_id").alias("id"),
                    "metric_name",
                    "family_name",
                    "metric_type",
                    sort_labels(F.col("labels")).alias("labels"),
                    "samples",
                ),
                _WITH_NULLS,
            ).alias("series_json"),
        )
    )


def selector_document(
    metric: str, matchers: Sequence[Matcher], at_ms: int, range_ms: int | None = None
) -> dict[str, object]:
    """What was asked, for the head of a JSON answer."""
    return {
        "selector": {
            "metric_name": metric,
            "range_ms": range_ms,
            "matchers": [
                {"name": m.name, "operator": m.operator, "value": m.value} for m in matchers
            ],
        },
        "at_ms": at_ms,
    }


def nested_view(view: DataFrame, array: str, bound: str) -> DataFrame:
    """One JSON document per group. ``array``/``bound`` are ``buckets``/``le`` for histograms
    and ``quantiles``/``quantile`` for summaries."""
    entries = F.transform(
        array,
        lambda e: F.struct(
            e[bound].alias(bound),
            F.struct(
                e["sample"]["sample_timestamp_ms"].alias("timestamp_ms"),
                *[e["sample"][name].alias(name) for name in SAMPLE_FIELDS[1:]],
            ).alias("sample"),
        ),
    )
    document = F.struct(
        "labels",
        "timestamp_ms",
        entries.alias(array),
        F.when(F.col("count").isNotNull(), _sample("count")).alias("count"),
        F.when(F.col("sum").isNotNull(), _sample("sum")).alias("sum"),
    )
    return view.select(
        "labels_key", "timestamp_ms", F.to_json(document, _WITH_NULLS).alias("group_json")
    )


def flat_view(view: DataFrame, array: str, bound: str) -> DataFrame:
    """One row per component of a group, in one pass over the groups."""
    name = "bucket" if bound == "le" else "quantile"

    def row(component: str, bound_text: Column, sample: Column) -> Column:
        return F.struct(
            F.lit(component).alias("component"),
            bound_text.alias("bound" if bound == "le" else "quantile"),
            display_value(sample["value"], sample["value_repr"]).alias("value"),
        )

    rows = F.concat(
        F.transform(array, lambda e: row(name, e[bound], e["sample"])),
        *[
            F.when(F.col(part).isNotNull(), F.array(row(part, F.lit(""), F.col(part)))).otherwise(
                F.filter(F.array(row(part, F.lit(""), F.col(part))), lambda r: F.lit(False))
            )
            for part in ("count", "sum")
        ],
    )
    return view.select(F.col("labels_key").alias("labels"), "timestamp_ms", F.inline(rows))


def view_document_lines(
    view: DataFrame,
    kind: str,
    metric: str,
    matchers: Sequence[Matcher],
    at_ms: int,
    range_ms: int | None = None,
) -> DataFrame:
    """A view of any size as JSON lines, in order: first what was asked, then one line a group, by labels
    and time. ``kind`` is ``histogram`` or ``summary``.

    The order is a range sort, so no task holds more than its range of groups. Written with
    ``write_lines`` it is one document in part files.
    """
    array, bound = {"histogram": ("buckets", "le"), "summary": ("quantiles", "quantile")}[kind]
    head = json.dumps({"kind": kind} | selector_document(metric, matchers, at_ms, range_ms))
    pairs = F.transform(
        F.sort_array(F.map_entries(labels_of(F.col("labels_key")))),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    groups = nested_view(view, array, bound).select(
        F.lit(1).alias("part"), pairs.alias("pairs"), F.coalesce("timestamp_ms", F.lit(-1)).alias("at"), F.col("group_json").alias("line")
    )
    first = view.sparkSession.range(1).select(
        F.lit(0).alias("part"), F.lit(None).cast(groups.schema["pairs"].dataType).alias("pairs"), F.lit(-1).cast("bigint").alias("at"), F.lit(head).alias("line")
    )
    return first.unionByName(groups).orderBy("part", "pairs", "at").select("line")


def write_lines(lines: DataFrame, folder: str) -> None:
    """Writes ordered lines as text files whose names follow the order."""
    lines.write.text(folder)
