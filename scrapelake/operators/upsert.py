"""Which of several writes counts: the last one for samples, the first one for series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.functions import labels as L
from scrapelake.functions import values as V
from scrapelake.schema import SERIES


def last_writes(samples: DataFrame) -> DataFrame:
    """The last write of every ``(series_id, sample_timestamp_ms)``.

    ``order_key`` is one number and every other buffer is fixed-width, so this stays a hash
    aggregate: repeated writes of a key collapse inside each task before the shuffle.
    """
    order = F.col("order_key")
    # The other two keys follow from the first two. As keys they let a filter on the metric
    # or the day pass through the aggregate down to the scan.
    keys = ["series_id", "sample_timestamp_ms", "metric_name", "sample_date"]
    current = samples.groupBy(*keys).agg(
        F.max_by(V.number(F.col("value"), F.col("value_repr")), order).alias("number"),
        F.max_by("scrape_id", order).alias("scrape_id"),
        F.max_by("collected_at_ms", order).alias("collected_at_ms"),
        F.max(order).alias("order_key"),
    )
    return current.select(
        "series_id",
        "metric_name",
        "sample_timestamp_ms",
        V.finite_value(F.col("number")).alias("value"),
        V.special_text(F.col("number")).alias("value_repr"),
        "scrape_id",
        "collected_at_ms",
        "order_key",
        "sample_date",
    )


def first_series(samples: DataFrame) -> DataFrame:
    """One row per series; family and type come from its first write.

    Samples collapse to their distinct identities in a hash aggregate, inside each task before
    the shuffle; only those few are ranked. The label map is read back from its key.
    """
    identity = ["series_id", "metric_name", "family_name", "metric_type", "labels_key"]
    first = W.partitionBy("series_id").orderBy("order_key")
    return (
        samples.groupBy(*identity)
        .agg(F.min("order_key").alias("order_key"))
        .withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .withColumn("labels", L.labels_of(F.col("labels_key")))
        .select(*SERIES.fieldNames(), "order_key")
    )


def with_identity(samples: DataFrame) -> DataFrame:
    """Adds ``labels_key`` and ``series_id`` to samples that carry their labels."""
    return samples.withColumn("labels_key", L.labels_key(F.col("labels"))).withColumn(
        "series_id", L.series_id(F.col("metric_name"), F.col("labels_key"))
    )


def resolved_series(log: DataFrame) -> DataFrame:
    """One row per series from rows of several batches; the first write gives family and type.

    Metric and label key follow from the id. As keys they let a filter on the metric pass
    through the aggregate down to the scan.
    """
    keys = ["series_id", "metric_name", "labels_key"]
    first = F.min_by(F.struct("family_name", "metric_type"), "order_key")
    return (
        log.groupBy(*keys)
        .agg(first.alias("first"))
        .select(*keys, "first.*", L.labels_of(F.col("labels_key")).alias("labels"))
        .select(*SERIES.fieldNames())
    )


def label_rows(series: DataFrame) -> DataFrame:
    """One row per label of a series."""
    return series.select("series_id", F.explode("labels").alias("name", "value"))


def value_violations(samples: DataFrame) -> DataFrame:
    """Samples the store must not take."""
    fault = V.value_fault(F.col("value"), F.col("value_repr"))
    return samples.withColumn("violation", fault).filter("violation IS NOT NULL")
