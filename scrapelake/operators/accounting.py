"""Audit rows of scrapes and runs, and the samples a scrape yields about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrapelake.functions import labels as L
from scrapelake.functions import messages as M
from scrapelake.operators.exposition import order_key
from scrapelake.schema import SCRAPES, Limits
from scrapelake.sources.tables import with_defaults

SYNTHETIC_PREFIX = "scrapelake"
TOOL_VERSION = "0.2.0"


def _collector_label(name: str) -> Column:
    entries = F.filter("collector_labels", lambda e: e["name"] == name)
    return F.try_element_at(F.transform(entries, lambda e: e["value"]), F.lit(-1))


def scrape_audit(
    manifest: DataFrame, parsed: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """One row per scrape of the manifest, with its verdict.

    The verdict rows of ``parsed`` are already one per payload, so this is a join of
    scrape-sized rows. A scrape without a payload failed on the way; an unresolved target
    (no ``resolved_ip``) never got that far.
    """
    verdicts = parsed.filter("kind = 'scrape'").select(
        "scrape_id",
        F.lit(True).alias("landed"),
        "scrape_error",
        F.col("sample_count").alias("parsed_count"),
    )
    status_ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    unlanded = F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error")).when(
        ~status_ok & F.col("http_status").isNotNull(),
        M.text(M.HTTP_STATUS, F.col("http_status"), F.col("logical_url")),
    ).otherwise(M.text(M.NO_PAYLOAD, F.col("logical_url")))
    error = F.when(F.col("landed").isNull(), unlanded).otherwise(F.col("scrape_error"))
    failed = error.isNotNull()
    unresolved = F.col("resolved_ip") == ""
    audited = with_defaults(manifest).join(verdicts, "scrape_id", "left").withColumns(
        {
            "status": F.when(failed, "failed").otherwise("success"),
            "error": F.substring(error, 1, limits.error_chars),
            # A refused status is the reason of the failure; any other failure has none.
            "http_status": F.when(~failed | ~status_ok, F.col("http_status")),
            "sample_count": F.when(failed, F.lit(0)).otherwise(F.col("parsed_count")).cast("bigint"),
            "attempts": F.when(unresolved, F.lit(0)).otherwise(F.coalesce("attempts", F.lit(1))),
            "instance": F.when(unresolved, F.col("logical_url")).otherwise(
                _collector_label("instance")
            ),
        }
    )
    return audited.select(*SCRAPES.fieldNames(), "collector_labels", "job")


def refused_scrapes(refused: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Failed audit rows of manifest rows that were not read, for their ``violation``."""
    values = {
        "instance": _collector_label("instance"),
        "status": F.lit("failed"),
        "attempts": F.coalesce("attempts", F.lit(1)),
        "sample_count": F.lit(0).cast("bigint"),
        "error": F.substring("violation", 1, limits.error_chars),
    }
    return with_defaults(refused).withColumns(values).select(*SCRAPES.fieldNames())


def stray_payloads(payloads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Failed audit rows, without a scrape id, of payloads that no manifest row names."""
    named = manifest.select("path").filter("path IS NOT NULL")
    stray = payloads.select("path").join(named, "path", "left_anti")
    known = {
        "logical_url": F.col("path"),
        "resolved_ip": F.lit(""),
        "status": F.lit("failed"),
        "sample_count": F.lit(0),
        "error": F.lit("payload has no manifest row"),
    }
    return stray.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCRAPES.fields]
    )


def synthetic_samples(audit: DataFrame, prefix: str = SYNTHETIC_PREFIX) -> DataFrame:
    """Four gauges per scrape at its finish time: up, duration, samples, attempts.

    Labels are the collector's own; an unresolved target has only its identity.
    """
    resolved = F.col("resolved_ip") != ""
    identity = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("system", "module", "job")]
    )
    own = F.map_from_entries(F.when(resolved, F.col("collector_labels")).otherwise(identity))
    success = F.col("status") == "success"
    elapsed = F.greatest(F.col("finished_at_ms") - F.col("started_at_ms"), F.lit(0)) / 1000.0
    values = {
        "up": success.cast("double"),
        "scrape_duration_seconds": F.when(resolved, elapsed).otherwise(F.lit(0.0)),
        "scrape_samples": F.col("sample_count").cast("double"),
        "scrape_attempts": F.col("attempts").cast("double"),
    }
    gauges = F.array(
        *[
            F.struct(F.lit(f"{prefix}_{name}").alias("metric_name"), value.alias("value"))
            for name, value in values.items()
        ]
    )
    labels = L.force_resolved_ip(own, F.col("resolved_ip"))
    return audit.withColumn("labels_key", L.labels_key(labels)).select(
        "system",
        "module",
        "labels_key",
        F.col("finished_at_ms").alias("sample_timestamp_ms"),
        "scrape_id",
        F.col("finished_at_ms").alias("collected_at_ms"),
        order_key(F.col("scrape_id"), F.lit(None).cast("bigint")).alias("order_key"),
        F.inline(gauges),
    ).select(
        "system",
        "module",
        L.series_id(F.col("metric_name"), F.col("labels_key")).alias("series_id"),
        "metric_name",
        F.col("metric_name").alias("family_name"),
        F.lit("gauge").alias("metric_type"),
        "labels_key",
        "sample_timestamp_ms",
        "value",
        F.lit(None).cast("string").alias("value_repr"),
        "scrape_id",
        "collected_at_ms",
        "order_key",
    )


def run_audit(
    scrapes: DataFrame, context: DataFrame | None = None, tool_version: str = TOOL_VERSION
) -> DataFrame:
    """Start, finish, counts and status of every run, and the version of this library.

    ``context`` may give ``(run_id, context MAP)``; the map is stored as JSON. A run of a
    thousand or of a billion scrapes is one partial row per task here.
    """
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    runs = scrapes.groupBy("run_id").agg(
        F.min("started_at_ms").alias("started_at_ms"),
        F.max("finished_at_ms").alias("finished_at_ms"),
        ok.alias("successful_targets"),
        bad.alias("failed_targets"),
        F.lit(tool_version).alias("tool_version"),
    )
    runs = runs.withColumn(
        "status",
        F.when(F.col("failed_targets") == 0, "success")
        .when(F.col("successful_targets") > 0, "partial")
        .otherwise("failed"),
    )
    if context is None:
        return runs.withColumn("context_json", F.lit("{}"))
    texts = context.select("run_id", L.labels_key(F.col("context")).alias("context_json"))
    return runs.join(texts, "run_id", "left").withColumn(
        "context_json", F.coalesce("context_json", F.lit("{}"))
    )


def failures(scrapes: DataFrame) -> DataFrame:
    """Failed scrapes; an unresolved target has no address."""
    return scrapes.filter("status = 'failed'").select(
        "run_id",
        "scrape_id",
        F.col("logical_url").alias("url"),
        F.nullif(F.col("resolved_ip"), F.lit("")).alias("resolved_ip"),
        "error",
    )
