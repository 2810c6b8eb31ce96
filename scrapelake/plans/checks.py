"""Every operator as a query over the driver's tables; ``oracle`` holds the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrapelake.functions import labels as L
from scrapelake.functions.values import date_of
from scrapelake.operators import accounting, exposition, results, selector, upsert, views
from scrapelake.operators.activity import active_days, day_spans
from scrapelake.operators.selector import Matcher
from scrapelake.plans import fixtures as fx
from scrapelake.plans import indexes
from scrapelake.plans.ingest import ingest_batch, ingest_unlanded, scraped_samples
from scrapelake.plans.lake import Lake
from scrapelake.plans.upkeep import compact, compact_days, prune, split_by_cutoff, sweep, without_orphans
from scrapelake.schema import DAY_MS, Limits
from scrapelake.session import discard, materialize, scratch_folder
from scrapelake.sources import tables
from scrapelake.sources.payloads import decoded, read_payloads, stream_packed, stream_payloads
from scrapelake.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

SIX_HOURS_MS = 6 * 3_600_000
MAX_AGE_MS = 2 * DAY_MS
CUTOFF_MS = 1_706_400_000_000 + 45_000_000
FAULT_LIMITS = Limits(samples=300)
SELECTED = [
    "metric_name",
    "labels_key",
    "sample_timestamp_ms",
    "value",
    "value_repr",
    "scrape_id",
    "age_ms",
]
STORED = ["series_id", "sample_timestamp_ms", "value", "value_repr", "scrape_id", "collected_at_ms"]


def _gauges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Series and samples as a store would hold them: the last write of each key."""
    log = fx.samples(spark, sf)
    return fx.series_of(log), upsert.last_writes(log)


def _instant(*matchers: Matcher, max_age_ms: int | None = None) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return selector.instant(
            *_gauges(spark, sf), "event_value", matchers, at_ms=fx.AT_MS, max_age_ms=max_age_ms
        ).select(*SELECTED)

    return query


def _range(spark: SparkSession, sf: str) -> DataFrame:
    return selector.range_samples(
        *_gauges(spark, sf), "event_value", at_ms=fx.AT_MS, range_ms=SIX_HOURS_MS
    )


def series_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.series_of(fx.samples(spark, sf)).select("series_id", "metric_name", "labels_key")


def limit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return selector.result_counts(_range(spark, sf))


def result_flat(spark: SparkSession, sf: str) -> DataFrame:
    return results.flat_result(
        selector.instant(*_gauges(spark, sf), "event_value", at_ms=fx.AT_MS)
    )


def result_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of an instant result: one sample each, at any scale."""
    return results.nested_result(
        selector.instant(*_gauges(spark, sf), "event_value", at_ms=fx.AT_MS)
    )


def nested_range(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a range result: several samples each, by time."""
    return results.nested_result(_range(spark, sf))


def _histograms(spark: SparkSession, sf: str, broken: bool = False, **kwargs: object) -> DataFrame:
    samples = fx.histogram_samples(spark, sf, broken)
    return views.histogram_view(
        fx.series_of(samples), samples, "line_quantity", at_ms=fx.HISTOGRAM_AT_MS, **kwargs
    )


def _summaries(spark: SparkSession, sf: str, broken: bool = False, **kwargs: object) -> DataFrame:
    samples = fx.summary_samples(spark, sf, broken)
    return views.summary_view(
        fx.series_of(samples), samples, "order_price", at_ms=fx.HISTOGRAM_AT_MS, **kwargs
    )


def histogram_view(spark: SparkSession, sf: str) -> DataFrame:
    return results.nested_view(_histograms(spark, sf), "buckets", "le")


def histogram_range(spark: SparkSession, sf: str) -> DataFrame:
    return results.nested_view(_histograms(spark, sf, range_ms=fx.YEAR_MS), "buckets", "le")


def histogram_matched(spark: SparkSession, sf: str) -> DataFrame:
    """A matcher on ``le`` leaves out buckets too, which makes the groups incomplete."""
    view = _histograms(spark, sf, matchers=[Matcher("le", "!=", "+Inf")], strict=False)
    return view.select("labels_key", F.size("buckets").alias("n_buckets"), "error")


def histogram_violations(spark: SparkSession, sf: str) -> DataFrame:
    view = _histograms(spark, sf, broken=True, range_ms=fx.YEAR_MS, strict=False)
    return view.select("labels_key", "timestamp_ms", "error")


def summary_view(spark: SparkSession, sf: str) -> DataFrame:
    return results.nested_view(_summaries(spark, sf), "quantiles", "quantile")


def summary_violations(spark: SparkSession, sf: str) -> DataFrame:
    view = _summaries(spark, sf, broken=True, range_ms=fx.YEAR_MS, strict=False)
    return view.select("labels_key", "timestamp_ms", "error")


def view_flat(spark: SparkSession, sf: str) -> DataFrame:
    return results.flat_view(_histograms(spark, sf, range_ms=fx.YEAR_MS), "buckets", "le")


def summary_flat(spark: SparkSession, sf: str) -> DataFrame:
    return results.flat_view(_summaries(spark, sf), "quantiles", "quantile")


def view_document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A view of several times as a document of JSON lines, written and read again."""
    lines = results.view_document_lines(
        _histograms(spark, sf, range_ms=fx.YEAR_MS), "histogram", "line_quantity", [], fx.HISTOGRAM_AT_MS, fx.YEAR_MS
    )
    folder = scratch_folder(spark, "document")
    results.write_lines(lines, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def group_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first groups of a view in its order."""
    view = views.in_group_order(_histograms(spark, sf, range_ms=fx.YEAR_MS))
    return view.limit(20).select("labels_key", "timestamp_ms")


def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.last_writes(fx.upsert_samples(spark, sf)).select(*STORED)


def series_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The same series written under several families and types."""
    order = F.col("order_key")
    rows = fx.samples(spark, sf).withColumns(
        {
            "family_name": F.concat(F.lit("family_"), order % 5),
            "metric_type": F.when(order % 2 == 0, "gauge").otherwise("untyped"),
        }
    )
    return upsert.first_series(rows).select("series_id", "family_name", "metric_type")


def _parsed(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    return exposition.parse_payloads(
        fx.payloads(spark, sf, broken),
        fx.manifest(spark, sf, broken),
        fx.catalogue(spark),
        FAULT_LIMITS,
    )


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.scrape_audit(fx.manifest(spark, sf, True), _parsed(spark, sf, True))


def parse_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return exposition.accepted_samples(_parsed(spark, sf)).select(
        "scrape_id",
        "metric_name",
        "family_name",
        "metric_type",
        "labels_key",
        "sample_timestamp_ms",
        "value",
        "value_repr",
    )


def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select(
        "scrape_id", "status", "error", "http_status", "attempts", "sample_count", "instance"
    )


def help_unit_carry(spark: SparkSession, sf: str) -> DataFrame:
    return (
        exposition.with_help(_parsed(spark, sf))
        .groupBy("scrape_id", "family_name", "help", "unit")
        .agg(F.count("*").alias("n"))
    )


def metadata_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    payloads = materialize(fx.payloads(spark, sf), scratch_folder(spark, "payloads"))
    parsed = exposition.parse_payloads(
        payloads, fx.manifest(spark, sf), fx.catalogue(spark), FAULT_LIMITS, exposition.parse_tasks(payloads)
    )
    stored = materialize(parsed.drop("labels"), scratch_folder(spark, "parsed"), "kind")
    return exposition.last_metadata(stored).select(
        "system", "module", "family_name", "metric_type", "help", "unit", "updated_at_ms"
    )


def _merge_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoint and collector labels of every event, with conflicts of several kinds."""
    event = F.col("event_id")
    optional = [
        (event % 2 == 0, "job", F.lit("exporter")),
        (event % 4 == 0, "exported_job", F.lit("old")),
        (event % 5 == 0, "resolved_ip", F.lit("9.9.9.9")),
    ]
    endpoint = F.map_entries("labels")
    for test, name, value in optional:
        entry = F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))
        endpoint = F.concat(endpoint, F.when(test, entry).otherwise(F.filter(entry, lambda e: F.lit(False))))
    collector = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")))
                for test, name, value in [
                    (F.lit(True), "cluster", "prod"),
                    (F.lit(True), "job", "api"),
                    (event % 3 == 0, "user", "collector"),
                ]
            ]
        )
    )
    return fx.events(spark, sf).select(
        "event_id",
        F.map_from_entries(endpoint).alias("endpoint"),
        collector.alias("collector"),
        F.concat(F.lit("10.0.0."), event % 250).alias("ip"),
    )


def _merge(honor: bool) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        merged = L.merge_labels(
            F.col("endpoint"), F.col("collector"), F.lit(honor), F.col("ip")
        )
        return _merge_inputs(spark, sf).select("event_id", L.labels_key(merged).alias("labels_key"))

    return query


def merged_limits(spark: SparkSession, sf: str) -> DataFrame:
    merged = L.merge_labels(F.col("endpoint"), F.col("collector"), F.lit(True), F.col("ip"))
    limits = Limits(labels=6, label_value_bytes=8)
    rows = _merge_inputs(spark, sf).withColumn("merged", merged)
    return rows.select(
        "event_id", L.label_fault(F.col("merged"), limits, merged=True).alias("error")
    ).filter("error IS NOT NULL")


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.label_rows(fx.series_of(fx.samples(spark, sf)))


def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Series that become one when a label is dropped."""
    rest = L.labels_key(L.without_label(F.col("labels"), "user"))
    return (
        fx.series_of(fx.samples(spark, sf))
        .groupBy(rest.alias("group_key"))
        .agg(F.count("*").alias("n_series"))
    )


def scraped(spark: SparkSession, sf: str) -> DataFrame:
    """Business and synthetic samples of a batch in which many scrapes fail."""
    parsed = _parsed(spark, sf, True)
    audit = accounting.scrape_audit(fx.manifest(spark, sf, True), parsed)
    return (
        scraped_samples(parsed, audit)
        .groupBy("scrape_id", "metric_name")
        .agg(F.count("*").alias("n"))
    )


def synthetic_samples(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.synthetic_samples(_audit(spark, sf)).select(
        "scrape_id", "metric_name", "labels_key", "sample_timestamp_ms", "value"
    )


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.run_audit(_audit(spark, sf)).drop("context_json", "tool_version")


def run_context(spark: SparkSession, sf: str) -> DataFrame:
    """The whole audit row of every run: version, and context as JSON."""
    scrapes = _audit(spark, sf)
    context = scrapes.select("run_id").distinct().filter("run_id % 2 = 0").withColumn(
        "context", F.create_map(F.lit("run"), F.col("run_id").cast("string"), F.lit("host"), F.lit("h"))
    )
    return accounting.run_audit(scrapes, context, "9.1").select("run_id", "tool_version", "context_json")


def limited_result(spark: SparkSession, sf: str) -> DataFrame:
    """A range result that passes its limits, which are those of its own counts."""
    result = _range(spark, sf)
    counts = selector.result_counts(result).first()
    limits = max(1, counts["series_count"]), max(1, counts["sample_count"])
    return selector.limited(result, *limits).select(*SELECTED)


def failure_list(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.failures(_audit(spark, sf))


def catalogue_checks(spark: SparkSession, sf: str) -> DataFrame:
    return tables.catalogue_violations(fx.rule_candidates(spark, sf))


def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    return tables.manifest_violations(fx.target_candidates(spark, sf))


def task_checks(spark: SparkSession, sf: str) -> DataFrame:
    return tables.task_violations(
        fx.target_candidates(spark, sf), fx.rule_candidates(spark, sf)
    )


def value_checks(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    rows = fx.events(spark, sf).select(
        "event_id",
        F.when(event % 8 == 4, F.lit(float("nan")))
        .when(event % 8 == 6, F.lit(float("inf")))
        .when(event % 4 < 2, F.col("raw_value"))
        .alias("value"),
        F.when(event % 4 == 1, "NaN").when(event % 8 == 3, "nan").when(event % 8 == 7, "-Inf").alias("value_repr"),
    )
    return upsert.value_violations(rows).select("event_id", "violation")


def prune_kept(spark: SparkSession, sf: str) -> DataFrame:
    _, kept = split_by_cutoff(fx.samples(spark, sf), CUTOFF_MS)
    return kept.select("series_id", "sample_timestamp_ms", "scrape_id")


def orphan_series(spark: SparkSession, sf: str) -> DataFrame:
    series, samples = _gauges(spark, sf)
    _, kept = split_by_cutoff(samples, CUTOFF_MS)
    return without_orphans(series, kept).select("series_id", "labels_key")


def _write(lake: Lake, batch_id: int, rows: DataFrame) -> None:
    lake.begin(batch_id)
    lake.write("samples", rows, batch_id)
    # From what is stored, so the rows are not derived once more.
    stored = lake.raw("samples").filter(F.col("batch_id") == batch_id)
    lake.write("activity", active_days(stored), batch_id)
    lake.write("series", upsert.first_series(rows), batch_id)
    lake.commit(batch_id)


def _stored(spark: SparkSession, samples: DataFrame, name: str) -> Lake:
    """A lake with the samples in two batches, the later events in the first one."""
    lake = Lake(spark, scratch_folder(spark, name))
    half = F.col("order_key") % 2
    for batch_id, part in enumerate((samples.filter(half == 1), samples.filter(half == 0))):
        _write(lake, batch_id, part)
    return lake


def lake_pruned(spark: SparkSession, sf: str) -> DataFrame:
    lake = _stored(spark, fx.samples(spark, sf), "pruned")
    prune(lake, CUTOFF_MS)
    return lake.samples().join(lake.series(), ["series_id", "metric_name"]).select(
        "series_id", "labels_key", "sample_timestamp_ms", "scrape_id"
    )


def lake_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Series that a prune leaves, as the stored days tell."""
    lake = _stored(spark, fx.samples(spark, sf), "orphans")
    prune(lake, CUTOFF_MS, counted=False)
    return lake.series().select("series_id", "labels_key")


def series_activity(spark: SparkSession, sf: str) -> DataFrame:
    """First and last day and number of days of every series, from the bitmaps of batches, of which two
    had their days merged and were pruned before the third came; all compacted then."""
    first, late, later = _thirds(fx.samples(spark, sf))
    lake = Lake(spark, scratch_folder(spark, "active"))
    _write(lake, 0, first)
    _write(lake, 1, late)
    compact_days(lake)
    sweep(lake)
    prune(lake, CUTOFF_MS, counted=False)
    _write(lake, 2, later)
    return day_spans(compact(lake, scratch_folder(spark, "packed")).activity())


def compact_current(spark: SparkSession, sf: str) -> DataFrame:
    lake = _stored(spark, fx.upsert_samples(spark, sf), "log")
    packed = compact(lake, scratch_folder(spark, "packed"))
    return packed.raw("samples").select(*STORED)


def lake_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that fails before its commit, and later ones with the same series; then the
    first one again, with one that holds only part of its rows in between."""
    rows = fx.samples(spark, sf)
    half = F.col("order_key") % 2
    lake = Lake(spark, scratch_folder(spark, "recovered"))
    lake.write("samples", rows.filter(half == 1), 0)
    lake.write("series", upsert.first_series(rows.filter(half == 1)), 0)
    _write(lake, 1, rows)
    _write(lake, 1, rows.filter(half == 0))
    return lake.samples().join(lake.series(), ["series_id", "metric_name"]).select(
        "series_id", "labels_key", "sample_timestamp_ms", "scrape_id"
    )


def _lake_query(read: Callable[[Lake], DataFrame], *columns: str) -> Query:
    """A read of a lake in which many keys were written twice."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = fx.samples(spark, sf).withColumn("order_key", F.col("order_key") + 1)
        stale = rows.withColumns({"value": F.lit(-1.0), "order_key": F.lit(0).cast("bigint"), "value_repr": F.lit(None).cast("string")})
        lake = Lake(spark, scratch_folder(spark, "lake"))
        _write(lake, 0, stale)
        _write(lake, 1, rows)
        return read(lake).select(*columns)

    return query


CLICKS = [Matcher("event_type", "=~", "(?P<the_kind>[c[&&]lick)|view"), Matcher("tier", "!=", "gold")]
lake_instant = _lake_query(lambda lake: lake.instant("event_value", CLICKS, at_ms=fx.AT_MS), *SELECTED)
lake_range = _lake_query(
    lambda lake: lake.range_samples("event_value", CLICKS, at_ms=fx.AT_MS, range_ms=SIX_HOURS_MS),
    *SELECTED,
)


def lake_histogram(spark: SparkSession, sf: str) -> DataFrame:
    lake = _stored(spark, fx.histogram_samples(spark, sf), "histograms")
    view = lake.histogram_view("line_quantity", at_ms=fx.HISTOGRAM_AT_MS)
    return results.nested_view(view, "buckets", "le")


def _thirds(rows: DataFrame) -> list[DataFrame]:
    return [rows.filter(F.col("order_key") % 3 == i) for i in range(3)]


PRUNED_MS = fx.AT_MS - 5 * DAY_MS + 40_000_000
INSTANTS = (fx.AT_MS - 2 * DAY_MS - 1, fx.AT_MS, fx.AT_MS + 5_000_000, fx.AT_MS + 9 * DAY_MS)


def lake_instant_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Instants from closings that were made between batches whose writes come late, before and
    after a prune."""
    first, late, later = _thirds(fx.samples(spark, sf))
    lake = Lake(spark, scratch_folder(spark, "closed"))
    _write(lake, 0, first)
    indexes.close_days(lake, date_of(fx.AT_MS))
    _write(lake, 1, late)
    prune(lake, PRUNED_MS, counted=False)
    indexes.close_days(lake, date_of(fx.AT_MS - DAY_MS))
    indexes.index_labels(lake)
    _write(lake, 2, later)
    found = [
        lake.instant("event_value", CLICKS, at_ms=at).withColumn("at_ms", F.lit(at).cast("bigint"))
        for at in INSTANTS
    ]
    return reduce(DataFrame.unionByName, found).select("at_ms", *SELECTED)


MATCHES = {
    "equal": [Matcher("event_type", "=", "click"), Matcher("tier", "=", "gold")],
    "absent": [Matcher("tier", "=", "")],
    "unequal": [Matcher("tier", "!=", "gold")],
    "pattern": [Matcher("event_type", "=~", "click|view"), Matcher("user", "=~", "[0-9]{1,2}")],
    "pattern of nothing": [Matcher("tier", "=~", "silver|"), Matcher("event_type", "!=", "view")],
    "no pattern": [Matcher("event_type", "!~", "c.*|v.*"), Matcher("tier", "!~", "g.+")],
    "repeated": [Matcher("user", "=~", "1.*"), Matcher("user", "!~", ".*[05]"), Matcher("user", "!=", "11")],
    "unknown label": [Matcher("zone", "!=", ""), Matcher("user", "=~", ".*")],
}


def match_by_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Matched series by two generations of postings and a batch that is not indexed."""
    lake = Lake(spark, scratch_folder(spark, "posted"))
    for i, rows in enumerate(_thirds(fx.samples(spark, sf))):
        _write(lake, i, rows)
        if i < 2:
            indexes.index_labels(lake)
    found = [lake.matched("event_value", m).withColumn("matchers", F.lit(name)) for name, m in MATCHES.items()]
    return reduce(DataFrame.unionByName, found).select("matchers", "series_id", "labels_key")


def compact_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored row after days were merged twice, with a batch in between."""
    lake = Lake(spark, scratch_folder(spark, "days"))
    first, second, third = _thirds(fx.upsert_samples(spark, sf))
    _write(lake, 0, third)
    _write(lake, 1, first)
    compact_days(lake)
    _write(lake, 2, second)
    compact_days(lake)
    sweep(lake)
    return lake.log("samples").select(*STORED)


def _ingested_columns(lake: Lake) -> DataFrame:
    business = lake.samples().filter(~F.startswith("metric_name", F.lit("scrapelake_")))
    return business.join(lake.series(), ["series_id", "metric_name"]).select(
        "metric_name", "labels_key", "sample_timestamp_ms", "value", "value_repr", "scrape_id"
    )


def batch_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Landed files, manifest and catalogue to stored tables in one batch, read back as current
    samples."""
    folder = scratch_folder(spark, "landed")
    fx.land(spark, sf, folder)
    fx.catalogue(spark).write.parquet(f"{folder}-catalogue")
    lake = Lake(spark, scratch_folder(spark, "lake"))
    ingest_batch(
        lake,
        0,
        read_payloads(spark, folder, glob="*.txt"),
        tables.read_manifest(spark, f"{folder}-manifest"),
        tables.read_catalogue(spark, f"{folder}-catalogue"),
    )
    discard(spark, folder)
    return _ingested_columns(lake)


def _streamed(spark: SparkSession, sf: str) -> tuple[Lake, DataFrame, str]:
    folder = scratch_folder(spark, "landed")
    manifest = fx.land(spark, sf, folder)
    lake = Lake(spark, scratch_folder(spark, "lake"))
    files = manifest.count()

    def planned(batch: DataFrame) -> DataFrame:
        rows = tables.read_manifest(spark, f"{folder}-manifest")
        return rows.join(batch.select("path"), "path", "left_semi")

    query = ingest_stream(
        lake,
        stream_payloads(spark, folder, glob="*.txt", max_files_per_trigger=max(1, files // 2)),
        planned,
        fx.catalogue(spark),
        checkpoint=scratch_folder(spark, "stream"),
    )
    query.awaitTermination()
    return lake, manifest, folder


def stream_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The same files through a stream of several micro-batches, each with its own manifest."""
    return _ingested_columns(_streamed(spark, sf)[0])


def stream_packed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payload tables of many scrapes each, through a stream of several micro-batches."""
    folder = scratch_folder(spark, "packed")
    fx.payloads(spark, sf).repartition(4, "path").write.parquet(folder)
    lake = Lake(spark, scratch_folder(spark, "lake"))
    ingest_stream(
        lake,
        stream_packed(spark, folder, max_files_per_trigger=2),
        lambda batch: fx.manifest(spark, sf).join(batch.select("path"), "path", "left_semi"),
        fx.catalogue(spark),
        checkpoint=scratch_folder(spark, "stream"),
    ).awaitTermination()
    return _ingested_columns(lake)


def stream_late_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A stream in which every third payload lands two micro-batches before its manifest row; what
    still waits at its end is read then."""
    folder = scratch_folder(spark, "early")
    files = 4
    fx.payloads(spark, sf).repartition(files, "path").write.parquet(folder)
    lake = Lake(spark, scratch_folder(spark, "lake"))
    planned = fx.manifest(spark, sf)
    early = F.col("scrape_id") % 3 == 0
    known: list[DataFrame] = []

    def rows(batch: DataFrame) -> DataFrame:
        """Rows of late scrapes exist for payloads that the call before the last one has seen."""
        seen = known[-2] if len(known) > 1 else spark.createDataFrame([], "path string")
        known.append(materialize(batch.select("path"), scratch_folder(spark, "seen")))
        late = planned.filter(early).join(seen, "path", "left_semi")
        return planned.filter(~early).join(batch.select("path"), "path", "left_semi").unionByName(late)

    ingest_stream(
        lake,
        stream_packed(spark, folder, max_files_per_trigger=1),
        rows,
        fx.catalogue(spark),
        checkpoint=scratch_folder(spark, "stream"),
        wait_batches=3,
    ).awaitTermination()
    ingest_unlanded(lake, planned, fx.catalogue(spark))
    return _ingested_columns(lake)


def parse_compressed(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of payloads that came plain, compressed in two ways, cut short, and unfolding beyond
    the cap."""
    number = F.col("scrape_id")
    kind = F.element_at(F.array(*map(F.lit, ("identity", "gzip", "deflate", "gzip", "GZIP", "br"))), (number % 6 + 1).cast("int"))
    rows = fx.manifest(spark, sf).withColumn("content_encoding", kind)
    packed = fx.compressed(fx.payloads(spark, sf).join(rows.select("path", "scrape_id"), "path"))
    limits = Limits(body_bytes=fx.BODY_CAP)
    parsed = exposition.parse_payloads(decoded(packed, rows, limits), rows, fx.catalogue(spark), limits)
    audit = accounting.scrape_audit(rows, parsed, limits)
    return audit.select("scrape_id", "status", "error", "sample_count")


def lake_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's lake is compacted, then its last micro-batch comes again, with every file that
    landed and not only its own."""
    lake, manifest, folder = _streamed(spark, sf)
    last = lake.raw("commits").agg(F.max("batch_id")).first()[0]
    packed = compact(lake, scratch_folder(spark, "packed"))
    files = read_payloads(spark, folder, glob="*.txt")
    ingest_batch(packed, last, files, manifest, fx.catalogue(spark), landed_only=True)
    return _ingested_columns(packed)


def shared_task_module(spark: SparkSession, sf: str) -> DataFrame:
    """Every scrape's task has a name of its own, all share a system, and each needs only the
    families of its own rules."""
    task = F.concat(F.lit("task "), F.col("module"))
    targets, rules = (t.withColumn("task_id", task) for t in (fx.manifest(spark, sf), fx.catalogue(spark)))
    rules = rules.filter("module = 'm1' OR name <> 'batch_value'").withColumn("module", F.lit("one"))
    targets = targets.withColumn("module", F.lit("one"))
    parsed = exposition.parse_payloads(fx.payloads(spark, sf), targets, rules, FAULT_LIMITS)
    return (
        exposition.accepted_samples(parsed)
        .groupBy("scrape_id", "family_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows that may not be read, for themselves or for their task, with what is wrong."""
    good, bad = tables.checked_manifest(
        fx.target_candidates(spark, sf).withColumn(
            "scrape_id", F.when(F.col("scrape_id") % 6 == 5, F.col("scrape_id") - 1).otherwise(F.col("scrape_id"))
        ),
        fx.rule_candidates(spark, sf),
    )
    kept = good.select("scrape_id", "path", F.lit("").alias("violation"))
    return kept.unionByName(bad.select("scrape_id", "path", "violation"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _instant(Matcher("event_type", "=~", "click|view"))(spark, sf)


QUERIES: dict[str, Query] = {
    "series_key": series_key,
    "instant_latest": _instant(),
    "instant_max_age": _instant(max_age_ms=MAX_AGE_MS),
    "range_open_closed": lambda spark, sf: _range(spark, sf).select(*SELECTED),
    "match_eq": _instant(Matcher("event_type", "=", "click"), Matcher("tier", "=", "gold")),
    "match_eq_empty": _instant(Matcher("tier", "=", "")),
    "match_ne_missing": _instant(Matcher("tier", "!=", "gold")),
    "match_regex": _instant(
        Matcher("event_type", "=~", "click|view"), Matcher("user", "=~", "[0-9]{1,2}")
    ),
    "match_regex_classes": _instant(
        Matcher("event_type", "=~", r"[[&&c\]]l(?P<i_c>ic)k|vi(?P<e_1>e)w|\(?P<x>"),
    ),
    "match_not_regex": _instant(
        Matcher("event_type", "!~", "(?P<first>c.*|v.*)"), Matcher("event_type", "!=", "error")
    ),
    "limit_counts": limit_counts,
    "result_flat": result_flat,
    "result_nested": result_nested,
    "nested_range": nested_range,
    "histogram_view": histogram_view,
    "histogram_range": histogram_range,
    "histogram_matched": histogram_matched,
    "histogram_violations": histogram_violations,
    "summary_view": summary_view,
    "summary_violations": summary_violations,
    "view_document_lines": view_document_lines,
    "group_order": group_order,
    "view_flat": view_flat,
    "summary_flat": summary_flat,
    "upsert_last_wins": upsert_last_wins,
    "series_first_wins": series_first_wins,
    "metadata_last_wins": metadata_last_wins,
    "parse_round_trip": parse_round_trip,
    "parse_errors": parse_errors,
    "help_unit_carry": help_unit_carry,
    "merge_honor": _merge(True),
    "merge_exported": _merge(False),
    "merged_limits": merged_limits,
    "label_rows": label_rows,
    "label_groups": label_groups,
    "scraped": scraped,
    "synthetic_samples": synthetic_samples,
    "run_status": run_status,
    "run_context": run_context,
    "limited_result": limited_result,
    "failure_list": failure_list,
    "catalogue_checks": catalogue_checks,
    "manifest_checks": manifest_checks,
    "task_checks": task_checks,
    "value_checks": value_checks,
    "prune_kept": prune_kept,
    "orphan_series": orphan_series,
    "lake_pruned": lake_pruned,
    "lake_orphans": lake_orphans,
    "series_activity": series_activity,
    "compact_current": compact_current,
    "lake_recovered": lake_recovered,
    "lake_instant": lake_instant,
    "lake_range": lake_range,
    "lake_histogram": lake_histogram,
    "lake_instant_indexed": lake_instant_indexed,
    "match_by_postings": match_by_postings,
    "compact_days": compact_by_day,
    "lake_replayed": lake_replayed,
    "stream_packed": stream_packed_payloads,
    "stream_late_manifest": stream_late_manifest,
    "parse_compressed": parse_compressed,
    "quarantine": quarantine,
    "shared_task_module": shared_task_module,
    "batch_ingest": batch_ingest,
    "stream_equals_batch": stream_equals_batch,
}
