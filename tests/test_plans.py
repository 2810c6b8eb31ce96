"""Plans, not results: what is pushed down, what is shuffled, what runs in Python."""

import re
from datetime import datetime

import pytest
from build import catalogue, gauge, manifest, payload_frame, samples
from pyspark.sql import functions as F

import __spark_entry__ as driver
from scrapelake.operators import exposition, upsert
from scrapelake.operators.selector import Matcher, instant, range_samples
from scrapelake.plans import checks
from scrapelake.plans import fixtures as fx
from scrapelake.plans.ingest import ingest_batch
from scrapelake.plans.lake import Lake
from scrapelake.schema import DAY_MS, PAYLOADS, Limits
from scrapelake.session import materialize
from scrapelake.sources.payloads import read_payloads

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    table = samples(spark, [gauge(d * DAY_MS, d, {"i": str(d)}) for d in range(5)])
    lake.write("samples", table, 0)
    lake.write("series", upsert.first_series(table), 0)
    lake.commit(0)
    return lake


def test_instant_prunes_pushes_down_and_hashes(lake):
    text = plan(
        instant(lake.series(), lake.samples(), "x", [Matcher("i", "=~", "[1-3]")], at_ms=3 * DAY_MS, max_age_ms=DAY_MS)
    )
    scan = next(line for line in text.splitlines() if "FileScan" in line and "/samples" in line)
    assert "EqualTo(metric_name,x)" in scan
    assert "LessThanOrEqual(sample_timestamp_ms" in scan
    assert re.search(r"PartitionFilters: \[[^\]]*sample_date[^\]]*<=", scan)
    assert re.search(r"PartitionFilters: \[[^\]]*sample_date[^\]]*>=", scan)
    assert "partial_max_by" in text
    # Of the samples only: the few series take their first write in a sorted aggregate.
    assert not re.search(r"SortAggregate[^\n]*max_by", text)
    assert "Python" not in text


def test_range_reads_only_its_days_and_columns(lake):
    text = plan(
        range_samples(lake.series(), lake.samples(), "x", at_ms=3 * DAY_MS, range_ms=DAY_MS).select("value")
    )
    scan = next(line for line in text.splitlines() if "FileScan" in line and "/samples" in line)
    assert "collected_at_ms" not in scan.split("ReadSchema")[1]
    frame = range_samples(lake.series(), lake.samples(), "x", at_ms=3 * DAY_MS, range_ms=DAY_MS)
    assert [r.value for r in frame.collect()] == [3.0]


def test_upserts_stay_hash_aggregates(lake):
    text = plan(lake.samples())
    assert "SortAggregate" not in text and "Sort [" not in text
    assert text.count("HashAggregate") == 2


def test_series_collapse_before_the_shuffle(lake):
    """Whatever is sorted is sorted after the samples became series."""
    text = plan(upsert.first_series(lake.raw("samples").withColumns({c: F.lit("") for c in ("labels_key", "family_name", "metric_type")})))
    first_exchange = text.rindex("Exchange hashpartitioning")
    assert "Sort [" not in text[first_exchange:]
    assert "partial_min" in text[first_exchange:]
    assert "SortAggregate" not in text


def test_metadata_never_sorts_samples(spark, tmp_path):
    parsed = exposition.parse_payloads(
        payload_frame(spark, ["# HELP x h\nx 1\n"]), manifest(spark, 1), fx.catalogue(spark)
    )
    stored = materialize(parsed.drop("labels"), str(tmp_path / "parsed"), "kind")
    text = plan(exposition.last_metadata(stored))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters" in line for line in scans)
    assert "partial_max_by" in text


def test_oversize_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x 1")
    text = plan(read_payloads(spark, str(tmp_path)))
    assert "LessThanOrEqual(length,8388608)" in text
    assert text.count("content#") > 0
    large = next(line for line in text.splitlines() if "GreaterThan(length" in line)
    assert "content" not in large.split("FileScan")[1]


def test_parsing_shuffles_once(spark, tmp_path):
    payloads = materialize(payload_frame(spark, ["x 1\n"] * 3), str(tmp_path / "payloads"))
    targets = materialize(manifest(spark, 3), str(tmp_path / "manifest"))
    text = plan(exposition.parse_payloads(payloads, targets, fx.catalogue(spark)))
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(scrape_id" in line]
    assert len(wide) == 1
    assert "SortMergeJoin" not in text
    windows, sorts = text.count("+- Window ["), text.count("Sort [scrape_id")
    assert (windows, sorts) == (4, 2)
    assert "Python" not in text


@pytest.mark.parametrize(
    "name", ["instant_latest", "histogram_view", "upsert_last_wins", "merge_exported", "parse_errors"]
)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_lines_are_spread_however_few_files_the_payloads_came_in(spark, tmp_path):
    texts = [f'x{{i="{i}"}} 1\n' * 3 for i in range(40)]
    one = materialize(payload_frame(spark, texts).coalesce(1), str(tmp_path / "payloads"))
    rows = materialize(manifest(spark, 40), str(tmp_path / "manifest"))
    rules = materialize(catalogue(spark, ("x", "gauge")), str(tmp_path / "catalogue"))
    lines = exposition.payload_lines(one, rows, rules, tasks=7)
    places = lines.filter("kind = 'sample'").withColumn("part", F.spark_partition_id()).groupBy("scrape_id").agg(
        F.collect_set("part").alias("parts"), F.count("*").alias("n")
    ).collect()
    assert {r.n for r in places} == {3} and {len(r.parts) for r in places} == {1}
    assert len({r.parts[0] for r in places}) > 3
    # Nothing is shuffled after the payloads: the windows take the partitions as they are.
    parsed = exposition.parse_payloads(one, rows, rules, tasks=7)
    assert parsed.rdd.getNumPartitions() == 7
    assert parsed.filter("kind = 'sample' AND scrape_error IS NULL").count() == 120


def test_tasks_grow_with_the_bytes_that_are_read(spark, monkeypatch):
    monkeypatch.setattr(exposition, "TASK_BYTES", 10)
    rows = payload_frame(spark, ["x 1234567\n"] * 50)
    assert exposition.parse_tasks(rows) == 50
    assert exposition.parse_tasks(rows, Limits(body_bytes=5)) == 8
    assert exposition.parse_tasks(rows.limit(0)) == 8


def test_a_batch_opens_every_payload_once(spark, tmp_path):
    opened = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    rows = payload_frame(spark, [f"x {i}\n" for i in range(6)]).mapInArrow(run, PAYLOADS)
    lake = Lake(spark, str(tmp_path / "lake"))
    assert ingest_batch(lake, 0, rows, manifest(spark, 5), catalogue(spark, ("x", "gauge")))
    assert opened.value == 6
    assert lake.samples().filter("metric_name = 'x'").count() == 1  # one series at one time
    assert sorted(r.status for r in lake.scrapes().collect()) == ["failed"] + ["success"] * 5
    assert lake.raw("landed").count() == 6
    assert not [p.name for p in (tmp_path / "lake").iterdir() if p.name.startswith("_")]


def test_landed_files_stand_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "FOLDER_PAYLOADS", 2)
    spark.range(5 * fx.EVENTS_PER_PAYLOAD).select(
        F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.col("id").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    ).write.parquet(str(tmp_path / "sf/events.parquet"))
    rows = fx.land(spark, str(tmp_path / "sf"), str(tmp_path / "landed")).collect()
    assert sorted(r.scrape_id for r in rows) == list(range(5)) and len({r.path for r in rows}) == 5
    assert len([p for p in (tmp_path / "landed").iterdir() if p.is_dir()]) == 3


def test_a_replay_comes_with_every_landed_file(spark, tmp_path, monkeypatch):
    count = 5 * fx.EVENTS_PER_PAYLOAD
    spark.range(count).select(
        F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.col("id").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    ).write.parquet(str(tmp_path / "sf/events.parquet"))
    replays = []

    def replayed(lake, batch_id, payloads, *rest, **more):
        replays.append((payloads.count(), ingest_batch(lake, batch_id, payloads, *rest, **more)))

    monkeypatch.setattr(checks, "ingest_batch", replayed)
    rows = checks.lake_replayed(spark, str(tmp_path / "sf"))
    assert replays == [(5, False)], "all files are read and found to be stored"
    assert rows.filter("metric_name = 'event_value'").count() == count
