import os
from datetime import date

import pytest
from build import catalogue, gauge, manifest, payload_frame, samples, series
from pyspark.sql import functions as F

from scrapelake.operators import accounting, upsert
from scrapelake.operators.exposition import parse_payloads
from scrapelake.operators.selector import instant
from scrapelake.operators.views import histogram_view
from scrapelake.plans.ingest import ingest_batch, ingest_unlanded
from scrapelake.plans.lake import Lake
from scrapelake.plans.upkeep import compact, compact_days, cutoff, prune
from scrapelake.schema import DAY_MS, Limits
from scrapelake.sources.payloads import read_payloads, stream_payloads
from scrapelake.sources.tables import catalogue_violations, manifest_violations, task_violations
from scrapelake.streaming.ingest import ingest_stream

RULES = [("http_requests_total", "counter"), ("latency_seconds", "histogram")]
TEXT = """# TYPE http_requests_total counter
http_requests_total{status="200"} 7
# TYPE latency_seconds histogram
latency_seconds_bucket{le="0.5"} 3
latency_seconds_bucket{le="+Inf"} 5
latency_seconds_sum 1.2
latency_seconds_count 5
"""


def fill(spark, lake, *batches):
    for batch_id, rows in enumerate(batches):
        table = samples(spark, rows).withColumn("order_key", F.col("order_key") + batch_id * 1000)
        lake.write("samples", table, batch_id)
        lake.write("series", upsert.first_series(table), batch_id)
        lake.commit(batch_id)


def values(frame):
    return sorted((r.sample_timestamp_ms, r.value) for r in frame.collect())


def test_last_write_of_a_key_wins(spark):
    rows = [gauge(5, 1, {"rack": "r2"}, scrape_id=1), gauge(5, "NaN", {"rack": "r2"}, scrape_id=2), gauge(6, 3, {"rack": "r2"})]
    found = {r.sample_timestamp_ms: r for r in upsert.last_writes(samples(spark, rows)).collect()}
    assert (found[5].value, found[5].value_repr, found[5].scrape_id) == (None, "NaN", 2)
    assert found[6].value == 3.0


def test_label_order_makes_no_series_and_the_first_type_stays(spark):
    rows = [gauge(1, 1, {"b": "1", "a": "2"}), ("x", "other", "counter", {"a": "2", "b": "1"}, 2, 1.0, None, 1)]
    (row,) = series(samples(spark, rows)).collect()
    assert (row.family_name, row.metric_type) == ("x", "gauge")


def test_prune_keeps_the_cutoff_and_drops_orphans(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    fill(
        spark,
        lake,
        [gauge(1, 1, {"s": "old"}), gauge(2_699, 1, {"s": "old"}), gauge(2_700, 2, {"s": "new"})],
        [gauge(2, 9, {"s": "gone"}), gauge(3 * DAY_MS, 3, {"s": "new"}), gauge(1, 7, {"s": "old"})],
        [gauge(-DAY_MS, 4, {"s": "new"})],
    )
    assert prune(lake, 2_700) == 4, "two writes of one key are one sample"
    assert values(lake.samples()) == [(2_700, 2.0), (3 * DAY_MS, 3.0)]
    assert [r.labels["s"] for r in lake.series().collect()] == ["new"]
    assert not os.path.exists(tmp_path / "lake/samples/sample_date=1969-12-31")
    assert prune(lake, 2_700) == 0
    assert prune(lake, 3 * DAY_MS + 1) == 2
    assert lake.samples().count() == 0 and lake.series().count() == 0
    fill(spark, lake, [gauge(7, 1, {"s": "back"})])
    assert values(lake.samples()) == [(7, 1.0)]


def test_cutoff_arguments():
    assert cutoff(before_ms=5) == 5
    assert cutoff(now_ms=100, older_than_ms=30) == 70
    for bad in ({}, {"before_ms": 1, "older_than_ms": 1}, {"older_than_ms": 0, "now_ms": 1}, {"older_than_ms": 1}):
        with pytest.raises(ValueError):
            cutoff(**bad)


def test_any_timestamp_can_be_stored(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    stamps = [-(1 << 62), 0, 1 << 62]
    fill(spark, lake, [gauge(ts, i) for i, ts in enumerate(stamps)])
    assert [ts for ts, _ in values(lake.samples())] == stamps
    found = instant(lake.series(), lake.samples(), "x", at_ms=1 << 62).first()
    assert found.value == 2.0


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    fill(spark, lake, [gauge(1, 1)])
    lake.write("samples", samples(spark, [gauge(1, 2), gauge(2, 2)]), 7)
    assert values(lake.samples()) == [(1, 1.0)]
    lake.commit(7)
    assert [ts for ts, _ in values(lake.samples())] == [1, 2]


def test_compaction_keeps_the_current_content(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    fill(spark, lake, [gauge(1, 1), gauge(2, 2)], [gauge(2, 5), gauge(DAY_MS, 3, {"a": "b"})])
    packed = compact(lake, str(tmp_path / "packed"))
    assert packed.raw("samples").count() == 3
    assert values(packed.samples()) == values(lake.samples()) == [(1, 1.0), (2, 5.0), (DAY_MS, 3.0)]
    assert packed.series().count() == 2
    assert {r.sample_date for r in packed.raw("samples").collect()} == {date(1970, 1, 1), date(1970, 1, 2)}


def gauges(spark, lake):
    return sorted((r.labels["n"], r.value) for r in lake.instant("x", at_ms=1 << 40).collect())


def scrape(spark, lake, batch_id, *texts, first=0, rows=None, **columns):
    """Ingests texts as one batch; payload i belongs to scrape ``first + i``."""
    frame = payload_frame(spark, list(texts))
    targets = manifest(spark, len(texts) if rows is None else rows, **columns)
    targets = targets.withColumn("scrape_id", F.col("scrape_id") + first)
    return ingest_batch(lake, batch_id, frame, targets, catalogue(spark, ("x", "gauge")))


def test_a_replay_after_compaction_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    for i in range(3):
        assert scrape(spark, lake, i, f'x{{n="{i}"}} {i}\n', first=i)
    packed = compact(lake, str(tmp_path / "packed"))
    before = gauges(spark, packed)
    assert before == [("0", 0.0), ("1", 1.0), ("2", 2.0)] == gauges(spark, lake)
    assert not scrape(spark, packed, 2, 'x{n="2"} 2\n', first=2)
    assert gauges(spark, packed) == before and packed.scrapes().count() == 3
    assert scrape(spark, packed, 3, 'x{n="2"} 7\n', first=3)
    again = compact(packed, str(tmp_path / "again"))
    assert gauges(spark, again) == [("0", 0.0), ("1", 1.0), ("2", 7.0)]
    assert again.compacted_through() == 3


@pytest.mark.parametrize("by_day", [False, True])
def test_a_corrected_rerun_of_a_merged_batch_is_refused(spark, tmp_path, by_day):
    """Also if it is as long as before. Under a number of its own it is stored."""
    lake = Lake(spark, str(tmp_path / "lake"))
    for i in range(2):
        scrape(spark, lake, i, f'x{{n="{i}"}} {i}\n', first=10)
    if by_day:
        compact_days(lake)
    else:
        lake = compact(lake, str(tmp_path / "packed"))
    for i in range(2):
        assert not scrape(spark, lake, i, f'x{{n="{i}"}} {i}\n', first=10)
    for text in ('x{n="1"} 8\n', 'x{n="1"} 1\n\n', ""):
        with pytest.raises(ValueError, match="corrected"):
            scrape(spark, lake, 1, text, first=10)
    assert gauges(spark, lake) == [("0", 0.0), ("1", 1.0)]
    assert scrape(spark, lake, 2, 'x{n="1"} 8\n', first=11)
    assert gauges(spark, lake) == [("0", 0.0), ("1", 8.0)]


def test_compaction_leaves_room_for_a_batch_that_had_failed(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    monkeypatch.setattr(Lake, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        scrape(spark, lake, 0, 'x{n="0"} 0\n')
    monkeypatch.undo()
    assert scrape(spark, lake, 1, 'x{n="1"} 1\n', first=1)
    packed = compact(lake, str(tmp_path / "packed"))
    assert scrape(spark, packed, 0, 'x{n="0"} 0\n')
    assert gauges(spark, packed) == [("0", 0.0), ("1", 1.0)]
    assert packed.merged_batches() == [(1, 1)]


def test_another_source_under_a_merged_number_is_refused(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    scrape(spark, lake, 0, 'x{n="a"} 1\n', 'x{n="b"} 2\n', rows=1)
    packed = compact(lake, str(tmp_path / "packed"))
    assert not scrape(spark, packed, 0, 'x{n="a"} 1\n', 'x{n="b"} 2\n', rows=1)
    with pytest.raises(ValueError, match="batch 0"):
        scrape(spark, packed, 0, 'x{n="c"} 3\n', first=7)


def test_a_batch_leans_on_no_uncommitted_one(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = samples(spark, [gauge(1, 1, {"n": "a"})])
    lake.write("samples", rows, 0)
    lake.write("series", upsert.first_series(rows), 0)
    lake.begin(1)
    lake.write("samples", rows, 1)
    lake.write("series", upsert.first_series(rows), 1)
    lake.commit(1)
    assert gauges(spark, lake) == [("a", 1.0)]
    assert lake.series().count() == 1


def test_a_corrected_rerun_leaves_nothing_of_the_first(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    scrape(spark, lake, 4, f'x{{n="a"}} 1 {DAY_MS}\nx{{n="b"}} 2 {3 * DAY_MS}\n')
    assert gauges(spark, lake) == [("a", 1.0), ("b", 2.0)]
    scrape(spark, lake, 4, f'x{{n="a"}} 5 {DAY_MS}\n')
    assert gauges(spark, lake) == [("a", 5.0)]
    scrape(spark, lake, 4, "x{broken\n")
    assert gauges(spark, lake) == [] and lake.metadata().count() == 0
    assert [r.status for r in lake.scrapes().collect()] == ["failed"]


def test_nothing_that_landed_is_dropped(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    scrape(spark, lake, 0, 'x{n="a"} 1\n', 'x{n="b"} 2\n', rows=1)
    assert gauges(spark, lake) == [("a", 1.0)]
    rows = {(r.scrape_id, r.status, r.error) for r in lake.scrapes().collect()}
    assert rows == {(0, "success", None), (None, "failed", "payload has no manifest row")}


def test_rows_that_share_an_id_or_a_path_are_set_aside(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    texts = [f'x{{n="{i}"}} {i}\n' for i in range(6)]
    targets = manifest(spark, 6).withColumns(
        {
            "scrape_id": F.expr("CASE scrape_id WHEN 1 THEN 0 WHEN 5 THEN 1L << 40 ELSE scrape_id END"),
            "path": F.expr("CASE WHEN scrape_id = 4 THEN replace(path, '4', '3') ELSE path END"),
        }
    )
    ingest_batch(lake, 0, payload_frame(spark, texts), targets, catalogue(spark, ("x", "gauge")))
    assert gauges(spark, lake) == [("2", 2.0)]
    faults = sorted((r.error or "", r.scrape_id is None) for r in lake.scrapes().collect())
    assert faults == [
        ("", False),
        ("payload has no manifest row", True),
        ("payload path used more than once", False),
        ("payload path used more than once", False),
        ("scrape id out of range", False),
        ("scrape id used more than once", False),
        ("scrape id used more than once", False),
    ]


def test_prune_leaves_a_batch_that_comes_meanwhile(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    fill(spark, lake, [gauge(1, 1, {"n": "old"}), gauge(9 * DAY_MS, 2, {"n": "kept"})])
    drop = Lake.drop_partition
    late = samples(spark, [gauge(9 * DAY_MS + 5, 3, {"n": "late"}), gauge(9 * DAY_MS + 5, 3, {"n": "old"})])

    def drop_after_a_write(self, table, *parts):
        monkeypatch.setattr(Lake, "drop_partition", drop)
        self.write("samples", late, 7)
        self.write("series", upsert.first_series(late), 7)
        self.commit(7)
        drop(self, table, *parts)

    monkeypatch.setattr(Lake, "drop_partition", drop_after_a_write)
    prune(lake, DAY_MS)
    assert gauges(spark, lake) == [("kept", 2.0), ("late", 3.0), ("old", 3.0)]


def test_tasks_may_share_a_system_and_module(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rules = catalogue(spark, ("x", "gauge"), task_id="one").unionByName(catalogue(spark, ("y", "gauge"), task_id="two"))
    targets = manifest(spark, 2, task_id=["one", "two"])
    ingest_batch(lake, 0, payload_frame(spark, ["x 1\n", "y 2\nx 5\n"]), targets, rules)
    assert [r.status for r in lake.scrapes().collect()] == ["success"] * 2
    assert gauges_of(lake, "x") == [1.0] and gauges_of(lake, "y") == [2.0]
    assert catalogue_violations(rules).count() == 0
    both = rules.unionByName(catalogue(spark, ("y", "gauge"), task_id="two"))
    assert catalogue_violations(both).count() == 1
    assert task_violations(manifest(spark, 1, task_id="one"), rules).count() == 1


def gauges_of(lake, metric):
    return [r.value for r in lake.instant(metric, at_ms=1 << 40).collect()]


def test_target_addresses(spark):
    good = ["http://h/metrics", "HTTP://h/", "https://u:p@h:9/x?y", "http://[::1]:80/", "http://h"]
    bad = ["http://:80/", "http:///x", "ftp://h/", "http://u@:1/", "h/metrics", "", "http://?x"]
    frame = manifest(spark, len(good + bad), logical_url=good + bad)
    found = manifest_violations(frame).filter("violation = 'invalid target URL'").collect()
    assert sorted(r.scrape_id for r in found) == list(range(len(good), len(good + bad)))


def test_partial_success(spark, tmp_path):
    """Of four targets one is refused, one is malformed after a good line, one never resolved."""
    lake = Lake(spark, str(tmp_path / "lake"))
    texts = [TEXT, TEXT, TEXT + "http_requests_total{oops 3\n", None]
    targets = manifest(
        spark,
        4,
        http_status=[200, 503, 200, None],
        attempts=[1, 3, 1, None],
        resolved_ip=["10.0.0.1", "10.0.0.2", "10.0.0.3", ""],
        fetch_error=[None, None, None, "no address"],
        path=["p0", "p1", "p2", None],
        collector_labels=[("system", "s"), ("module", "m"), ("job", "m"), ("instance", "i")],
    )
    ingest_batch(lake, 0, payload_frame(spark, texts), targets, catalogue(spark, *RULES))

    scrapes = {r.scrape_id: r for r in lake.scrapes().collect()}
    assert [scrapes[i].status for i in range(4)] == ["success", "failed", "failed", "failed"]
    assert [scrapes[i].sample_count for i in range(4)] == [5, 0, 0, 0]
    assert [scrapes[i].http_status for i in range(4)] == [200, 503, None, None]
    assert [scrapes[i].instance for i in range(4)] == ["i", "i", "i", "http://h/metrics"]
    assert scrapes[3].error == "no address"
    (run,) = lake.runs().collect()
    assert (run.status, run.successful_targets, run.failed_targets) == ("partial", 1, 3)
    assert {r.resolved_ip for r in accounting.failures(lake.scrapes()).collect()} == {"10.0.0.2", "10.0.0.3", None}

    current, dimension = lake.samples(), lake.series()
    assert current.filter("metric_name = 'http_requests_total'").count() == 1
    up = instant(dimension, current, "scrapelake_up", at_ms=1 << 40).collect()
    assert {(r.labels["resolved_ip"], r.value) for r in up} == {("10.0.0.1", 1.0), ("10.0.0.2", 0.0), ("10.0.0.3", 0.0), ("", 0.0)}
    unresolved = next(r for r in up if r.labels["resolved_ip"] == "")
    assert unresolved.labels == {"system": "s", "module": "m", "job": "m", "resolved_ip": ""}
    for metric, expected in (("scrape_duration_seconds", 0.5), ("scrape_samples", 5.0), ("scrape_attempts", 1.0)):
        rows = instant(dimension, current, f"scrapelake_{metric}", at_ms=1 << 40).collect()
        assert {r.value for r in rows if r.labels["resolved_ip"] == "10.0.0.1"} == {expected}
    (group,) = histogram_view(dimension, current, "latency_seconds", at_ms=1 << 40).collect()
    assert [b.le for b in group.buckets] == ["0.5", "+Inf"]


def test_a_bad_manifest_row_stops_no_other_scrape(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    targets = manifest(spark, 3).withColumns(
        {
            "collector_labels": F.expr(
                "CASE scrape_id WHEN 0 THEN array(named_struct('name', 'a', 'value', '1'),"
                " named_struct('name', 'a', 'value', '2'), named_struct('name', 'b', 'value', NULL))"
                " WHEN 2 THEN collector_labels END"
            ),
            "honor_labels": F.expr("nullif(scrape_id, 1) > -1"),
            "resolved_ip": F.expr("CASE WHEN scrape_id <> 1 THEN resolved_ip END"),
        }
    )
    ingest_batch(lake, 0, payload_frame(spark, ["x 1\n"] * 3), targets, catalogue(spark, ("x", "gauge")))
    assert [r.status for r in lake.scrapes().collect()] == ["success"] * 3
    labels = {r.scrape_id: r.labels for r in instant(lake.series(), lake.samples(), "x", at_ms=1 << 40).collect()}
    assert labels[0] == {"a": "2", "resolved_ip": "10.0.0.1"}
    assert labels[1] == {"resolved_ip": ""}


def test_sample_cap_leaves_only_synthetic_samples(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    ingest_batch(
        lake, 0, payload_frame(spark, ["x 1\nx 2\nx 3\n"]), manifest(spark, 1), catalogue(spark, ("x", "gauge")), limits=Limits(samples=2)
    )
    assert {r.metric_name.split("_")[0] for r in lake.samples().collect()} == {"scrapelake"}
    (run,) = lake.runs(spark.createDataFrame([(1, {"b": "2", "a": "1"})], "run_id long, context map<string,string>")).collect()
    assert (run.status, run.context_json) == ("failed", '{"a":"1","b":"2"}')


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    for _ in range(2):
        ingest_batch(lake, 3, payload_frame(spark, [TEXT]), manifest(spark, 1), catalogue(spark, *RULES))
    assert lake.raw("samples").count() == 9
    assert lake.raw("series").count() == 9
    assert lake.raw("scrapes").count() == 1
    assert lake.metadata().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    count = 5
    for i in range(count):
        text = f"# HELP x help {i}\nx{{a=\"b\"}} {i} 1000\nx {i}\n" + ("y{\n" if i == 3 else "")
        (landed / f"{i}.txt").write_text(text if i != 4 else text + "#" * 300)
    (landed / "ignored.tmp").write_text("x 1")
    limits = Limits(body_bytes=200)
    targets = manifest(spark, count, path=[f"file:{landed}/{i}.txt" for i in range(count)])
    rules = catalogue(spark, ("x", "gauge"), ("y", "gauge", False))

    batch = Lake(spark, str(tmp_path / "batch"))
    files = read_payloads(spark, str(landed), glob="*.txt", limits=limits)
    ingest_batch(batch, 0, files, targets, rules, limits=limits)
    stream = Lake(spark, str(tmp_path / "stream"))
    ingest_stream(
        stream,
        stream_payloads(spark, str(landed), glob="*.txt", max_files_per_trigger=2, limits=limits),
        targets,
        rules,
        checkpoint=str(tmp_path / "checkpoint"),
        limits=limits,
    ).awaitTermination()

    assert stream.raw("commits").count() > 1
    for table in ("samples", "series", "metadata", "scrapes"):
        rows = [sorted(map(str, getattr(lake, table)().collect())) for lake in (batch, stream)]
        assert rows[0] == rows[1] and rows[0], table
    status = {r.scrape_id: r.status for r in stream.scrapes().collect()}
    assert status == {0: "success", 1: "success", 2: "success", 3: "failed", 4: "failed"}

    watched = Lake(spark, str(tmp_path / "watched"))
    ingest_stream(
        watched,
        stream_payloads(spark, str(landed), glob="*.txt", max_files_per_trigger=2, limits=limits),
        lambda batch: targets.join(batch.select("path"), "path", "left_semi"),
        rules,
        checkpoint=str(tmp_path / "watched-checkpoint"),
        limits=limits,
    ).awaitTermination()
    assert sorted(map(str, watched.samples().collect())) == sorted(map(str, stream.samples().collect()))

    more = manifest(spark, count + 1, path=[f"file:{landed}/{i}.txt" for i in range(count + 1)])
    for _ in range(2):
        ingest_unlanded(stream, more, rules)
    (late,) = stream.scrapes().filter(f"scrape_id = {count}").collect()
    assert (late.status, late.error) == ("failed", "no payload was landed: http://h/metrics")
    assert stream.samples().filter(f"scrape_id = {count}").count() == 4
    assert stream.scrapes().count() == count + 1


def test_stored_values_are_checked(spark):
    rows = [(1.0, None), (None, "NaN"), (None, None), (1.0, "NaN"), (float("nan"), None), (None, "nan"), (float("inf"), None)]
    frame = spark.createDataFrame(rows, "value double, value_repr string")
    assert upsert.value_violations(frame).count() == 5


def test_parse_equals_current_parse(spark):
    """The payload the basic example serves."""
    text = TEXT.replace('{status="200"} 7', '{method="get"} 1027') + "other_total 1\n"
    parsed = parse_payloads(payload_frame(spark, [text]), manifest(spark, 1), catalogue(spark, *RULES))
    row = parsed.filter("kind = 'scrape'").first()
    assert (row.scrape_error, row.sample_count) == (None, 5)
