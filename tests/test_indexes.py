"""Closings, postings and merged days: what is read, what may lag, what stays the same."""

import os
import random
import re

import pytest
from build import gauge, samples
from pyspark.sql import functions as F

from scrapelake.operators import selector, upsert
from scrapelake.operators.selector import Matcher
from scrapelake.plans import indexes
from scrapelake.plans.lake import FIRST_MERGE, Lake
from scrapelake.plans.upkeep import compact, compact_days, prune, sweep
from scrapelake.schema import DAY_MS


def put(spark, lake, batch_id, rows):
    table = samples(spark, rows).withColumn("order_key", F.col("order_key") + batch_id * 1000)
    lake.begin(batch_id)
    lake.write("samples", table, batch_id)
    lake.write("series", upsert.first_series(table), batch_id)
    lake.commit(batch_id)


def days(found):
    return [(d - indexes.V.date_of(0)).days for d in found]


def latest(lake, at_ms, plain=False, **more):
    """By the indexes, or by the whole log."""
    if plain:
        frame = selector.instant(lake.series(), lake.log("samples"), "x", at_ms=at_ms, **more)
    else:
        frame = lake.instant("x", at_ms=at_ms, **more)
    return sorted((r.labels["s"], r.sample_timestamp_ms, r.value, r.value_repr, r.scrape_id) for r in frame.collect())


def scans(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line]


def random_rows(rng, n):
    stamps = [rng.randrange(6) * DAY_MS + rng.choice([0, 5, DAY_MS - 1, rng.randrange(DAY_MS)]) for _ in range(n)]
    return [gauge(ts, rng.choice([rng.randrange(99), "NaN", "+Inf"]), {"s": f"s{rng.randrange(5)}"}, scrape_id=i) for i, ts in enumerate(stamps)]


def test_an_instant_is_the_same_with_closings(spark, tmp_path):
    rng = random.Random(11)
    lake = Lake(spark, str(tmp_path / "lake"))

    def same(*ats):
        for at in ats or (2 * DAY_MS + 7, 9 * DAY_MS):
            assert latest(lake, at) == latest(lake, at, plain=True)

    put(spark, lake, 0, random_rows(rng, 30))
    assert days(indexes.close_days(lake, indexes.V.date_of(3 * DAY_MS)))
    same(0, DAY_MS - 1, DAY_MS, 5 * DAY_MS)
    put(spark, lake, 1, random_rows(rng, 30))
    same()
    aged = [latest(lake, 4 * DAY_MS, plain, max_age_ms=DAY_MS) for plain in (False, True)]
    assert aged[0] == aged[1]
    put(spark, lake, 1, random_rows(rng, 8))
    same()
    indexes.close_days(lake)
    prune(lake, DAY_MS + 1000)
    same()
    put(spark, lake, 2, random_rows(rng, 12))
    same()
    indexes.close_days(lake)
    same()
    compact_days(lake)
    same()
    put(spark, lake, 3, random_rows(rng, 5))
    indexes.close_days(lake)
    indexes.sweep(lake)
    sweep(lake)
    same()
    assert indexes.close_days(lake) == [], "nothing is new"


def test_only_days_with_late_writes_are_closed_again(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(d * DAY_MS, d, {"s": "a"}) for d in range(4)])
    assert days(indexes.close_days(lake)) == [0, 1, 2, 3]
    put(spark, lake, 1, [gauge(2 * DAY_MS + 1, 9, {"s": "b"})])
    assert days(indexes.close_days(lake)) == [2, 3]
    assert {e.covered for e in indexes.entries(lake, indexes.CLOSINGS)} == {((0, 1),)}
    assert latest(lake, 3 * DAY_MS + 5) == [("a", 3 * DAY_MS, 3.0, None, 1), ("b", 2 * DAY_MS + 1, 9.0, None, 1)]


def test_an_instant_reads_one_closing_and_one_day(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(d * DAY_MS, d, {"s": "a"}) for d in range(5)])
    indexes.close_days(lake)
    frame = lake.instant("x", [Matcher("s", "=", "a")], at_ms=3 * DAY_MS + 1)
    found = scans(frame)
    assert [r.value for r in frame.collect()] == [3.0]
    closed = [line for line in found if "/closings/" in line]
    assert len(closed) == 1 and "closing=1970-01-03" in closed[0] and "EqualTo(metric_name,x)" in closed[0]
    logs = [line for line in found if re.search(r"/samples\]", line)]
    assert logs and all("sample_date" in line.partition("PartitionFilters")[2] for line in logs)
    # Of the log, the day itself; older days only of batches that are not covered, and none is.
    read = lake.raw("samples").filter((F.col("sample_date") > "1970-01-03") & (F.col("sample_date") <= "1970-01-04"))
    assert len(read.inputFiles()) >= 1
    late = indexes.instant_log(lake, 3 * DAY_MS + 1).filter("sample_date <= '1970-01-03'")
    assert sorted(r.sample_timestamp_ms for r in late.collect()) == [2 * DAY_MS], "the closing's own row"


def test_a_rerun_takes_its_closings_and_postings_back(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(0, 1, {"s": "a"}), gauge(0, 1, {"s": "gone"})])
    indexes.index_labels(lake)
    put(spark, lake, 1, [gauge(1, 2, {"s": "a"}), gauge(1, 2, {"s": "b"})])
    indexes.close_days(lake)
    indexes.index_labels(lake)
    put(spark, lake, 0, [gauge(DAY_MS, 3, {"s": "c"})])
    assert indexes.entries(lake, indexes.POSTINGS) == []
    for _ in range(2):
        assert [r[0] for r in latest(lake, 2 * DAY_MS)] == ["a", "b", "c"]
        found = lake.matched("x", [Matcher("s", "!=", "b")])
        assert sorted(r.labels["s"] for r in found.collect()) == ["a", "c"]
        indexes.index_labels(lake)


MATCHERS = [
    [("a", "=", "1")],
    [("a", "=", "")],
    [("a", "!=", "1")],
    [("a", "!=", "")],
    [("a", "=~", "1|2")],
    [("a", "=~", "1|")],
    [("a", "!~", "1|2")],
    [("a", "!~", ".+")],
    [("a", "=~", ".*"), ("b", "!=", "2")],
    [("a", "=", "1"), ("a", "!=", "1")],
    [("a", "!~", "3"), ("a", "!=", "2"), ("b", "=~", "[12]")],
    [("none", "=", ""), ("b", "=", "1")],
    [("none", "=~", ".+")],
]


@pytest.mark.parametrize("slot", [2, 4096])
def test_postings_match_as_label_maps_do(spark, tmp_path, monkeypatch, slot):
    monkeypatch.setattr(indexes, "SLOT_SERIES", slot)
    lake = Lake(spark, str(tmp_path / "lake"))
    every = [{k: v for k, v in (("a", a), ("b", b), ("c", str(i))) if v is not None} for i in range(2) for a in (None, "1", "2", "3") for b in (None, "", "1", "2")]
    for batch, part in enumerate((every[::2], every[1::3], every[::5], every)):
        put(spark, lake, batch, [gauge(1, 1, labels) for labels in part] + [gauge(1, 1, labels, name="y") for labels in every])
        if batch in (0, 2):
            assert indexes.index_labels(lake)
            assert not indexes.index_labels(lake)
    for conditions in MATCHERS:
        matchers = [Matcher(*c) for c in conditions]
        want = selector.match_labels(lake.series().filter("metric_name = 'x'"), matchers)
        got = lake.matched("x", matchers)
        assert sorted(r.labels_key for r in got.collect()) == sorted(r.labels_key for r in want.collect()), conditions


def test_matching_reads_postings_only(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(1, 1, {"s": "a", "t": str(i)}) for i in range(9)])
    indexes.index_labels(lake)
    found = scans(indexes.matched_ids(lake, "x", [Matcher("s", "=", "a"), Matcher("t", "!~", "[0-4]")]))
    assert found and all("/postings/" in line and "EqualTo(metric_name,x)" in line for line in found)
    series = [line for line in scans(lake.matched("x", [Matcher("s", "=", "a")])) if "/series" in line]
    assert series and all("labels:map" not in line for line in series)
    rows = indexes._all_postings(lake, indexes.entries(lake, indexes.POSTINGS)).collect()
    assert all(r.series_ids == sorted(r.series_ids) for r in rows)


def files(root):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_days_are_merged_one_by_one(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(0, 1), gauge(5, 2), gauge(DAY_MS, 3), gauge(3 * DAY_MS, 1)])
    put(spark, lake, 1, [gauge(5, 7), gauge(2 * DAY_MS, 4), gauge(3 * DAY_MS, 8)])
    before = files(tmp_path / "lake/samples")
    early = lake.log("samples")
    want = [(0, 1.0), (5, 7.0), (DAY_MS, 3.0), (2 * DAY_MS, 4.0), (3 * DAY_MS, 8.0)]

    def rows(frame):
        return sorted((r.sample_timestamp_ms, r.value) for r in frame.collect())

    first = compact_days(lake, [indexes.V.date_of(0)])
    assert days(first) == [0]
    # Between two days: the merged one counts once, the other one still holds both writes.
    assert rows(lake.samples()) == want
    assert rows(lake.log("samples")) == sorted([*want, (3 * DAY_MS, 1.0)])
    assert days(compact_days(lake)) == [3]
    assert compact_days(lake) == []
    assert rows(lake.log("samples")) == want == rows(lake.samples())
    assert before.items() <= files(tmp_path / "lake/samples").items(), "files of untouched days stay, others until sweep"
    assert rows(early) == sorted([*want, (5, 2.0), (3 * DAY_MS, 1.0)]), "an earlier reader keeps its files"
    sweep(lake)
    left = files(tmp_path / "lake/samples")
    assert not [f for f in left if "sample_date=1970-01-01/batch_id=0" in f]
    assert {f: t for f, t in before.items() if "1970-01-02" in f or "1970-01-03" in f}.items() <= left.items()
    assert rows(lake.log("samples")) == want
    put(spark, lake, 2, [gauge(5, 9), gauge(6, 1)])
    assert days(compact_days(lake)) == [0]
    assert rows(lake.log("samples")) == sorted([(0, 1.0), (5, 9.0), (6, 1.0), *want[2:]])
    assert prune(lake, 6) == 2
    assert rows(lake.samples()) == [(6, 1.0), *want[2:]]
    packed = compact(lake, str(tmp_path / "packed"))
    assert rows(packed.log("samples")) == rows(lake.samples())
    assert packed.merged_batches() == [(0, 2)]


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(0, 1)])
    put(spark, lake, 1, [gauge(0, 2)])
    lake.write("samples", lake.samples().withColumn("value", F.lit(99.0)), FIRST_MERGE)
    assert [r.value for r in lake.samples().collect()] == [2.0]
    assert days(compact_days(lake)) == [0]
    assert [r.value for r in lake.log("samples").collect()] == [2.0]
