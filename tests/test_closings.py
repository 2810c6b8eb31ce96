"""Closings and postings of many days and series: how many jobs and tasks make them, and what they hold."""

import random
import re

from build import gauge
from pyspark.sql import functions as F
from test_indexes import days, latest, put, random_rows

from scrapelake.operators.selector import latest_writes
from scrapelake.plans import indexes
from scrapelake.plans.lake import Lake
from scrapelake.plans.upkeep import prune
from scrapelake.schema import DAY_MS


def jobs(spark, name, run):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_days(spark, tmp_path):
    counts = []
    for n in (4, 8):
        lake = Lake(spark, str(tmp_path / f"lake{n}"))
        put(spark, lake, 0, [gauge(d * DAY_MS, d, {"s": "a"}) for d in range(n)])
        closed = jobs(spark, f"close {n}", lambda lake=lake: indexes.close_days(lake))
        hidden = jobs(spark, f"hide {n}", lambda lake=lake: indexes.prune(lake, DAY_MS))
        put(spark, lake, 1, [gauge(DAY_MS + 1, 9, {"s": "b"})])
        again = jobs(spark, f"again {n}", lambda lake=lake: indexes.close_days(lake))
        counts.append((closed, hidden, again))
        assert len(indexes.entries(lake, indexes.CLOSINGS)) == n
    assert counts[0] == counts[1]


def test_closings_hold_the_last_write_of_every_series(spark, tmp_path):
    rng = random.Random(5)
    lake = Lake(spark, str(tmp_path / "lake"))
    columns = ["series_id", "metric_name", "sample_timestamp_ms", "value", "value_repr", "scrape_id", "order_key"]

    def check():
        held = indexes.entries(lake, indexes.CLOSINGS)
        for entry in held:
            want = latest_writes(lake.log("samples").filter(F.col("sample_date") <= F.lit(entry.day)))
            got = indexes._closing(lake, entry)
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
        return days(e.day for e in held)

    put(spark, lake, 0, [r for r in random_rows(rng, 30) if r[4] // DAY_MS in (1, 2, 4)])
    indexes.close_days(lake, indexes.V.date_of(2 * DAY_MS))
    assert check() == [1, 2]
    # Days before, between and after, two of which are closed and one of which is to stay open.
    put(spark, lake, 1, random_rows(rng, 20) + [gauge(d * DAY_MS, d, {"s": "z"}) for d in range(6)])
    assert days(indexes.close_days(lake, indexes.V.date_of(4 * DAY_MS))) == [0, 1, 2, 3, 4]
    assert check() == [0, 1, 2, 3, 4]
    # Days that are only marked, and one after them.
    put(spark, lake, 2, [gauge(4 * DAY_MS + 1, 3, {"s": "s1"}), gauge(5 * DAY_MS + 1, 3, {"s": "s2"})])
    assert days(indexes.close_days(lake)) == [4, 5]
    assert check() == [0, 1, 2, 3, 4, 5]
    put(spark, lake, 3, random_rows(rng, 9))
    prune(lake, 2 * DAY_MS + 7)
    put(spark, lake, 4, [gauge(1, 8, {"s": "s1"}), gauge(3 * DAY_MS, 8, {"s": "new"})])
    indexes.close_days(lake)
    assert check() == [0, 2, 3, 4, 5]


def test_a_closing_may_be_empty(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(d * DAY_MS, d, {"s": "a"}) for d in range(3)])
    indexes.close_days(lake)
    prune(lake, DAY_MS + 5)
    assert days(indexes.close_days(lake)) == [1, 2]
    assert latest(lake, 2 * DAY_MS - 1) == [] == latest(lake, 2 * DAY_MS - 1, plain=True)
    assert [r[1] for r in latest(lake, 2 * DAY_MS)] == [2 * DAY_MS]
    prune(lake, 3 * DAY_MS)
    assert latest(lake, 9 * DAY_MS) == []


def test_series_of_one_metric_do_not_meet_in_one_task(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [gauge(1, 1, {"s": str(i)}) for i in range(5)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = indexes._lists(lake.series())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [metric_name" in text and "SortMergeJoin [metric_name" not in text
    # Only the counts are dealt by the metric alone.
    assert len(re.findall(r"Exchange hashpartitioning\(metric_name#\d+, \d+\)", text)) == 1
