"""Days of series as bitmaps: what they say, and that a prune goes by them."""

import glob
import random
from datetime import date, timedelta

import pytest
from build import gauge, samples
from pyspark.sql import functions as F

from scrapelake.operators import upsert
from scrapelake.operators.activity import active_days, day_spans, days_after, days_through, merged_days
from scrapelake.plans import upkeep
from scrapelake.plans.lake import Lake
from scrapelake.plans.upkeep import compact, compact_days, prune, sweep
from scrapelake.schema import DAY_MS

EPOCH = date(1970, 1, 1)


def put(spark, lake, batch_id, rows, noted=True):
    table = samples(spark, rows).withColumn("order_key", F.col("order_key") + batch_id * 1000)
    lake.begin(batch_id)
    if noted:
        lake.write("activity", active_days(table), batch_id)
    lake.write("samples", table, batch_id)
    lake.write("series", upsert.first_series(table), batch_id)
    lake.commit(batch_id)


def at(day, label, offset=0):
    return gauge(day * DAY_MS + offset, 1, {"s": label})


def unpacked(activity, series):
    """(label, day) pairs."""
    names = {r.series_id: r.labels["s"] for r in series.collect()}
    rows = activity.collect()
    return {(names.get(r.series_id, "?"), r.block * 32 + i) for r in rows for i in range(32) if r.days >> i & 1}


def stored_days(lake):
    names = {r.series_id: r.labels["s"] for r in lake.series().collect()}
    rows = lake.log("samples").select("series_id", "sample_date").distinct().collect()
    return {(names.get(r.series_id, "?"), (r.sample_date - EPOCH).days) for r in rows}


def exact(lake):
    assert unpacked(lake.activity(), lake.series()) == stored_days(lake)
    assert {s for s, _ in stored_days(lake)} == {r.labels["s"] for r in lake.series().collect()}


DAYS = [-65, -33, -32, -1, 0, 1, 30, 31, 32, 63, 64, 100]


def test_bitmaps_hold_every_day(spark):
    table = samples(spark, [at(d, "a", o) for d in DAYS for o in (0, 9)] + [at(31, "b")])
    found = merged_days(active_days(table).unionByName(active_days(table)))
    series = upsert.first_series(table)
    assert unpacked(found, series) == {("a", d) for d in DAYS} | {("b", 31)}
    spans = sorted((r.first_day, r.last_day, r.n_days) for r in day_spans(found).collect())
    assert spans == [(-65, 100, len(DAYS)), (31, 31, 1)]
    for cut in (-66, -32, -1, 0, 31, 32, 100):
        day = EPOCH + timedelta(days=cut)
        early = unpacked(found.withColumn("days", days_through(day)), series)
        late = unpacked(found.withColumn("days", days_after(day)), series)
        assert early == {("a", d) for d in DAYS if d <= cut} | ({("b", 31)} if cut >= 31 else set())
        assert early.isdisjoint(late) and len(early | late) == len(DAYS) + 1
    assert active_days(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3])
def test_days_stay_exact(spark, tmp_path, seed):
    rng = random.Random(seed)

    def some(n):
        return [at(rng.randrange(28, 36), f"s{rng.randrange(9)}", rng.choice([0, 500, DAY_MS - 1])) for _ in range(n)]

    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, some(14))
    put(spark, lake, 1, some(14), noted=False)
    exact(lake)
    prune(lake, 30 * DAY_MS + 300, counted=False)
    exact(lake)
    put(spark, lake, 2, some(9))
    compact_days(lake)
    sweep(lake)
    exact(lake)
    prune(lake, 32 * DAY_MS, counted=False)
    exact(lake)
    put(spark, lake, 3, some(9))
    put(spark, lake, 3, some(4))
    prune(lake, 29 * DAY_MS + 1, counted=False)
    exact(lake)
    prune(lake, 34 * DAY_MS + 400, counted=False)
    exact(lake)
    exact(compact(lake, str(tmp_path / "packed")))


def test_a_prune_reads_no_later_day(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [at(1, "old"), at(1, "kept"), at(2, "edge", 5), at(2, "gone", 4), at(3, "kept"), at(4, "new")])
    put(spark, lake, 1, [at(2, "edge", 3), at(4, "kept")])
    files = [f for d in (3, 4) for f in glob.glob(f"{lake.root}/samples/sample_date={EPOCH + timedelta(days=d)}/*/*")]
    whole = {f: open(f, "rb").read() for f in files if f.endswith(".parquet")}
    assert len(whole) == 3
    for f in whole:
        with open(f, "wb") as out:
            out.write(b"no table")
    assert prune(lake, 2 * DAY_MS + 5) == 4
    assert sorted(r.labels["s"] for r in lake.series().collect()) == ["edge", "kept", "new"]
    for f, content in whole.items():
        with open(f, "wb") as out:
            out.write(content)
    exact(lake)


def test_a_prune_that_broke_off_is_run_again(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(spark, lake, 0, [at(1, "old"), at(2, "edge", 1), at(9, "new")])

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(upkeep, "_drop_orphans", broken)
        with pytest.raises(RuntimeError):
            prune(lake, 2 * DAY_MS + 5)
    assert sorted(r.labels["s"] for r in lake.series().collect()) == ["edge", "new", "old"]
    prune(lake, 2 * DAY_MS + 5)
    assert [r.labels["s"] for r in lake.series().collect()] == ["new"]
    exact(lake)
