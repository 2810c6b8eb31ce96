"""Retention and compaction. Both run only when called."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrapelake.functions.values import date_of
from scrapelake.operators.activity import active_days, bit_of, days_after, days_through
from scrapelake.operators.upsert import last_writes
from scrapelake.plans import indexes
from scrapelake.plans.indexes import joined_ranges
from scrapelake.plans.lake import COMPACTED, FIRST_MERGE, FIRST_OWN, Lake
from scrapelake.session import discard, materialize


def cutoff(
    *, now_ms: int | None = None, older_than_ms: int | None = None, before_ms: int | None = None
) -> int:
    """Retention boundary from an age or an instant: exactly one of the two."""
    if (older_than_ms is None) == (before_ms is None):
        raise ValueError("give exactly one of older_than_ms and before_ms")
    if before_ms is not None:
        return before_ms
    if now_ms is None or older_than_ms <= 0:
        raise ValueError("older_than_ms must be positive and needs now_ms")
    return now_ms - older_than_ms


def split_by_cutoff(samples: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """Samples to remove and samples to keep; the cutoff itself is kept."""
    ts = F.col("sample_timestamp_ms")
    return samples.filter(ts < cutoff_ms), samples.filter(ts >= cutoff_ms)


def without_orphans(series: DataFrame, samples: DataFrame) -> DataFrame:
    """Series that still have a sample. Reducing the samples to their series first keeps a
    hot series at one row per task."""
    return series.join(samples.select("series_id").distinct(), "series_id", "left_semi")


def _aside(lake: Lake, name: str) -> str:
    return f"{lake.root.rstrip('/')}/_{name}-{uuid.uuid4().hex}"


def _replace(lake: Lake, table: str, rows: DataFrame, keep: Column, batches: list[str], *parents: str) -> None:
    """Leaves those of ``rows``, which are all rows of the partitions ``batches``, for which
    ``keep`` holds.

    They are written aside first, since a table cannot replace what it is being read from.
    Batches left without a row are dropped by name. Only the listed ones are, so a batch
    that is written meanwhile stays as it is.
    """
    scratch = _aside(lake, "kept")
    try:
        aside = materialize(rows.filter(keep), scratch)
        lake.write(table, aside, None)
        left = {f"batch_id={r.batch_id}" for r in aside.select("batch_id").distinct().collect()}
        for folder in batches:
            if folder not in left:
                lake.drop_partition(table, *parents, folder)
    finally:
        discard(lake.spark, scratch)


def _batch(folder: str) -> int:
    return int(folder.partition("=")[2])


def prune(lake: Lake, cutoff_ms: int, counted: bool = True) -> int | None:
    """Deletes samples older than the cutoff and series left without samples; returns the
    number of current samples deleted, unless ``counted`` is false: counting has to find the
    last write of all that is deleted.

    Whole days are dropped as folders, found by listing. Only the day of the cutoff is
    rewritten, and of the series only the batches that have one of the deleted samples' series
    without any other sample. Which series that are is told by the days stored with each batch, so
    no sample after the day of the cutoff is read. Every batch stores the series of its own samples, so a
    batch that is written meanwhile keeps its series. A prune that broke off can be run again: the
    stored days are the last to be renewed.
    """
    indexes.prune(lake, cutoff_ms)
    day, ts = F.col("sample_date"), F.col("sample_timestamp_ms")
    boundary = date_of(cutoff_ms)
    boundary_folder = f"sample_date={boundary.isoformat()}"
    days = lake.partition_folders("samples")
    edges = lake.partition_folders("samples", boundary_folder) if boundary_folder in days else []
    batches = lake.partition_folders("series")
    early = lake.log("samples").filter(day <= F.lit(boundary))
    deleted = split_by_cutoff(last_writes(early), cutoff_ms)[0].count() if counted else None
    scratch = _aside(lake, "series")
    try:
        old = lake.days_by_batch().filter(days_through(boundary) != 0)
        touched = materialize(old.select("series_id").distinct(), scratch)
        if edges:
            edge = lake.raw("samples").filter(day == F.lit(boundary))
            edge = edge.filter(F.col("batch_id").isin([_batch(b) for b in edges]))
            _replace(lake, "samples", edge, ts >= cutoff_ms, edges, boundary_folder)
        for folder in days:
            # ISO dates of four-digit years sort as text.
            if folder < boundary_folder:
                lake.drop_partition("samples", folder)
        _drop_orphans(lake, touched, boundary, batches)
        _forget_days(lake, boundary)
    finally:
        discard(lake.spark, scratch)
    return deleted


def _drop_orphans(lake: Lake, touched: DataFrame, boundary: date, batches: list[str]) -> None:
    """Removes those of the touched series that have no sample left: none on the boundary day, and
    no day after it."""
    kept = lake.raw("samples").filter(F.col("sample_date") == F.lit(boundary)).select("series_id").distinct()
    later = lake.days_by_batch().filter(days_after(boundary) != 0).select("series_id")
    scratch = _aside(lake, "orphans")
    try:
        # Stored, since they are read twice and, being few as a rule, are then sent to the tasks.
        orphans = materialize(touched.join(kept.unionByName(later), "series_id", "left_anti"), scratch)
        listed = lake.raw("series").filter(F.col("batch_id").isin([_batch(b) for b in batches]))
        held = {r.batch_id for r in listed.join(orphans, "series_id", "left_semi").select("batch_id").distinct().collect()}
        if held:
            marked = listed.join(orphans.withColumn("orphan", F.lit(True)), "series_id", "left")
            rows = marked.filter(F.col("batch_id").isin(list(held)))
            names = [b for b in batches if _batch(b) in held]
            _replace(lake, "series", rows, F.col("orphan").isNull(), names)
    finally:
        discard(lake.spark, scratch)


def _forget_days(lake: Lake, boundary: date) -> None:
    """Clears the days before the boundary, and the boundary's where a batch has no sample of the
    series left on it. Only batches that have such days are rewritten."""
    names = lake.partition_folders("activity")
    listed = lake.raw("activity").filter(F.col("batch_id").isin([_batch(b) for b in names]))
    stale = {r.batch_id for r in listed.filter(days_through(boundary) != 0).select("batch_id").distinct().collect()}
    if not stale:
        return
    kept = lake.raw("samples").filter(F.col("sample_date") == F.lit(boundary))
    kept = kept.select("series_id", "batch_id").distinct().withColumn("kept", F.lit(True))
    here, bit = bit_of(boundary)
    own = F.when(here & F.col("kept"), F.lit(bit)).otherwise(F.lit(0)).cast("bigint")
    rows = listed.filter(F.col("batch_id").isin(list(stale))).join(kept, ["series_id", "batch_id"], "left")
    rows = rows.withColumn("days", days_after(boundary).bitwiseOR(own))
    _replace(lake, "activity", rows, F.col("days") != 0, [b for b in names if _batch(b) in stale])


def compacted(samples: DataFrame) -> DataFrame:
    """Samples in storage order, in ranges of even size. The time is part of the range key,
    so one series may span many tasks."""
    keys = ["sample_date", "metric_name", "series_id", "sample_timestamp_ms"]
    return samples.repartitionByRange(*keys).sortWithinPartitions(*keys)


def compact(lake: Lake, new_root: str) -> Lake:
    """A lake with the same current content in a new folder, without overwritten samples.

    The old folder is left as it is; the caller switches over. What is merged gets a batch
    number that no ingest has, and its commit tells which committed batches it holds. So a stream
    can go on with the new lake, a replay of its last batch changes nothing, and a batch that had
    failed before can still be stored.
    """
    target = Lake(lake.spark, new_root)
    commits = [r.batch_id for r in lake.raw("commits").select("batch_id").distinct().collect()]
    if not commits:
        return target
    merged = joined_ranges(lake.merged_batches() + [(x, x) for x in commits if x >= FIRST_OWN])
    batch = F.lit(COMPACTED).cast("bigint")
    (
        compacted(lake.samples().withColumn("batch_id", batch))
        .write.partitionBy(*lake.partitions("samples"))
        .parquet(target.path("samples"))
    )
    first = lake.log("series").groupBy("series_id").agg(F.min("order_key").alias("order_key"))
    target.write("series", lake.series().join(first, "series_id"), COMPACTED)
    target.write("activity", lake.activity(), COMPACTED)
    for table in ("scrapes", "metadata", "landed"):
        target.write(table, lake.log(table).drop("batch_id"), COMPACTED)
    target.write("pending", lake.pending(), COMPACTED)
    target.commit(COMPACTED, merged)
    return target


def compact_days(lake: Lake, days: Sequence[date] | None = None) -> list[date]:
    """Merges, in place, the days whose rows lie in several batches; returns those days.

    All days are rewritten in one job, each as a batch of its own, and then published one by one: the
    commit of a day's batch names the ones it replaces on that day. A reader finds either the batches or the merged day. Days of
    one batch are not touched. The replaced files stay until ``sweep``, for readers that have found
    them. A replay of a batch with a merged day is left alone, as after ``compact``.
    """
    committed = set(lake.committed())
    gone = _replaced(lake)
    free = max([b + 1 for b in committed if FIRST_MERGE <= b < FIRST_OWN], default=FIRST_MERGE)
    plan: dict[date, tuple[int, list[int]]] = {}
    for folder in sorted(lake.partition_folders("samples")):
        day = date.fromisoformat(folder.partition("=")[2])
        own = [_batch(b) for b in lake.partition_folders("samples", folder)]
        own = sorted(b for b in own if b in committed and (day, b) not in gone)
        if len(own) > 1 and (days is None or day in days):
            lake.begin(free)
            plan[day] = (free, own)
            free += 1
    if not plan:
        return []
    pairs = [(day, b, merge) for day, (merge, own) in plan.items() for b in own]
    chosen = F.broadcast(lake.spark.createDataFrame(pairs, "sample_date date, batch_id bigint, merge_id bigint"))
    # The days are repeated as a filter, since they prune the listing and the scan.
    log = lake.log("samples").filter(F.col("sample_date").isin(list(plan)))
    current = last_writes(log.join(chosen.drop("merge_id"), ["sample_date", "batch_id"], "left_semi"))
    target = chosen.select("sample_date", F.col("merge_id").alias("batch_id")).distinct()
    lake.write("samples", current.join(F.broadcast(target), "sample_date"), None)
    merges = [merge for merge, _ in plan.values()]
    stored = lake.raw("samples").filter(F.col("sample_date").isin(list(plan)) & F.col("batch_id").isin(merges))
    lake.write("activity", active_days(stored, "batch_id"), None)
    for day, (merge, own) in plan.items():
        lake.commit(merge, joined_ranges([(b, b) for b in own if b >= FIRST_OWN]), (day, own))
    return list(plan)


def _replaced(lake: Lake) -> set[tuple[date, int]]:
    """Days and batches whose rows merged days hold."""
    if not lake.day_merges():
        return set()
    pairs = lake.raw("commits").select("replaced_day", F.explode("replaced").alias("batch_id"))
    return {(r.replaced_day, r.batch_id) for r in pairs.collect()}


def sweep(lake: Lake) -> None:
    """Removes files that are superseded by merged days and newer indexes. To be called once readers
    that started before are done."""
    for day, batch in _replaced(lake):
        lake.drop_partition("samples", f"sample_date={day.isoformat()}", f"batch_id={batch}")
    indexes.sweep(lake)
