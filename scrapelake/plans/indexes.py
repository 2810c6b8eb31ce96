"""Tables that spare a read most of the lake, and what they cover.

*Closings*: for a day, one row per series: its last write up to the end of that day. An instant then reads
one closing and the days after it, not the history of a metric.

*Postings*: for a metric, label and value, the sorted ids of the series that have it, in slots of at most
about ``SLOT_SERIES``. Matchers are answered by intersecting lists of ids; patterns run over label values,
and no label map is read.

Both are made from committed batches, and every entry records which ones. What an entry does not cover
is read beside it, so indexes may lag behind: late writes and batches that come after are found all
the same. A batch that is run again takes back the entries that cover it (``forget``). Entries are
files that never change; a reader keeps to those it found when its plan was made, and what was
superseded is removed by ``sweep``.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrapelake.functions import values as V
from scrapelake.operators.selector import Matcher, latest_writes_through
from scrapelake.schema import SAMPLES

if TYPE_CHECKING:
    from scrapelake.plans.lake import Lake

SLOT_SERIES = 4096
CLOSINGS, POSTINGS = "closings", "postings"
_ENTRIES = "index_entries"
_ENTRY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("folder", T.StringType()),
        T.StructField("covered", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("floor_ms", T.LongType()),
    ]
)
_CLOSING = T.StructType([f for f in SAMPLES.fields if f.name != "sample_date"])
_POSTING = T.StructType(
    [
        T.StructField("metric_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("series_ids", T.ArrayType(T.StringType())),
    ]
)

Ranges = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Entry:
    kind: str
    day: date | None
    folder: str
    covered: Ranges
    #: Rows below this time were pruned after the entry was made.
    floor_ms: int | None = None
    file: str = ""

    def covers(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for first, last in self.covered)


def joined_ranges(parts: Sequence[tuple[int, int]]) -> Ranges:
    """The same numbers as ranges that neither touch nor overlap."""
    joined: list[tuple[int, int]] = []
    for first, last in sorted(parts):
        if joined and first <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(joined[-1][1], last))
        else:
            joined.append((first, last))
    return tuple(joined)


def entries(lake: Lake, kind: str) -> list[Entry]:
    """Entries of a kind: one for each closed day, or for each generation of postings."""
    if not lake.partition_folders(_ENTRIES):
        return []
    schema = T.StructType([*_ENTRY.fields, T.StructField("entry", T.StringType())])
    # An entry that is withdrawn meanwhile counts as absent.
    stored = lake.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(lake.path(_ENTRIES))
    found = [
        Entry(r.kind, r.day, r.folder, tuple((a, b) for a, b in r.covered), r.floor_ms, f"entry={r.entry}")
        for r in stored.filter(F.col("kind") == kind).collect()
    ]
    return sorted(found, key=lambda e: (str(e.day), e.folder))


def _publish(lake: Lake, *made: Entry) -> None:
    """Makes entries visible, each by a file of one row and all in one job. They are the last thing
    written."""
    if not made:
        return
    rows = [
        F.struct(
            F.lit(e.kind).alias("kind"),
            F.lit(e.day).cast("date").alias("day"),
            F.lit(e.folder).alias("folder"),
            F.array(*[F.array(*map(F.lit, r)) for r in e.covered]).cast("array<array<bigint>>").alias("covered"),
            F.lit(e.floor_ms).cast("bigint").alias("floor_ms"),
            F.lit(uuid.uuid4().hex).alias("entry"),
        )
        for e in made
    ]
    (
        lake.spark.range(0, 1, numPartitions=1)
        .select(F.inline(F.array(*rows)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("entry")
        .parquet(lake.path(_ENTRIES))
    )


def _withdraw(lake: Lake, entry: Entry) -> None:
    lake.drop_partition(_ENTRIES, entry.file)


def forget(lake: Lake, batch_id: int) -> None:
    """Withdraws the entries that cover a batch which is about to be taken back. A generation of
    postings leaves out what earlier ones have, so they go together."""
    closings, postings = entries(lake, CLOSINGS), entries(lake, POSTINGS)
    gone = [e for e in closings if e.covers(batch_id)]
    for entry in gone + (postings if any(e.covers(batch_id) for e in postings) else []):
        _withdraw(lake, entry)


def prune(lake: Lake, cutoff_ms: int) -> None:
    """Hides what a prune removes: closings before its day go, later ones get a floor."""
    boundary = V.date_of(cutoff_ms)
    held = entries(lake, CLOSINGS)
    early = [e for e in held if e.day < boundary]
    lower = [e for e in held if e.day >= boundary and (e.floor_ms is None or e.floor_ms < cutoff_ms)]
    _publish(lake, *(replace(e, floor_ms=cutoff_ms) for e in lower))
    for entry in early + lower:
        _withdraw(lake, entry)


def sweep(lake: Lake) -> None:
    """Removes the folders that no entry names, once no reader of older entries is left."""
    for kind in (CLOSINGS, POSTINGS):
        named = {e.folder for e in entries(lake, kind)}
        for folder in lake.partition_folders(kind):
            if folder not in named:
                lake.drop_partition(kind, folder)


def _outside(covered: Ranges) -> Column:
    """Rows of batches that are not covered. The column is a partition, so others are not read."""
    batch = F.col("batch_id")
    return ~reduce(Column.__or__, [batch.between(a, b) for a, b in covered], F.lit(False))


def _covered_with_merges(lake: Lake, covered: Ranges) -> Ranges:
    """With the day merges whose batches are all covered."""
    more = [
        (merge, merge)
        for merge, batches in lake.day_merges().items()
        if all(any(a <= b <= z for a, z in covered) for b in batches)
    ]
    return joined_ranges([*covered, *more])


# Closings


def _closing(lake: Lake, entry: Entry) -> DataFrame:
    rows = lake.spark.read.schema(_CLOSING).parquet(f"{lake.path(CLOSINGS)}/{entry.folder}")
    if entry.floor_ms is not None:
        rows = rows.filter(F.col("sample_timestamp_ms") >= entry.floor_ms)
    return rows.withColumn("sample_date", V.sample_date(F.col("sample_timestamp_ms"))).select(
        *SAMPLES.fieldNames()
    )


def instant_log(lake: Lake, at_ms: int) -> DataFrame:
    """A write log with the same latest sample of every series at ``at_ms`` as the whole one: the last
    closing before that day, the days since, and older days only of batches the closing does not
    cover. Without a closing, the whole log."""
    day = V.date_of(at_ms)
    before = [e for e in entries(lake, CLOSINGS) if e.day < day]
    log = lake.log("samples")
    if not before:
        return log
    entry = before[-1]
    closed = F.col("sample_date") <= F.lit(entry.day)
    late = _outside(_covered_with_merges(lake, entry.covered))
    columns = SAMPLES.fieldNames()
    return (
        _closing(lake, entry)
        .unionByName(log.filter(~closed).select(*columns))
        .unionByName(log.filter(closed & late).select(*columns))
    )


def close_days(lake: Lake, through: date | None = None) -> list[date]:
    """Brings the closings of all days with samples, up to ``through``, up to date; returns the days
    that were written.

    A day is closed from the closing of the day before it and its own part of the log. A closing that
    lags is merged with the rows of the batches it does not cover, and written only if any of them
    lies in its days; else it is only marked as covering them. All days are written in one job: what
    is read for one of them counts for the later ones too, so no day waits for another.
    """
    committed = lake.committed()
    now = joined_ranges([(b, b) for b in committed])
    # Listed after the commits, so every day of a committed batch is among them.
    lake_days = [date.fromisoformat(f.partition("=")[2]) for f in lake.partition_folders("samples")]
    days = sorted(d for d in lake_days if through is None or d <= through)
    held = {e.day: e for e in entries(lake, CLOSINGS)}
    kept: dict[date, Entry] = {}
    written: list[date] = []
    bases: list[Entry] = []
    spans: list[tuple[date | None, date]] = []
    late_through: dict[tuple[int, ...], date] = {}
    previous: date | None = None
    for day in sorted({*days, *(d for d in held if through is None or d <= through)}):
        old = held.get(day)
        if old is None:
            if spans and spans[-1][1] == previous:
                spans[-1] = (spans[-1][0], day)
            else:
                spans.append((previous, day))
            if previous in kept:
                bases.append(kept[previous])
            written.append(day)
        elif old.covered == now and old.floor_ms is None:
            kept[day] = old
        else:
            covered = _covered_with_merges(lake, old.covered)
            late = [b for b in committed if not any(a <= b <= z for a, z in covered)]
            if old.floor_ms is None and not lake.has_rows(late, day):
                kept[day] = replace(old, covered=now)
            else:
                late_through[tuple(late)] = day
                bases.append(old)
                written.append(day)
        previous = day
    marked = [e for d, e in kept.items() if e is not held[d]]
    made: list[Entry] = []
    if written:
        on = F.col("sample_date")
        parts = [on <= F.lit(last) if after is None else (on > F.lit(after)) & (on <= F.lit(last)) for after, last in spans]
        parts += [(on <= F.lit(last)) & F.col("batch_id").isin(list(late)) for late, last in late_through.items()]
        log = lake.log("samples").filter(F.col("batch_id").isin(committed))
        log = log.filter(reduce(Column.__or__, parts, F.lit(False))).select(*SAMPLES.fieldNames())
        made = [
            Entry(CLOSINGS, day, folder, now)
            for day, folder in zip(written, _write_closings(lake, written, log, bases, lake_days), strict=True)
        ]
    _publish(lake, *marked, *made)
    for entry in marked + made:
        if entry.day in held:
            _withdraw(lake, held[entry.day])
    return written


def _write_closings(
    lake: Lake, written: list[date], log: DataFrame, bases: Sequence[Entry], log_days: Sequence[date]
) -> list[str]:
    """Closings of the days ``written`` from rows of the log and earlier closings, each in a folder of
    its own; a row counts from the first of these days that is not before its own."""
    places = [
        F.struct(F.lit(d).alias("sample_date"), F.lit(bisect_left(written, d)).alias("place"))
        for d in log_days
        if d <= written[-1]
    ]
    rows = log.withColumn("place", F.lit(0)).limit(0)
    if places:
        placed = lake.spark.range(0, 1, numPartitions=1).select(F.inline(F.array(*places)))
        rows = log.join(F.broadcast(placed), "sample_date")
    for entry in bases:
        rows = rows.unionByName(_closing(lake, entry).withColumn("place", F.lit(bisect_left(written, entry.day))))
    names = [f"{day.isoformat()}-{uuid.uuid4().hex}" for day in written]
    closing = F.array(*map(F.lit, names))[F.col("place")].alias("closing")
    (
        latest_writes_through(rows, "place", len(written))
        .select(*_CLOSING.fieldNames(), closing)
        .hint("rebalance", "closing")
        .sortWithinPartitions("closing", "metric_name", "series_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("closing")
        .parquet(lake.path(CLOSINGS))
    )
    folders = [f"closing={name}" for name in names]
    # A closing without rows has no folder yet.
    for folder in set(folders).difference(lake.partition_folders(CLOSINGS)):
        lake.spark.createDataFrame([], _CLOSING).write.parquet(f"{lake.path(CLOSINGS)}/{folder}")
    return folders


# Postings


def index_labels(lake: Lake) -> bool:
    """Adds a generation of postings for the series that no earlier one has; returns whether there
    were batches to look at. An id that is later pruned stays in its lists and meets no series."""
    committed = lake.committed()
    held = entries(lake, POSTINGS)
    covered = joined_ranges([r for e in held for r in e.covered])
    late = [b for b in committed if not any(a <= b <= z for a, z in covered)]
    if not late:
        return False
    series = lake.log("series").filter(F.col("batch_id").isin(late))
    series = series.groupBy("series_id", "metric_name", "labels_key").agg(F.first("labels").alias("labels"))
    if held:
        known = _all_postings(lake, held).filter("name = ''").select(F.explode("series_ids").alias("series_id"))
        series = series.join(known, "series_id", "left_anti")
    lists = _lists(series)
    folder = f"generation={len(held):06d}-{uuid.uuid4().hex}"
    lists.select(*_POSTING.fieldNames()).hint("rebalance").sortWithinPartitions(
        "metric_name", "name", "value"
    ).write.parquet(f"{lake.path(POSTINGS)}/{folder}")
    _publish(lake, Entry(POSTINGS, None, folder, joined_ranges([(b, b) for b in late])))
    return True


def _lists(series: DataFrame) -> DataFrame:
    """Postings of the series of one generation."""
    # One row per metric. Unless it is sent to all tasks, the series of a metric meet in one.
    slots = series.groupBy("metric_name").agg(F.ceil(F.count(F.lit(1)) / SLOT_SERIES).alias("slots"))
    everyone = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    items = F.concat(everyone, F.map_entries("labels"))
    rows = series.join(F.broadcast(slots), "metric_name").select(
        "metric_name",
        "series_id",
        F.pmod(F.xxhash64("series_id"), F.col("slots")).alias("slot"),
        F.inline(items).alias("name", "value"),
    )
    # A list holds at most the series of its slot.
    return rows.groupBy("metric_name", "name", "value", "slot").agg(
        F.array_sort(F.collect_list("series_id")).alias("series_ids")
    )


def _all_postings(lake: Lake, held: list[Entry]) -> DataFrame:
    parts = [
        lake.spark.read.schema(_POSTING).parquet(f"{lake.path(POSTINGS)}/{e.folder}").withColumn("generation", F.lit(i))
        for i, e in enumerate(held)
    ]
    return reduce(DataFrame.unionByName, parts)


def posted_ids(postings: DataFrame, metric: str, matchers: Sequence[Matcher]) -> DataFrame:
    """``series_id`` of the series of a metric on which every matcher holds.

    A matcher that fails on the empty value keeps the ids listed under the values it holds on. One
    that holds on it, and so on series without the label, removes the ids listed under the values it
    fails on. All lists of a slot are met in one row.
    """
    names = sorted({m.name for m in matchers})
    sure = [i for i, m in enumerate(matchers) if m.operator == "=" and m.value != ""]
    rows = postings.filter(
        (F.col("metric_name") == metric) & F.col("name").isin(*names, *([] if sure else [""]))
    )
    empty = [m.holds(F.lit("")) for m in matchers]

    def ids(test: Column) -> Column:
        return F.flatten(F.collect_list(F.when(test, F.col("series_ids"))))

    listed = [
        ids((F.col("name") == m.name) & (m.holds(F.col("value")) != none)).alias(f"m{i}")
        for i, (m, none) in enumerate(zip(matchers, empty, strict=True))
    ]
    slots = rows.groupBy("generation", "slot").agg(ids(F.col("name") == "").alias("every"), *listed)
    kept = F.col(f"m{sure[0]}") if sure else F.col("every")
    for i, none in enumerate(empty):
        own = F.col(f"m{i}")
        kept = F.when(none, F.array_except(kept, own)).otherwise(F.array_intersect(kept, own))
    return slots.select(F.explode(kept).alias("series_id"))


def matched_ids(lake: Lake, metric: str, matchers: Sequence[Matcher]) -> DataFrame | None:
    """Ids that the postings give, with those of batches that they do not cover, whose label maps
    are looked at; None without postings."""
    held = entries(lake, POSTINGS)
    if not held or not matchers:
        return None
    found = posted_ids(_all_postings(lake, held), metric, matchers)
    covered = joined_ranges([r for e in held for r in e.covered])
    if all(any(a <= b <= z for a, z in covered) for b in lake.committed()):
        return found
    late = lake.log("series").filter((F.col("metric_name") == metric) & _outside(covered))
    tests = reduce(Column.__and__, [m.column() for m in matchers])
    return found.unionByName(late.filter(tests).select("series_id"))
