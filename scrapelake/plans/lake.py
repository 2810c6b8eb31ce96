"""The stored tables, as plain Parquet folders.

``samples`` is a write log partitioned by day and batch; ``series``, ``activity``, ``metadata`` and
``scrapes`` are partitioned by batch. A batch that is run again first takes back its commit and
all that it wrote before, in every table and day, so nothing of the earlier run is left. Readers
see a batch only once its row in ``commits`` is there.

Every batch writes the series it met, known or not, so no batch leans on another one; readers take
a series' family and type from its first write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from scrapelake.operators import accounting, selector, views
from scrapelake.operators.activity import active_days, merged_days
from scrapelake.operators.upsert import last_writes, resolved_series
from scrapelake.plans import indexes
from scrapelake.schema import ACTIVITY, LANDED, METADATA, PENDING, SAMPLES, SCRAPES, SERIES

_BATCH = T.StructField("batch_id", T.LongType())
_TABLES = {
    "samples": SAMPLES,
    "series": T.StructType(SERIES.fields + [T.StructField("order_key", T.LongType())]),
    "activity": ACTIVITY,
    "metadata": METADATA,
    "scrapes": SCRAPES,
    "pending": PENDING,
    "landed": LANDED,
    "commits": T.StructType(
        [
            T.StructField("committed", T.BooleanType()),
            T.StructField("through", T.LongType()),
            T.StructField("merged", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("replaced_day", T.DateType()),
            T.StructField("replaced", T.ArrayType(T.LongType())),
        ]
    ),
}
#: The batch that holds what compaction has merged; no ingest has it. Its commit tells which
#: batches, as ranges, so that a replay of one of those is known to be stored already.
COMPACTED = -(1 << 62)
#: Batches from here to ``FIRST_OWN`` hold one merged day each. Their commit names the batches whose
#: rows of that day they replace.
FIRST_MERGE, FIRST_OWN = COMPACTED + 1, COMPACTED + (1 << 40)
PARTITIONS = {"samples": ["sample_date", "batch_id"]}


@dataclass(frozen=True)
class Lake:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def partitions(self, table: str) -> list[str]:
        return PARTITIONS.get(table, ["batch_id"])

    def raw(self, table: str) -> DataFrame:
        """All stored rows of a table, of committed batches or not."""
        schema = T.StructType(_TABLES[table].fields + [_BATCH])
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self, table: str) -> DataFrame:
        """Rows of committed batches, each in one place. The commits are listed before the rows, so
        every batch and merged day that counts has its files among those found."""
        commits = self.raw("commits")
        merges = table == "samples" and any(FIRST_MERGE <= b < FIRST_OWN for b in self.committed())
        rows = self.raw(table).join(commits.select("batch_id"), "batch_id", "left_semi")
        if merges:
            gone = commits.select(F.col("replaced_day").alias("sample_date"), F.explode("replaced").alias("batch_id"))
            rows = rows.join(gone, ["sample_date", "batch_id"], "left_anti")
        return rows

    def committed(self) -> list[int]:
        """Numbers of the committed batches, by listing."""
        return sorted(int(f.partition("=")[2]) for f in self.partition_folders("commits"))

    def day_merges(self) -> dict[int, list[int]]:
        """The batches that each merged day replaces."""
        if not any(FIRST_MERGE <= b < FIRST_OWN for b in self.committed()):
            return {}
        rows = self.raw("commits").filter("replaced IS NOT NULL").select("batch_id", "replaced").collect()
        return {r.batch_id: r.replaced for r in rows}

    def has_rows(self, batches: Sequence[int], through: date) -> bool:
        """Whether any of the batches has samples on a day up to ``through``, by listing."""
        names = {f"batch_id={b}" for b in batches}
        for folder in self.partition_folders("samples") if names else ():
            if date.fromisoformat(folder.partition("=")[2]) <= through:
                if not names.isdisjoint(self.partition_folders("samples", folder)):
                    return True
        return False

    def samples(self) -> DataFrame:
        """Current samples: the last write of every series and timestamp. Filters on the
        metric, series, time and day pass through to the scan."""
        return last_writes(self.log("samples"))

    def series(self) -> DataFrame:
        """Current series. A filter on the metric passes through to the scan."""
        return resolved_series(self.log("series"))

    def days_by_batch(self) -> DataFrame:
        """The days of every series in each batch. Committed batches that have none stored, as
        those of older lakes, are looked up in the series and day columns of their samples."""
        noted = {int(f.partition("=")[2]) for f in self.partition_folders("activity")}
        rows = self.raw("activity")
        bare = [b for b in self.committed() if b not in noted]
        if bare:
            own = self.raw("samples").filter(F.col("batch_id").isin(bare))
            rows = rows.unionByName(active_days(own, "batch_id"))
        return rows

    def activity(self) -> DataFrame:
        """The days of every series, over the committed batches."""
        commits = self.raw("commits").select("batch_id")
        return merged_days(self.days_by_batch().join(commits, "batch_id", "left_semi"))

    def matched(self, metric: str, matchers: Sequence[selector.Matcher]) -> DataFrame:
        """Current series of a metric on which every matcher holds, by the postings if there are
        any and else by the label maps."""
        return self._matched(metric, matchers)[0]

    def _matched(self, metric: str, matchers: Sequence[selector.Matcher]) -> tuple[DataFrame, DataFrame]:
        """The matched series, and ids that hold all of theirs. The postings' ids filter the stored
        series before these are aggregated; some may belong to series that were pruned."""
        ids = indexes.matched_ids(self, metric, matchers)
        if ids is None:
            series = selector.match_labels(self.series().filter(F.col("metric_name") == metric), matchers)
            return series, series.select("series_id")
        log = self.log("series").filter(F.col("metric_name") == metric)
        return resolved_series(log.join(ids, "series_id", "left_semi")), ids

    def instant(
        self, metric: str, matchers: Sequence[selector.Matcher] = (), *, at_ms: int, max_age_ms: int | None = None
    ) -> DataFrame:
        """Latest sample of every matching series. The matched series filter the write log before
        anything is aggregated, and the latest write is found in the same aggregate as the
        latest sample, so the history of other series is not shuffled and none is deduplicated.
        Where a day before is closed, only what came after it is read."""
        series, ids = self._matched(metric, matchers)
        samples = indexes.instant_log(self, at_ms).filter(F.col("metric_name") == metric)
        if matchers:
            samples = samples.join(ids, "series_id", "left_semi")
        return selector.instant(series, samples, metric, at_ms=at_ms, max_age_ms=max_age_ms)

    def range_samples(
        self, metric: str, matchers: Sequence[selector.Matcher] = (), *, at_ms: int, range_ms: int
    ) -> DataFrame:
        """Samples of the matching series in a window; only their writes in it are deduplicated."""
        series, ids = self._matched(metric, matchers)
        samples = self.log("samples").filter(F.col("metric_name") == metric)
        if matchers:
            samples = samples.join(ids, "series_id", "left_semi")
        return selector.range_samples(series, last_writes(samples), metric, at_ms=at_ms, range_ms=range_ms)

    def histogram_view(
        self, family: str, matchers: Sequence[selector.Matcher] = (), *, at_ms: int, range_ms: int | None = None, strict: bool = True
    ) -> DataFrame:
        samples = indexes.instant_log(self, at_ms) if range_ms is None else self.samples()
        return views.histogram_view(
            self.series(), samples, family, matchers, at_ms=at_ms, range_ms=range_ms, strict=strict
        )

    def summary_view(
        self, family: str, matchers: Sequence[selector.Matcher] = (), *, at_ms: int, range_ms: int | None = None, strict: bool = True
    ) -> DataFrame:
        samples = indexes.instant_log(self, at_ms) if range_ms is None else self.samples()
        return views.summary_view(
            self.series(), samples, family, matchers, at_ms=at_ms, range_ms=range_ms, strict=strict
        )

    def metadata(self) -> DataFrame:
        last = W.partitionBy("system", "module", "family_name").orderBy(
            F.col("order_key").desc()
        )
        ranked = self.log("metadata").withColumn("place", F.row_number().over(last))
        return ranked.filter("place = 1").select(*METADATA.fieldNames()[:-1])

    def scrapes(self) -> DataFrame:
        return self.log("scrapes").select(*SCRAPES.fieldNames())

    def runs(self, context: DataFrame | None = None) -> DataFrame:
        return accounting.run_audit(self.scrapes(), context)

    def previous(self, batch_id: int | None = None) -> int | None:
        """The last committed batch, or the last one before ``batch_id``."""
        own = [b for b in self.committed() if b >= FIRST_OWN or b == COMPACTED]
        return max((b for b in own if batch_id is None or b < batch_id), default=None)

    def pending(self, batch_id: int | None = None) -> DataFrame:
        """Payloads that wait for their manifest row after the batch before ``batch_id``: the state
        that batch has stored."""
        last = self.previous(batch_id)
        rows = self.raw("pending").filter(F.lit(False) if last is None else F.col("batch_id") == last)
        return rows.drop("batch_id")

    def write(self, table: str, rows: DataFrame, batch_id: int | None) -> None:
        """Replaces the partitions the rows fall into, and no others.

        ``batch_id=None`` keeps the one the rows carry.
        """
        if batch_id is not None:
            rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows = rows.select(*_TABLES[table].fieldNames(), "batch_id")
        if table == "samples":
            # Rebalancing splits a day that is too large for one file and joins small ones.
            # Sorted files let the reader skip row groups of other metrics.
            rows = rows.hint("rebalance", "sample_date").sortWithinPartitions(
                "sample_date", "metric_name", "series_id", "sample_timestamp_ms"
            )
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*self.partitions(table))
            .parquet(self.path(table))
        )

    def begin(self, batch_id: int) -> None:
        """Takes back an earlier run of a batch: indexes that hold it and its commit first, then all
        it wrote."""
        indexes.forget(self, batch_id)
        for table in ("commits", *(t for t in _TABLES if t != "commits")):
            days = "*/" if table in PARTITIONS else ""
            path, files = self._folder(table, f"{days}batch_id={batch_id}")
            for found in files.globStatus(path) or ():
                files.delete(found.getPath(), True)

    def commit(
        self,
        batch_id: int,
        merged: Sequence[tuple[int, int]] = (),
        replaced: tuple[date, Sequence[int]] | None = None,
    ) -> None:
        """``merged``: ranges of the batches that compaction has put into this one. ``replaced``: a
        day, and the batches whose rows of that day no longer count."""
        through = max((last for _, last in merged), default=None)
        ranges = F.array(*[F.array(*map(F.lit, r)) for r in merged]) if merged else F.lit(None)
        row = self.spark.range(1).select(
            F.lit(True).alias("committed"),
            F.lit(through).cast("bigint").alias("through"),
            ranges.cast("array<array<bigint>>").alias("merged"),
            F.lit(replaced[0] if replaced else None).cast("date").alias("replaced_day"),
            F.lit(None if not replaced else list(replaced[1])).cast("array<bigint>").alias("replaced"),
        )
        self.write("commits", row, batch_id)

    def compacted_through(self) -> int | None:
        """The last batch that compaction has merged."""
        return self.raw("commits").agg(F.max("through")).first()[0]

    def merged_batches(self) -> list[tuple[int, int]]:
        """Ranges (first, last) of the batches that compaction has merged. A commit that has only
        their last one stands for all from 0."""
        rows = self.raw("commits").filter("through IS NOT NULL").select("through", "merged").collect()
        return sorted((a, b) for r in rows for a, b in r.merged or [(0, r.through)])

    def _folder(self, table: str, *parts: str):
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path(table), *parts]))
        return path, path.getFileSystem(jsc.hadoopConfiguration())

    def partition_folders(self, table: str, *parents: str) -> list[str]:
        """Names of the partition folders of a table, or of the ones below ``parents``."""
        path, files = self._folder(table, *parents)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        return [name for name in names if "=" in name]

    def drop_partition(self, table: str, *parts: str) -> None:
        path, files = self._folder(table, *parts)
        files.delete(path, True)
