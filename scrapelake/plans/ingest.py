"""Landed payloads to stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrapelake.functions.values import sample_date
from scrapelake.operators import accounting, exposition, upsert
from scrapelake.operators.activity import active_days
from scrapelake.plans.lake import FIRST_OWN, Lake
from scrapelake.schema import LANDED, SCRAPES, Limits
from scrapelake.session import discard, materialize
from scrapelake.sources.payloads import decoded
from scrapelake.sources.tables import checked_manifest

#: Bytes of a row group of copied payloads: what a task holds to write them, and the least it reads.
PAYLOAD_BLOCK = 32 << 20


def scraped_samples(parsed: DataFrame, audit: DataFrame) -> DataFrame:
    """Business samples of the accepted scrapes together with the synthetic ones of all."""
    business = exposition.accepted_samples(parsed)
    return business.unionByName(accounting.synthetic_samples(audit)).withColumn(
        "sample_date", sample_date(F.col("sample_timestamp_ms"))
    )


def _unknown_paths(lake: Lake, payloads: DataFrame, manifest: DataFrame, landed_only: bool) -> DataFrame:
    """Paths of a batch's scrapes and payloads that have no audit row in the lake."""
    known = lake.scrapes()
    stray = known.filter("scrape_id IS NULL").select(F.col("logical_url").alias("path"))
    named = manifest.select("scrape_id", "path")
    landed = payloads.select("path")
    scrapes = named.join(landed, "path", "left_semi") if landed_only else named
    missing = scrapes.filter("scrape_id IS NOT NULL").join(known, "scrape_id", "left_anti").select("path")
    return missing.unionByName(landed.join(named, "path", "left_anti")).join(stray, "path", "left_anti")


def landed_bytes(payloads: DataFrame) -> DataFrame:
    """Path, length and hash of every payload. Their bytes are read once more for it; none is shuffled."""
    digest = F.when(F.col("content").isNotNull(), F.xxhash64("content"))
    return payloads.select("path", F.col("length").cast("bigint").alias("length"), digest.alias("content_hash"))


def _corrected_paths(lake: Lake, payloads: DataFrame) -> DataFrame:
    """Paths whose payload the lake has read, but never with these bytes. Of lakes that were filled
    before such hashes were kept, nothing is known."""
    read = lake.log("landed").select(*LANDED.fieldNames())
    known = read.select(*(F.col(c).alias(f"_{c}") for c in read.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("length", "content_hash")]
    again = landed_bytes(payloads).join(read.select("path").distinct(), "path", "left_semi")
    return again.join(known, [F.col("path") == F.col("_path"), *same], "left_anti").select("path")


def ingest_batch(
    lake: Lake,
    batch_id: int,
    payloads: DataFrame,
    manifest: DataFrame,
    catalogue: DataFrame,
    *,
    limits: Limits = Limits(),
    landed_only: bool = False,
    wait_batches: int = 0,
    copied: bool = False,
) -> bool:
    """Reads, checks and stores one batch of payloads; returns whether it did.

    The payloads are copied once, into a table below the lake's root, so that no file of one payload is
    opened again, and parsed once, into another one by kind of row: verdicts,
    samples and directives. Every sink reads only the kind it needs. A batch that is run again,
    whole or after a failure, first takes back what it had stored, and the commit comes last.
    A batch that compaction has merged is stored already and is left alone; any other one is
    stored, whatever its number. If it has the number of a merged one but scrapes or payloads that
    the lake does not know, from a new checkpoint or another source, ValueError is raised; so it is if
    a payload was corrected since, for which a batch number of its own is needed.

    Nothing is dropped on the way: a manifest row that may not be read, by itself or for its task's
    rules, and a payload without a manifest row get a failed audit row.

    With ``wait_batches``, a payload without a manifest row is held instead, for up to that many more
    batches, and read in the first one whose manifest has its row. What is held is a table of the
    batch like any other, so a batch that is run again finds what the one before it has left. Numbers
    must then ascend, as a stream's do.

    ``landed_only`` leaves out manifest rows without a payload in this batch, which a stream
    may still deliver. ``copied`` tells that the payloads are such a table already.
    """
    if any(first <= batch_id <= last for first, last in lake.merged_batches()):
        if not _unknown_paths(lake, payloads, manifest, landed_only).isEmpty():
            raise ValueError(
                f"batch {batch_id} has scrapes that are not in {lake.root}, where compaction has "
                "merged a batch of this number; give it a number of its own"
            )
        if not _corrected_paths(lake, payloads).isEmpty():
            raise ValueError(
                f"batch {batch_id} has payloads that were corrected since compaction has merged a batch "
                f"of this number in {lake.root}; give it a number of its own"
            )
        return False
    folder = f"{lake.root.rstrip('/')}/_parsed-{uuid.uuid4().hex}"
    with nullcontext(payloads) if copied else kept_payloads(lake, payloads) as rows:
        _ingest(lake, batch_id, rows, manifest, catalogue, folder, limits, landed_only, wait_batches)
    return True


@contextmanager
def kept_payloads(lake: Lake, payloads: DataFrame) -> Iterator[DataFrame]:
    """Payloads as a table below the lake's root while a batch is read. Rows may be as large as the body
    limit, so the writer looks at the size of its buffer after every few of them."""
    folder = f"{lake.root.rstrip('/')}/_payloads-{uuid.uuid4().hex}"
    try:
        writer = payloads.write.option("parquet.page.size.row.check.min", "4")
        writer.option("parquet.block.size", str(PAYLOAD_BLOCK)).parquet(folder)
        yield lake.spark.read.schema(payloads.schema).parquet(folder)
    finally:
        discard(lake.spark, folder)


def _ingest(
    lake: Lake,
    batch_id: int,
    payloads: DataFrame,
    manifest: DataFrame,
    catalogue: DataFrame,
    folder: str,
    limits: Limits,
    landed_only: bool,
    wait_batches: int,
) -> None:
    held = None
    if wait_batches:
        everything = with_held(lake, batch_id, payloads)
        payloads = everything.drop("first_batch")
        unnamed = everything.join(manifest.select("path"), "path", "left_anti")
        held = unnamed.filter(F.lit(batch_id) - F.col("first_batch") < wait_batches)
    try:
        good, bad = checked_manifest(manifest, catalogue)
        none = F.lit(None).cast("string").alias("violation")
        # One row a scrape, read by every sink.
        judged = materialize(good.select("*", none).unionByName(bad), f"{folder}-manifest")
        usable = judged.filter("violation IS NULL").drop("violation")
        refused = judged.filter("violation IS NOT NULL")
        tasks = exposition.parse_tasks(payloads, limits)
        parsed = materialize(
            exposition.parse_payloads(decoded(payloads, usable, limits), usable, catalogue, limits, tasks)
            .filter("kind = 'scrape' OR scrape_error IS NULL")
            .drop("labels"),
            folder,
            "kind",
        )
        stray = accounting.stray_payloads(payloads, manifest)
        if held is not None:
            stray = stray.join(held.select(F.col("path").alias("logical_url")), "logical_url", "left_anti")
            stray = stray.select(*SCRAPES.fieldNames())
        if landed_only:
            landed = parsed.filter("kind = 'scrape'").select("scrape_id")
            usable = usable.join(landed, "scrape_id", "left_semi")
            refused = refused.join(payloads.select("path"), "path", "left_semi")
        audit = accounting.scrape_audit(usable, parsed, limits)
        samples = scraped_samples(parsed, audit)
        scrapes = (
            audit.select(*SCRAPES.fieldNames())
            .unionByName(accounting.refused_scrapes(refused, limits))
            .unionByName(stray)
        )
        lake.begin(batch_id)
        lake.write("activity", active_days(samples), batch_id)
        lake.write("samples", samples, batch_id)
        lake.write("series", upsert.first_series(samples), batch_id)
        lake.write("metadata", exposition.last_metadata(parsed), batch_id)
        lake.write("scrapes", scrapes, batch_id)
        lake.write("landed", landed_bytes(payloads).select(*LANDED.fieldNames()), batch_id)
        if held is not None:
            lake.write("pending", held, batch_id)
        lake.commit(batch_id)
        if held is not None:
            _drop_held(lake, before=lake.previous(batch_id))
    finally:
        discard(lake.spark, folder)
        discard(lake.spark, f"{folder}-manifest")


def with_held(lake: Lake, batch_id: int | None, payloads: DataFrame) -> DataFrame:
    """A batch's payloads and those held for it, with the batch in which each came."""
    arrived = payloads.withColumn("first_batch", F.lit(batch_id).cast("bigint"))
    return arrived.unionByName(lake.pending(batch_id))


def _drop_held(lake: Lake, before: int | None) -> None:
    """Removes what earlier batches have held, but for the one a rerun would start from."""
    for folder in lake.partition_folders("pending"):
        if before is not None and int(folder.partition("=")[2]) < before:
            lake.drop_partition("pending", folder)


def ingest_unlanded(
    lake: Lake, manifest: DataFrame, catalogue: DataFrame, *, limits: Limits = Limits()
) -> None:
    """Closes a stream's account: payloads that are still held are read if the manifest has their
    row and else fail, and the scrapes that the stream has not delivered and will not fail too.

    Failed ones get their audit row and synthetic samples. All this is a batch of its own below zero,
    out of the way of the stream's numbers. Run again, it finds nothing left to do.
    """
    known = lake.scrapes().select("scrape_id").filter("scrape_id IS NOT NULL")
    missing = manifest.join(known, "scrape_id", "left_anti")
    own = lake.raw("commits").filter(F.col("batch_id") >= FIRST_OWN)
    lowest = min([own.agg(F.min("batch_id")).first()[0] or 0, *(first for first, _ in lake.merged_batches())])
    last = lake.previous()
    stray = lake.scrapes().filter("scrape_id IS NULL").select(F.col("logical_url").alias("path"))
    stored = manifest.join(known, "scrape_id", "left_semi").select("path").unionByName(stray)
    waiting = lake.pending().drop("first_batch").join(stored, "path", "left_anti")
    ingest_batch(lake, min(lowest, 0) - 1, waiting, missing, catalogue, limits=limits)
    if last is not None:
        lake.drop_partition("pending", f"batch_id={last}")
