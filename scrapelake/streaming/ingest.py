"""The same ingest, driven by files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scrapelake.plans.ingest import ingest_batch, kept_payloads, with_held
from scrapelake.plans.lake import Lake
from scrapelake.schema import Limits


def ingest_stream(
    lake: Lake,
    payloads: DataFrame,
    manifest: DataFrame | Callable[[DataFrame], DataFrame],
    catalogue: DataFrame,
    *,
    checkpoint: str,
    limits: Limits = Limits(),
    available_now: bool = True,
    wait_batches: int = 0,
) -> StreamingQuery:
    """Starts a stream from ``stream_payloads`` into the lake.

    ``manifest`` may be a function of a micro-batch's payloads. It is called for every batch, so
    it sees rows written after the stream's start and can read that batch's part only. A fixed
    frame keeps the files it had at the start.

    A payload may land before its manifest row: ``wait_batches`` is for how many more micro-batches it is
    then held before it fails. Held payloads are part of what ``manifest`` is called with. What is
    still held when the stream ends is for ``ingest_unlanded``.

    There is no watermark: a sample of any age is taken. A micro-batch that is replayed
    replaces its own partitions, or is left alone if compaction has merged it. A new checkpoint
    counts from 0 again; where that meets the number of a merged batch, files that the lake does not
    know stop the stream with an error, and stay to be read.
    """

    def store(arrived: DataFrame, batch_id: int) -> None:
        # A micro-batch reads all of its files for whatever is asked of it.
        with kept_payloads(lake, arrived) as batch:
            known = with_held(lake, batch_id, batch).drop("first_batch") if wait_batches else batch
            rows = manifest(known) if callable(manifest) else manifest
            ingest_batch(
                lake, batch_id, batch, rows, catalogue,
                limits=limits, landed_only=True, wait_batches=wait_batches, copied=True,
            )

    writer = payloads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
