"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

Best fit, longest first, looks only at lengths. So the plan is made on the counts of each length
(at most ``capacity`` of them, whatever the corpus): sequences that are filled alike form a range
of sequence numbers, and a length's pieces fill ranges at once. The plan lists, for each length,
runs of slots; a piece takes the slot of its rank among the pieces of its length.

A null text is empty and packs as its end token alone. Repeated rows are packed one by one. An
empty table gives no piece. Texts of any length are cut into pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrapelake.llm.common import numbered, stored
from scrapelake.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_TOKEN = 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: ids of the whole text and the end token, cut so that only the
    first piece may be shorter than ``capacity``. ``with_ids`` adds the ids themselves, as bytes of
    little-endian unsigned 32-bit numbers."""
    path = tokenizer or tokenizer_path()
    end = END_TOKEN.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = encode.encode([t or "" for t in part["text"].to_pylist()])
                rows: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), found, strict=True):
                    ids += end
                    total = len(ids) // 4
                    start = 0
                    length = (total - 1) % capacity + 1
                    number = 0
                    while start < total:
                        data = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, number, start, length, zlib.crc32(data), data))
                        start, length, number = start + length, capacity, number + 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                size = len(names) if with_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns[:size], kinds, strict=False)],
                    names[:size],
                )

    schema = _PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Slots by best fit, longest first: rows (length, first rank, slots, first sequence, slots in
    each sequence, place of the first of them).

    Open sequences are kept as ranges of numbers by the room they have left. A range takes as
    many pieces in each sequence as fit, since after one piece it is the tightest that still fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    slots: list[tuple[int, ...]] = []
    opened = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                bisect.insort(sizes, left)
            room.setdefault(left, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    sizes.pop(at)
            else:
                left, first = capacity, opened
                count = -(-todo // (capacity // length))
                opened += count
            each = left // length
            used = min(count, todo // each)
            if used:
                slots.append((length, rank, used * each, first, each, capacity - left))
                put(left - length * each, first, used)
                rank, todo = rank + used * each, todo - used * each
            if used < count:
                rest = min(todo, each)
                if rest:  # fewer than each, as used was the most
                    slots.append((length, rank, rest, first + used, rest, capacity - left))
                    put(left - length * rest, first + used, 1)
                    rank, todo, used = rank + rest, todo - rest, used + 1
                put(left, first + used, count - used)
    return slots


_SLOTS = "s_length bigint, s_first bigint, s_count bigint, s_sequence bigint, s_each bigint, s_place bigint"


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table of pieces) with ``sequence_id`` and ``offset``.

    The histogram on the driver has at most ``capacity`` rows and the plan a few for each of
    them, so the plan is broadcast.
    """
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    spark = cut.sparkSession
    slots = spark.createDataFrame(plan(counts, capacity), _SLOTS)
    names = [c for c in ("doc_id", "piece", "ids_crc32") if c in cut.columns]
    ranked = numbered(cut, ["length"], [], names, "_rank")
    within = F.col("_rank") - F.col("s_first")
    # A length's slots follow each other, so each rank lies in exactly one run.
    return (
        ranked.join(
            F.broadcast(slots),
            (F.col("length") == F.col("s_length"))
            & (F.col("_rank") >= F.col("s_first"))
            & (F.col("_rank") < F.col("s_first") + F.col("s_count")),
        )
        .withColumn("sequence_id", F.col("s_sequence") + F.floor(within / F.col("s_each")))
        .withColumn("offset", F.col("s_place") + within % F.col("s_each") * F.col("length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def packed(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of documents with their places, and their ids if asked for. Pieces are stored first,
    since the plan and the ranks must see the same rows."""
    return pack(stored(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
