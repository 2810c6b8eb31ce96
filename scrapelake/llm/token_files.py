"""Token ids in binary blocks with a shared zstandard dictionary.

A block is a run of documents in ascending ``doc_id`` order::

    8 bytes   magic "TOKBLK01"
    8 bytes   hash of the dictionary
    u32       bytes of an id (2 or 4)
    u32       documents
    u64 x (documents + 1)   where each document's frame starts, from the first frame on
    frames    each document's ids, little endian, one zstandard frame each

The dictionary is trained on the id arrays of a bounded sample of documents, so that short
documents compress well although each is a frame of its own; one document is read by its offset
without the others. Blocks are rows of a Parquet table in a shared folder, written by Spark's own
committer, so any store works and a lost executor leaves no half-written block. A block's index
rows (document, ids before it, ids) stand beside it.

A null text is empty and has its end id alone. Null ids of documents come first. Rows that share
a ``doc_id`` are ordered by their contents. An empty table gives empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import stored
from scrapelake.llm.tokens import encoder, tokenizer_path

END_TOKEN = 2
#: The dictionary's sample: so many documents of at most so many characters, and its size.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 20_000, 65_536
BLOCK_BYTES = 4 << 20
_MAGIC = b"TOKBLK01"
_HEAD = struct.Struct("<8sQII")


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized arrays; from too few, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _serial(ids: bytes, width: int) -> bytes:
    """Ids in ``width`` bytes each; ValueError if one needs more."""
    wide = np.frombuffer(ids, "<u4")
    if width < 4 and len(wide) and int(wide.max()) >> (8 * width):
        raise ValueError(f"token id {int(wide.max())} does not fit into {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def train(docs: DataFrame, tokenizer: str | None = None, width: int = 2) -> bytes:
    """The dictionary for a table: the sample is the documents of lowest id hash, which are found
    without reading a text."""
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    text = F.col("text")
    chosen = docs.filter(F.col("doc_id").isin([r.doc_id for r in ids if r.doc_id is not None]))
    usable = chosen.filter(text.isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    rows = usable.select("text").limit(SAMPLE_DOCUMENTS).collect()
    found = encoder(tokenizer or tokenizer_path()).encode([r.text for r in rows])
    return dictionary_of([_serial(x, width) for x in found])


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def frames(
    docs: DataFrame, dictionary: bytes, tokenizer: str | None = None, width: int = 2
) -> DataFrame:
    """Each document's ids as a frame: ``doc_id, n_tokens, frame``."""
    path = tokenizer or tokenizer_path()
    end = np.array([END_TOKEN], f"<u{width}").tobytes()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        shared = _dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = encode.encode([t or "" for t in part["text"].to_pylist()])
                serial = [_serial(x, width) + end for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(x) // width for x in serial], pa.int64()),
                        pa.array([packer.compress(x) for x in serial], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "frame"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        compress, "doc_id bigint, n_tokens bigint, frame binary"
    )


_BLOCKS = "part int, block int, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, tokens bigint, data binary"


def _block(part: int, number: int, before: int, rows: list[tuple], digest: int, width: int) -> tuple:
    ids, sizes, data = zip(*rows, strict=True)
    starts = np.cumsum([0, *map(len, data)]).astype("<u8").tobytes()
    head = _HEAD.pack(_MAGIC, digest, width, len(rows))
    return part, number, before, list(ids), list(sizes), sum(sizes), head + starts + b"".join(data)


def write(
    docs: DataFrame, folder: str, tokenizer: str | None = None, width: int = 2
) -> None:
    """Writes the tables ``blocks`` and ``dictionary`` below a folder."""
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer, width)
    digest = xxhash.xxh3_64_intdigest(dictionary)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, before, size, rows = 0, 0, 0, []
        names = ["part", "block", "before", "doc_ids", "n_tokens", "tokens", "data"]
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int64(), longs, longs, pa.int64(), pa.binary()]

        def out() -> pa.RecordBatch:
            made = _block(part, number, before, rows, digest, width)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(made, kinds, strict=True)], names
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield out()
                    number, before = number + 1, before + sum(r[1] for r in rows)
                    size, rows = 0, []
        if rows:
            yield out()

    # Stored first: to find the ranges, Spark reads what it is to deal out once more.
    framed = stored(frames(docs, dictionary, tokenizer, width), "frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = framed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    ordered.mapInArrow(block, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(digest.to_bytes(8, "little"), bytearray(dictionary))], "hash binary, data binary").write.parquet(
        f"{folder}/dictionary"
    )


def _based(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the number of ids before each. The running sum goes over the parts, of which
    there are as many as shuffle partitions, so their sums are broadcast."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("base", F.col("base") + F.col("before"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (ids as little-endian unsigned
    32-bit bytes)."""
    return _decode(spark, folder, "ids")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with the crc32 of the ids in their place."""
    return _decode(spark, folder, "ids_crc32")


def _decode(spark: SparkSession, folder: str, what: str) -> DataFrame:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, known = bytes(row["data"]), int.from_bytes(row["hash"], "little")
    kind = pa.binary() if what == "ids" else pa.int64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for base, doc_ids, counts, data in zip(
                *(batch[c].to_pylist() for c in ("base", "doc_ids", "n_tokens", "data")), strict=True
            ):
                arrays = document_arrays(data, unpacker, known)
                starts = base + np.cumsum([0, *counts[:-1]])
                found = [x if what == "ids" else zlib.crc32(x) for x in arrays]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(found, kind),
                    ],
                    ["doc_id", "start", "n_tokens", what],
                )

    based = _based(spark, folder).select("base", "doc_ids", "n_tokens", "data")
    schema = f"doc_id bigint, start bigint, n_tokens bigint, {what} {'binary' if what == 'ids' else 'bigint'}"
    return based.mapInArrow(decode, schema)


def document_arrays(
    data: bytes, unpacker: zstandard.ZstdDecompressor, known: int, only: int | None = None
) -> Iterator[bytes]:
    """Ids of a block's documents, or of the one at place ``only``, as unsigned 32-bit bytes."""
    magic, digest, width, count = _HEAD.unpack_from(data)
    if magic != _MAGIC or digest != known:
        raise ValueError("not a block of this dictionary")
    starts = np.frombuffer(data, "<u8", count + 1, _HEAD.size).tolist()
    first = _HEAD.size + 8 * (count + 1)
    for i in range(count) if only is None else (only,):
        frame = data[first + starts[i] : first + starts[i + 1]]
        yield np.frombuffer(unpacker.decompress(frame), f"<u{width}").astype("<u4").tobytes()


def lookup(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """Ids of the documents of a given list (``doc_id``), by block and place: only their frames
    are decompressed."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, known = bytes(row["data"]), int.from_bytes(row["hash"], "little")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    wanted = places.join(doc_ids.select("doc_id").distinct(), "doc_id").groupBy("part", "block").agg(
        F.collect_list(F.struct("place", "doc_id")).alias("wanted")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for wanted, data in zip(batch["wanted"].to_pylist(), batch["data"].to_pylist(), strict=True):
                found = [next(document_arrays(data, unpacker, known, w["place"])) for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["doc_id"] for w in wanted], pa.int64()), pa.array(found, pa.binary())],
                    ["doc_id", "ids"],
                )

    return blocks.join(wanted, ["part", "block"]).select("wanted", "data").mapInArrow(
        decode, "doc_id bigint, ids binary"
    )


def written(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and reads them back as digests."""
    write(docs, folder, tokenizer)
    return digests(docs.sparkSession, folder)
