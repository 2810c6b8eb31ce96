"""Removal of word sequences that an earlier document already has.

Windows of ``WINDOW`` consecutive words are the edges of a de Bruijn graph (their first and last
``WINDOW - 1`` words are its nodes). Only edges of at least two documents matter. They are found
in three steps that move far less than all windows:

1. Documents of equal words are one document, the one of smallest id; the others lose all words.
2. Each window has an anchor, the smallest hash of the ``ANCHOR``-word sequences inside it. Equal
   windows have equal anchors, so a window is a candidate only if its anchor stands in two
   documents. Anchors are about a fifth of the words.
3. Candidate windows are counted by their hash; each learns its source, the first place in the
   smallest document that has it.

A path of repeated edges that does not branch keeps the same distance between a document's places
and its source's, so consecutive edges compact into a span (document, start, words, source, start
there). A span's words are compared at both coordinates by a 128-bit hash before they are removed.

Null and empty texts have no words. Documents below ``WINDOW`` words lose nothing. Rows that share
a ``doc_id`` are separate documents, none of them earlier than the other; a null id is never
earlier or later. Texts of any length are
processed whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import sequence_hashes, stored, word_hashes
from scrapelake.session import materialize, scratch, scratch_folder

WINDOW, ANCHOR = 13, 6


def _values(column: pa.Array) -> list:
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type):
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return column.to_pylist()


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and len(values):
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind.value_type))
    return pa.array(values, kind)


def _map(frame: DataFrame, each, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Applies ``each(row...) -> rows`` to the rows of a frame, some hundred at a time. Lists of numbers
    come and go as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [r for row in zip(*map(_values, part.columns), strict=True) for r in each(*row)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                arrays = [_column(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return frame.mapInArrow(run, schema)


def _base(docs: DataFrame) -> DataFrame:
    """A row per document: its words' hash and digest, and the words, compressed."""
    packer: list = []

    def each(doc_id, text):
        words = (text or b"").split()
        joined = b" ".join(words)
        if not packer:
            packer.append(zstandard.ZstdCompressor(level=3))
        yield (
            doc_id,
            len(words),
            xxhash.xxh3_128_digest(joined),
            hashlib.sha256(joined).hexdigest(),
            packer[0].compress(joined) if len(words) >= WINDOW else b"",
        )

    return _map(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")),
        each,
        "doc_id bigint, n_words bigint, words_hash binary, sha string, packed binary",
        ["doc_id", "n_words", "words_hash", "sha", "packed"],
        [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()],
    )


def _first(base: DataFrame) -> DataFrame:
    """The smallest document of each word sequence, with a ``key`` of its own: its id, or for a
    further one of the same id a hash of its words."""
    long = base.filter(F.col("n_words") >= WINDOW)
    first = long.groupBy("words_hash").agg(F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("words_hash"))
    return first.withColumn(
        "key", F.when(place == 1, F.col("doc_id")).otherwise(F.xxhash64("words_hash"))
    )


def _anchor_hashes(grams: np.ndarray) -> np.ndarray:
    """The anchor of every window, the smallest of its ``ANCHOR``-word hashes."""
    width, reach = WINDOW - ANCHOR + 1, 1
    least = grams
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


_UNPACKER: list[zstandard.ZstdDecompressor] = []


def _text(packed: bytes) -> bytes:
    if not _UNPACKER:
        _UNPACKER.append(zstandard.ZstdDecompressor())
    return _UNPACKER[0].decompress(packed)


def _unpacked(packed: bytes) -> list[bytes]:
    return _text(packed).split()


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted. Neighbours are often equal, so those go first."""
    values = np.sort(values[np.diff(values, prepend=~values[:1]) != 0])
    return values[np.diff(values, prepend=~values[:1]) != 0]


def _anchors(texts: DataFrame) -> DataFrame:
    """Distinct anchors of each document."""

    def each(key, packed):
        anchors = _anchor_hashes(sequence_hashes(word_hashes(_text(packed)), ANCHOR))
        yield key, _distinct(anchors).view(np.int64)

    listed = _map(
        texts.select("key", "packed"),
        each,
        "key bigint, anchors array<bigint>",
        ["key", "anchors"],
        [pa.int64(), pa.list_(pa.int64())],
    )
    return listed.select("key", F.explode("anchors").alias("anchor"))


def _windows(texts: DataFrame) -> DataFrame:
    """Windows whose anchor is shared (``anchors``): hash, document, place, and whether it is the
    document's first such window."""

    def each(key, doc_id, packed, anchors):
        hashes = word_hashes(_text(packed))
        own = _anchor_hashes(sequence_hashes(hashes, ANCHOR))
        wanted = np.sort(anchors.view(np.uint64))
        found = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        places = np.flatnonzero(wanted[found] == own)
        windows = sequence_hashes(hashes, WINDOW)[places]
        fresh = np.zeros(len(windows), bool)
        fresh[np.unique(windows, return_index=True)[1]] = True
        yield key, doc_id, places.astype(np.int32), windows.view(np.int64), fresh

    listed = _map(
        texts.select("key", "doc_id", "packed", "anchors"),
        each,
        "key bigint, doc_id bigint, places array<int>, windows array<bigint>, fresh array<boolean>",
        ["key", "doc_id", "places", "windows", "fresh"],
        [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_())],
    )
    return listed.select(
        "key", "doc_id", F.explode(F.arrays_zip("places", "windows", "fresh")).alias("w")
    ).select(
        F.col("w.windows").alias("window"),
        "key",
        "doc_id",
        F.col("w.places").alias("place"),
        F.col("w.fresh").alias("fresh"),
    )


def _spans(windows: DataFrame) -> DataFrame:
    """Repeated windows compacted into spans with their source coordinates."""
    # Fixed-width sums only, so a hot window becomes one row per task before it is shuffled. The
    # source is a single document: of those that share the smallest id, the one of smallest key.
    mine = F.when(F.col("fresh"), F.col("doc_id"))
    sources = windows.groupBy("window").agg(
        F.min("doc_id").alias("source_id"),
        F.max("doc_id").alias("last"),
        F.min_by(F.col("key").cast("decimal(20,0)") * (1 << 31) + F.col("place"), mine).alias("at"),
    )
    at = F.col("at")
    place = F.pmod(at, F.lit(1 << 31).cast("decimal(20,0)"))
    sources = sources.filter("last > source_id").select(
        "window",
        "source_id",
        ((at - place) / F.lit(1 << 31).cast("decimal(20,0)")).cast("bigint").alias("source_key"),
        place.cast("int").alias("source_place"),
    )
    sources = stored(sources, "sources")
    repeated = windows.join(sources, "window").filter("doc_id > source_id")
    in_document = W.partitionBy("key").orderBy("place")
    shift = F.col("place") - F.col("source_place")
    before = F.lag(F.struct("source_key", "shift", "place")).over(in_document)
    starts = (
        before.isNull()
        | (before["source_key"] != F.col("source_key"))
        | (before["shift"] != F.col("shift"))
        | (before["place"] + 1 != F.col("place"))
    )
    return (
        repeated.withColumn("shift", shift)
        .withColumn("starts", starts)
        .withColumn("run", F.count(F.when(F.col("starts"), 1)).over(in_document))
        .groupBy("key", "run")
        .agg(
            F.min("place").alias("start"),
            (F.count(F.lit(1)) + WINDOW - 1).cast("int").alias("words"),
            F.min("source_key").alias("source_key"),
            F.min("source_place").alias("source_start"),
        )
        .drop("run")
    )


def _span_hashes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """128-bit hashes of the words of spans (``key, start, words``)."""
    asked = wanted.distinct().groupBy("key").agg(
        F.collect_list(F.struct("start", "words")).alias("asked")
    )

    def each(key, packed, asked):
        words = _unpacked(packed)
        for a in asked:
            part = b" ".join(words[a["start"] : a["start"] + a["words"]])
            yield key, a["start"], a["words"], xxhash.xxh3_128_digest(part)

    return _map(
        texts.join(asked, "key").select("key", "packed", "asked"),
        each,
        "key bigint, start int, words int, hash binary",
        ["key", "start", "words", "hash"],
        [pa.int64(), pa.int32(), pa.int32(), pa.binary()],
    )


def _text_table(base: DataFrame) -> DataFrame:
    """Packed words of the first documents, in buckets by key, so that the joins that follow read
    them without a shuffle."""
    spark = base.sparkSession
    name = scratch_folder(spark, "words").rpartition("/")[2].replace("-", "_")
    # By the id alone, so the texts move once, to where their bucket is.
    keys = _first(base).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("words_hash", "key"))).alias("keys")
    )
    key = F.try_element_at("keys", F.col("words_hash"))
    texts = base.join(keys, "doc_id").withColumn("key", key).filter("key IS NOT NULL")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        texts.select("key", "doc_id", "packed")
        .write.bucketBy(buckets, "key")
        .sortBy("key")
        .option("path", scratch_folder(spark, "words"))
        .saveAsTable(name)
    )
    return spark.table(name)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verified spans, and the stored tables of documents and of their words."""
    spark = docs.sparkSession
    with scratch(spark, "words-base") as folder:
        whole = materialize(_base(docs), folder)
        base = stored(whole.drop("packed"), "documents")
        texts = _text_table(whole)
    anchors = _anchors(texts)
    shared = stored(
        anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"),
        "anchors",
    )
    own = anchors.join(shared, "anchor").groupBy("key").agg(
        F.collect_list("anchor").alias("anchors")
    )
    windows = stored(_windows(texts.join(own, "key")), "windows")
    spans = stored(_spans(windows), "spans")
    there = [F.col("source_key").alias("key"), F.col("source_start").alias("start"), "words"]
    wanted = spans.select("key", "start", "words").unionByName(spans.select(*there))
    hashes = stored(_span_hashes(texts, wanted).distinct(), "span-hashes")
    source = hashes.toDF("source_key", "source_start", "words", "source_hash")
    checked = spans.join(hashes, ["key", "start", "words"]).join(
        source, ["source_key", "source_start", "words"]
    )
    return checked.filter("hash = source_hash").drop("hash", "source_hash"), base, texts


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Each document's words without the repeated ones: ``doc_id, n_words, n_removed,
    kept_sha256``, and if asked for ``kept_text``, which is null where nothing was removed."""
    spans, base, texts = repeated_spans(docs)
    own = spans.groupBy("key").agg(F.collect_list(F.struct("start", "words")).alias("spans"))

    def each(key, packed, spans):
        words = _unpacked(packed)
        gone = np.zeros(len(words), bool)
        for s in spans:
            gone[s["start"] : s["start"] + s["words"]] = True
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        row = (key, int(gone.sum()), hashlib.sha256(kept).hexdigest())
        yield (*row, kept.decode("utf-8", "replace")) if with_text else row

    schema = "key bigint, n_removed bigint, cut_sha string"
    names = ["key", "n_removed", "cut_sha"]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    if with_text:
        schema, names, kinds = schema + ", cut_text string", [*names, "cut_text"], [*kinds, pa.string()]
    cut = _map(
        texts.join(own, "key").select("key", "packed", "spans"), each, schema, names, kinds
    ).dropDuplicates(["key"])
    first = _first(base).select("words_hash", F.col("doc_id").alias("first_id"), "key")
    joined = base.join(first, "words_hash", "left").join(cut, "key", "left")
    copy: Column = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"))
    return joined.select(*columns)
