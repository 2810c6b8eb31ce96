"""Exact Jaccard join of documents on word shingles, and its connected components.

Sets that reach the similarity differ in few elements. With |A n B| >= s |A u B| they differ in at
most ``D = floor((1 - s) / s * min(|A|, |B|))`` elements. So if every element is dealt by its hash to
one of more than ``D`` parts, those beyond ``D`` at least are the same in both sets. Sets are banded by
size; a band has a fixed number of parts, enough for its largest set, and a set whose partners may lie in the next
band is dealt by that one's number, too. A *tile* holds the sets of a band that agree in one part.
Entries (tile, set) are shuffled packed, by ranges of the tile's hash, and sorted range by range. A set
that shares fewer tiles of a band than any link would need has no partner there and is done with.

Within a tile, all sets are first compared to the one of smallest number only, so a group of k near
copies costs k comparisons. What that leaves apart is compared in full: sets that tiles connect are
a group, its sets are cut into slices by size and slices into blocks, and each pair of blocks whose
sizes allow a link is one task's work. Pairs that are joined by then are skipped, and only one link
for two joined parts is returned, so the result does not grow with the square of a group.

Pairs are compared by hashed bitmap signatures first: a bit that is set in one signature alone
stands for at least one element that the other set lacks, so bit counts bound the overlap from
above. What passes is decided by intersecting the sorted arrays of 64-bit shingle hashes.

Equal sets (copies) are one set throughout. Null texts and texts without words have the empty
set, which links with nothing. Fewer words than a shingle has give one shingle, the whole
sequence. Repeated rows and rows that share a ``doc_id`` are fine: each gets its component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrapelake.llm.common import WORDS, mixed, ngram_hashes, row_key, sequence_hash, stored
from scrapelake.session import discard, materialize, scratch_folder

#: Ratio of a band's largest to its smallest size, at least.
BAND_RATIO = 1.35
#: Sets of a block; a block pair is held in one task.
BLOCK = 1024


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, lower-cased in A-Z."""
    hashes = WORDS.of((text or b"").lower().split())
    if 0 < len(hashes) < words:
        return np.frombuffer(sequence_hash(hashes)[:8], np.uint64)
    return np.unique(ngram_hashes(hashes, words))


@lru_cache
def _starts(threshold: Fraction) -> list[int]:
    """Where the bands start. Partners of a set lie in its band or beside it."""
    ratio, starts = max(BAND_RATIO, float(1 / threshold)), [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
    return starts


def band_of(size: int, threshold: Fraction) -> int:
    return max(0, bisect_right(_starts(threshold), size) - 1)


def band_start(band: int, threshold: Fraction) -> int:
    return _starts(threshold)[band]


def most_different(size: int, threshold: Fraction) -> int:
    """Elements in which a set of this size and one that it links with differ, at most."""
    return int((1 - threshold) / threshold * size)


def part_hashes(values: np.ndarray, band: int, threshold: Fraction) -> tuple[np.ndarray, int]:
    """Tile keys of a set in a band: a hash of each part's elements and its place, and the band in
    the low six bits. Also how many of them any linked set of this band shares, at least.

    There are some more parts than sets may differ in, so linked sets share several. Empty parts
    agree for no reason; they are left out as long as enough others are left.
    """
    most = most_different(band_start(band + 1, threshold) - 1, threshold)
    parts = most + max(3, most // 8)
    spread = mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    place = (spread >> np.uint64(32)) % np.uint64(parts)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, place, mixed(spread))
    places = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
    tiles = mixed(sums ^ mixed(places + np.uint64(1))) & ~np.uint64(63) | np.uint64(band & 63)
    filled = np.bincount(place.astype(np.int64), minlength=parts) > 0
    spare = int(filled.sum()) - most_different(len(values), threshold)
    return (tiles[filled], spare) if spare > 0 else (tiles, 1)


def signature(values: np.ndarray) -> bytes:
    """Bitmap of the low bits of the hashes, two to four bits for each element."""
    bits = max(64, 1 << int(2 * len(values)).bit_length())
    flags = np.zeros(bits, bool)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """An upper bound of the intersection. Bitmaps of two widths are folded to the narrower."""
    size = min(len(a), len(b))
    x, y = _folded(np.frombuffer(a, np.uint64), size // 8), _folded(np.frombuffer(b, np.uint64), size // 8)
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(size_a - only_a, size_b - only_b)


def reaches(inter: int, size_a: int, size_b: int, threshold: Fraction) -> bool:
    union = size_a + size_b - inter
    return threshold.denominator * inter >= threshold.numerator * union


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), *more)


def _row(docs: DataFrame) -> Column:
    """Key of a whole row; only rows that are equal in all columns share it."""
    return row_key(*[c for c, t in docs.dtypes if t != "void"])


def _sets(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Per document: size and hash of its set, its signature, its band, how many tiles of its
    band and of the next one it must share to link, and the key of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, keys, bitmaps, bands, needs = [], [], [], [], []
                for text in part["text"].to_pylist():
                    values = shingle_set(text, words)
                    sizes.append(len(values))
                    band = band_of(len(values), threshold)
                    bands.append(band)
                    needs.append([part_hashes(values, b, threshold)[1] for b in (band, band + 1)])
                    keys.append(set_hash(values))
                    bitmaps.append(signature(values) if len(values) else b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bitmaps, pa.binary()),
                        pa.array(bands, pa.int32()),
                        pa.array(needs, pa.list_(pa.int32())),
                        part["key"].cast(pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "bitmap", "band", "needs", "key"],
                )

    return _texts(docs, _row(docs).alias("key")).mapInArrow(
        run,
        "doc_id bigint, n_shingles bigint, set_hash binary, bitmap binary, band int, needs array<int>, key binary",
    )


def set_hash(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def node_of(digest: bytes) -> int:
    """Number of a set: half of its hash. For a billion sets, two share one with a chance of 3 %."""
    return int.from_bytes(digest[:8], "big", signed=True)


_ENTRY = np.dtype([("tile", "<u8"), ("node", "<i8")])


def _tiles_of(values: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Tile keys of a set: those of its band, and those of the next if partners may lie there."""
    band = band_of(len(values), threshold)
    found = [part_hashes(values, band, threshold)[0]]
    if len(values) / threshold >= band_start(band + 1, threshold):
        found.append(part_hashes(values, band + 1, threshold)[0])
    return np.concatenate(found)


def stars_of(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every tile with several sets: its smallest set, each of its sets, and its band."""
    entries = entries[np.argsort(entries["tile"], kind="stable")]
    again = entries["tile"][1:] == entries["tile"][:-1]
    met = np.zeros(len(entries), bool)
    met[1:] |= again
    met[:-1] |= again
    # Few tiles have several entries; copies give the same entry again.
    entries = np.unique(entries[met])
    tile, node = entries["tile"], entries["node"]
    new = np.ones(len(entries), bool)
    new[1:] = tile[1:] != tile[:-1]
    run = np.cumsum(new) - 1
    shared = np.bincount(run, minlength=1)[run] > 1 if len(entries) else new
    star = node[np.flatnonzero(new)][run] if len(entries) else node
    return star[shared], node[shared], (tile[shared] & np.uint64(63)).astype(np.int64)


def _stars(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Rows (a, b, band, tiles): b is in so many shared tiles of which a is the smallest set, a
    itself among them.

    Entries (tile, set) travel packed, by ranges of the tile's hash. There are several ranges for
    each shuffle partition, and one at a time is sorted in a task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                packed = []
                for text in batch["text"].slice(at, 1000).to_pylist():
                    values = shingle_set(text, words)
                    if len(values):
                        tiles = _tiles_of(values, threshold)
                        entries = np.empty(len(tiles), _ENTRY)
                        entries["tile"], entries["node"] = tiles, node_of(set_hash(values))
                        packed.append(entries)
                if not packed:
                    continue
                entries = np.concatenate(packed)
                where = (entries["tile"] >> np.uint64(33)) % np.uint64(ranges)
                order = np.argsort(where, kind="stable")
                entries, where = entries[order], where[order].astype(np.int64)
                cuts = np.searchsorted(where, np.arange(ranges + 1)).tolist()
                filled = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled, pa.int32()),
                        pa.array([entries[cuts[k] : cuts[k + 1]].tobytes() for k in filled], pa.binary()),
                    ],
                    ["range", "entries"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(batch["range"].to_pylist(), batch["entries"].to_pylist(), strict=True)
        )
        for _, own in groupby(rows, itemgetter(0)):
            found = stars_of(np.frombuffer(b"".join(data for _, data in own), _ENTRY))
            rows, counts = np.unique(np.stack(found, axis=1), axis=0, return_counts=True)
            columns = [*rows.T, counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["a", "b", "band", "tiles"]
            )

    dealt = _texts(docs).select("text").mapInArrow(deal, "range int, entries binary")
    sorted_ranges = dealt.repartition(parts, "range").sortWithinPartitions("range")
    met = sorted_ranges.mapInArrow(meet, "a bigint, b bigint, band bigint, tiles bigint")
    return met.groupBy("a", "b", "band").agg(F.sum("tiles").alias("tiles"))


def _node() -> Column:
    """``node_of`` as a column."""
    return F.conv(F.hex(F.substring("set_hash", 1, 8)), 16, -10).cast("bigint")


def _compared(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of sets whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            names = ("size_a", "size_b", "bits_a", "bits_b")
            for n, m, x, y in zip(*(batch[c].to_pylist() for c in names), strict=True):
                most = min(n, m)
                keep.append(
                    reaches(most, n, m, threshold)
                    and reaches(overlap_bound(x, y, n, m), n, m, threshold)
                )
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = nodes.select("node", "n_shingles", "bitmap")
    a = side.toDF("a", "size_a", "bits_a")
    b = side.toDF("b", "size_b", "bits_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(
        run, "a bigint, b bigint"
    )


def _arrays(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Sorted arrays of the sets named by ``wanted`` (``node``). Only their texts are read again, by
    the set's smallest id; sets of documents without an id are found among all of those."""
    chosen = nodes.select("node", "doc_id").join(wanted, "node")
    listed = chosen.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("node").alias("nodes"))
    texts = _texts(docs)
    nameless = texts.filter("doc_id IS NULL").withColumn("nodes", F.lit(None).cast("array<bigint>"))
    named = texts.join(listed, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, arrays = [], []
            for text, wanted in zip(batch["text"].to_pylist(), batch["nodes"].to_pylist(), strict=True):
                values = shingle_set(text, words)
                node = node_of(set_hash(values))
                if wanted is None or node in wanted:
                    numbers.append(node)
                    arrays.append(values.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(arrays, pa.binary())], ["node", "values"]
            )

    found, others = (
        part.select("text", "nodes").mapInArrow(sets, "node bigint, values binary") for part in (named, nameless)
    )
    found = found.unionByName(others.join(chosen.filter("doc_id IS NULL"), "node", "left_semi"))
    # Repeated rows may give an array twice, which does no harm.
    return stored(found, "arrays")


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _linked(pairs: DataFrame, found: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs that link, by intersecting their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(reaches(intersection(a, b), len(a), len(b), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = found.toDF("a", "x"), found.toDF("b", "y")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def links_of_blocks(
    left: list[dict], right: list[dict], same: bool, threshold: Fraction
) -> Iterator[tuple[int, int]]:
    """Links between sets of two blocks (``node, label, values``) that join what no label and no
    earlier link joins. ``same``: both are the same block."""
    x = [np.frombuffer(r["values"], np.uint64) for r in left]
    y = [np.frombuffer(r["values"], np.uint64) for r in right]
    sizes = np.array([len(v) for v in y])
    bits = max(64, 1 << (8 * int(max(sizes.max(), max(map(len, x))))).bit_length())

    def bitmap(values: np.ndarray) -> np.ndarray:
        flags = np.zeros(bits, bool)
        flags[(values & np.uint64(bits - 1)).astype(np.int64)] = True
        return np.packbits(flags, bitorder="little").view(np.uint64)

    maps = np.stack([bitmap(v) for v in y])
    counts = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    top: dict[int, int] = {}

    def root(label: int) -> int:
        while label in top:
            label = top[label]
        return label

    for i, (own, values) in enumerate(zip(left, x, strict=True)):
        mine = bitmap(values)
        both = np.bitwise_count(maps & mine).sum(axis=1, dtype=np.int64)
        only_mine, only_theirs = int(np.bitwise_count(mine).sum()) - both, counts - both
        bound = np.minimum(len(values) - only_mine, sizes - only_theirs)
        union = len(values) + sizes - bound
        able = threshold.denominator * bound >= threshold.numerator * union
        if same:
            able[: i + 1] = False
        for j in np.flatnonzero(able).tolist():
            a, b = root(own["label"]), root(right[j]["label"])
            if a != b and reaches(intersection(values, y[j]), len(values), len(y[j]), threshold):
                top[max(a, b)] = min(a, b)
                yield own["node"], right[j]["node"]


def _rest(
    group: DataFrame, label: DataFrame, nodes: DataFrame, arrays: DataFrame, threshold: Fraction
) -> DataFrame:
    """Links between sets of a ``group`` that ``label`` does not join yet.

    A group of up to a block's size is one block. Others are cut into slices by size, so that linked
    sets lie in one slice or in neighbouring ones, and slices by hash.
    """
    placed = group.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = stored(placed, "placed")
    opened = placed.groupBy("group").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
    )
    opened = opened.filter("low < high").select("group", (F.col("size") > BLOCK).alias("many"))
    slices = F.floor(F.log(F.col("n_shingles").cast("double")) / -np.log(float(threshold)) + 1e-9)
    sized = placed.join(opened, "group").join(nodes.select("node", "n_shingles"), "node")
    sized = stored(sized.withColumn("slice", F.when(F.col("many"), slices).otherwise(0)), "open")
    counts = sized.groupBy("group", "slice").agg(F.count(F.lit(1)).alias("count"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / BLOCK))
    blocks = (
        sized.join(counts, ["group", "slice"])
        .join(arrays, "node")
        .groupBy("group", "many", "slice", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct("node", "label", "values")).alias("sets"))
    )
    blocks = stored(blocks, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch[c][i].as_py() if c in batch.schema.names else None for c in ("x", "y"))
                found = list(links_of_blocks(x, y or x, y is None, threshold))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]
                )

    schema = "a bigint, b bigint"
    within = blocks.select(F.col("sets").alias("x")).mapInArrow(run, schema)
    several = blocks.filter("many").drop("many")
    left = several.toDF("group", "slice", "chunk", "x")
    right = several.toDF("group", "other_slice", "other_chunk", "y")
    pairs = left.join(right, "group").filter(
        "slice + 1 = other_slice OR slice = other_slice AND chunk < other_chunk"
    )
    return within.unionByName(pairs.select("x", "y").mapInArrow(run, schema))


def components(links: DataFrame) -> DataFrame:
    """Component (smallest number) of every node of a stored table of links (a, b).

    In each round every node goes to its smallest neighbour and from there to that one's, if they are
    smaller; then the nodes that met become one, and links within them go. So what a round
    moves shrinks with the rounds, however long the chains are. The smallest node of a component
    never moves. At the end the steps of all rounds are put together, the last ones first.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps, folders = [], []
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        near = ends.groupBy("node").agg(F.min("other").alias("near"))
        near = stored(near.select("node", F.least("node", "near").alias("label")), "near")
        hop = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stored(near.join(hop, "label").select("node", F.col("further").alias("label")), "labels")
        steps.append(step)
        a, b = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        moved = edges.filter("a <> b").join(a, "a").join(b, "b").filter("to_a <> to_b")
        folder = scratch_folder(spark, "edges")
        edges = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), folder)
        for old in folders:
            discard(spark, old)
        folders = [folder]
        if edges.isEmpty():
            break
    label = steps.pop()
    while steps:
        then = label.select(F.col("node").alias("label"), F.col("label").alias("then"))
        label = steps.pop().join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label"))
        label = stored(label, "labels")
    return label


def classes(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_verified, component, key`` of every document.
    ``n_verified`` counts the links of a set that were verified; sets that others join already are
    not compared. ``component`` numbers components also where no document has an id, and is null
    without shingles; equal rows share ``key``."""
    threshold = Fraction(percent, 100)
    base = stored(_sets(docs, words, threshold).withColumn("node", _node()), "sets")
    # The sets themselves, once each, with their smallest document.
    nodes = stored(
        base.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            *[F.first(c).alias(c) for c in ("n_shingles", "bitmap", "band", "needs")],
        ),
        "nodes",
    )
    stars = stored(_stars(docs, words, threshold), "stars")
    # Sets that share enough tiles of a band to have a partner there.
    own = nodes.select(F.col("node").alias("b"), F.col("band").alias("own_band"), "needs")
    beside = F.pmod(F.col("band") - F.col("own_band"), F.lit(64))
    needed = F.element_at("needs", (beside + 1).cast("int"))
    able = (
        stars.groupBy("b", "band")
        .agg(F.sum("tiles").alias("shared"))
        .join(own, "b")
        .filter(F.col("shared") >= needed)
        .select("b", "band")
    )
    edges = stored(stars.join(able, ["b", "band"]).select("a", "b").distinct(), "edges-of-tiles")
    alive = stored(edges.select(F.col("b").alias("node")).distinct(), "alive")
    arrays = _arrays(alive, docs, nodes, words)
    both = edges.filter("a <> b").join(alive.withColumnRenamed("node", "a"), "a")
    candidates = stored(_compared(both, nodes, threshold), "pairs")
    links = stored(_linked(candidates, arrays, threshold), "links")
    label = components(links)
    # Sets that tiles connect, also through one that has no partner itself.
    group = components(edges.filter("a <> b")).withColumnRenamed("label", "group").join(alive, "node")
    more = _rest(group, label, nodes, arrays, threshold)
    links = stored(links.unionByName(more), "links")
    label = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    # The component's smallest document over all copies of all its sets.
    joined = nodes.select("node", F.col("doc_id").alias("own")).join(label, "node", "left").join(degree, "node", "left")
    joined = stored(joined.withColumn("label", F.coalesce("label", "node")), "joined")
    smallest = joined.groupBy("label").agg(F.min("own").alias("component_id"))
    named = joined.join(smallest, "label").select(
        "node", "component_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified"), F.col("label").alias("component")
    )
    result = base.select("doc_id", "n_shingles", "node", "key").join(named, "node", "left")
    return result.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_verified", F.lit(0)).cast("bigint").alias("n_verified"),
        "component",
        "key",
    )


def representatives(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest ``doc_id`` (null last), then of
    the smallest key of the whole row; of repeated rows one. Rows without words are in no component
    and all stay. Only rows that are repeated are shuffled with their texts to be made distinct."""
    rows = classes(docs, words, percent)
    keys = rows.groupBy("key").agg(
        F.min("component").alias("component"),
        F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("many"),
    )
    keys = stored(keys, "keys")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "many")).alias("best")
    first = keys.filter("component IS NOT NULL").groupBy("component").agg(best).select("best.key", "best.many")
    kept = first.unionByName(keys.filter("component IS NULL").select("key", F.lit(1).cast("bigint").alias("many")))
    kept = stored(kept.withColumnRenamed("key", "_key"), "representatives")
    keyed = docs.withColumn("_key", _row(docs))
    once = keyed.join(kept.filter("many = 1"), "_key", "left_semi")
    repeated = keyed.join(kept.filter("many > 1"), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(repeated).select(*docs.columns)
