"""How far the sources of a language differ in their terms, in exact integers.

Terms are runs of letters (ASCII letters, of which only A-Z are lower-cased, and all other
characters from U+0080 on). A language keeps the terms of at least ``least_docs`` of its rows. In
a group (language and source) a kept term of ``count`` occurrences has the price
``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, with N the group's occurrences of kept terms and
V the number of them. Two prices differ by ``f(p, q) = floor((p - q)^2 / (p + q))``.

Pairs of sources are compared by joint tables: how many terms have count level i in one source
and level j in the other. For a block of ``TERMS`` kept terms, every (source, count level) is a
column of zeros and ones; the product of two such matrices, transposed and not, holds the joint tables
of all pairs of their sources. Counts in it are at most ``TERMS``, so the product is exact. Sources come
in tiles of ``TILE``, so a matrix is bounded however many sources there are. Level 0 is left out of the
matrices and follows from the marginals: with ``g(i, j) = f(i, j) - f(i, 0) - f(0, j) + f(0, 0)``,

    sum of f = sum over joint cells of n(i, j) g(i, j)
             + sum over levels of n(i) (f(i, 0) - f(0, 0)), for either source, + V f(0, 0).

Null text, language and source count as ''. Every row is a document, also a repeated one or one
without an id; ``doc_id`` is not looked at, nor are other columns. A text without terms still makes its
group occur. A language without kept terms has pairs of value 0 and no term rows. Equal values
are ranked by item, as UTF-8. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import numbered, stored

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
TERMS, TILE = 64, 32
#: Counted terms a task holds before it passes them on.
HELD = 200_000

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8. Bytes of other characters are all above 127."""
    return text.translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of every group, and one row with a null term for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                names = [None, *counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(names), pa.string()),
                        pa.array([source] * len(names), pa.string()),
                        pa.array(names, pa.binary()).cast(pa.string()),
                        pa.array([0, *counts.values()], pa.int64()),
                        pa.array([0, *map(docs.__getitem__, counts)], pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "docs"],
                )
            held.clear()

        for batch in batches:
            size = 0
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                counts.update(found)
                docs.update(set(found))
            size = sum(len(counts) for counts, _ in held.values())
            if size > HELD:
                yield from out()
        yield from out()

    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*columns).withColumn("text", F.col("text").cast("binary"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def price(count: Column, occurrences: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (occurrences + 2 kept)), beyond 64 bits on the way."""
    wide = [c.cast("decimal(18,0)") for c in (count, occurrences, kept)]
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide[0] + F.lit(2))
    return F.lit(1).cast("bigint") + F.call_function("div", above, wide[1] + F.lit(2) * wide[2])


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Indicators:
    """Zeros and ones of a block: a row for each term, a column for each source and count level."""

    def __init__(self, items: dict[str, np.ndarray]) -> None:
        levels, level = np.unique(items["count"], return_inverse=True)
        _, first, column = np.unique(
            items["source"] * len(levels) + level, return_index=True, return_inverse=True
        )
        self.matrix = np.zeros((TERMS, len(first)), np.float32)
        self.matrix[items["slot"], column] = 1
        self.source, self.p, self.zero = (items[c][first] for c in ("source", "p", "zero"))


def joint_tables(a: Indicators, b: Indicators) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of ``a`` and ``b`` that share terms, and how many."""
    product = a.matrix.T @ b.matrix
    one, other = np.nonzero(product)
    return one, other, product[one, other].astype(np.int64)


_ITEM = "struct<slot:bigint,source:bigint,count:bigint,p:bigint,zero:bigint>"
_SHARED = "lang string, a bigint, b bigint, value bigint"


def _priced(pairs: DataFrame) -> DataFrame:
    """Sum of n(i, j) g(i, j) for sources a < b that share terms of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, left, right), values in sums.items():
                one, other = np.nonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(one), pa.string()),
                        pa.array(left * TILE + one, pa.int64()),
                        pa.array(right * TILE + other, pa.int64()),
                        pa.array(values[one, other], pa.int64()),
                    ],
                    ["lang", "a", "b", "value"],
                )
            sums.clear()

        def indicators(column: pa.ListArray, i: int) -> Indicators:
            items = column[i].values
            return Indicators({f.name: items.field(f.name).to_numpy() for f in items.type})

        for batch in batches:
            for i in range(batch.num_rows):
                lang, left, right = (batch[c][i].as_py() for c in ("lang", "tile", "tile2"))
                a = indicators(batch["items"], i)
                b = a if left == right else indicators(batch["items2"], i)
                one, other, n = joint_tables(a, b)
                ordered = a.source[one] < b.source[other]
                one, other, n = one[ordered], other[ordered], n[ordered]
                p, q, p0, q0 = a.p[one], b.p[other], a.zero[one], b.zero[other]
                gain = _differences(p, q) - _differences(p, q0) - _differences(p0, q) + _differences(p0, q0)
                total = sums.setdefault((lang, left, right), np.zeros((TILE, TILE), np.int64))
                np.add.at(total, (a.source[one] % TILE, b.source[other] % TILE), n * gain)
                if len(sums) > 256:
                    yield from out()
        yield from out()

    return pairs.mapInArrow(run, _SHARED)


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of all ordered pairs of sources of a language."""
    item = F.struct(
        (F.col("term_no") % TERMS).alias("slot"),
        F.col("source_no").alias("source"),
        "count",
        "p",
        F.col("p0").alias("zero"),
    )
    block = F.floor(F.col("term_no") / TERMS).alias("block")
    tile = F.floor(F.col("source_no") / TILE).alias("tile")
    # At most TERMS times TILE entries each.
    blocks = entries.groupBy("lang", block, tile).agg(F.collect_list(item).alias("items"))
    blocks = stored(blocks, "blocks")
    others = blocks.select("lang", "block", F.col("tile").alias("tile2"), F.col("items").alias("items2"))
    met = blocks.join(others, ["lang", "block"]).filter("tile <= tile2").drop("block")
    shared = _priced(met)
    levels = entries.groupBy("lang", "source_no", "count", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("source_no").alias("b"), F.col("p0").alias("q0"))
    gain = difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0"))
    # Levels meet the sources of their language, as the result itself does.
    single = (
        levels.join(other, "lang")
        .filter(F.col("source_no") != F.col("b"))
        .groupBy("lang", F.col("source_no").alias("a"), "b")
        .agg(F.sum(F.col("n") * gain).alias("value"))
    )
    parts = shared.unionByName(single)
    mirrored = parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    sums = parts.unionByName(mirrored).groupBy("lang", "a", "b").agg(F.sum("value").alias("shared"))
    left = groups.select("lang", "source", F.col("source_no").alias("a"), "kept", "p0")
    right = other.join(groups.select("lang", F.col("source_no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    every = left.join(right, "lang").filter("a <> b")
    value = F.when(F.col("kept") > 0, F.col("kept") * difference(F.col("p0"), F.col("q0"))).otherwise(0)
    return every.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", "item", (value + F.coalesce("shared", F.lit(0))).cast("bigint").alias("value")
    )


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` compares a source with every other
    one of its language, part ``term`` lists the ``top`` terms it has more of than the language."""
    counts = stored(term_counts(docs), "counts")
    kept = (
        counts.filter("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "lang_count")
    )
    kept = stored(numbered(stored(kept, "kept"), ["lang"], [], ["term"], "term_no"), "numbered")
    found = stored(counts.drop("docs").join(kept, ["lang", "term"]), "found")
    languages = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total")
    )
    sums = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = stored(counts.select("lang", "source").distinct(), "groups")
    groups = numbered(groups, ["lang"], [], ["source"], "source_no")
    groups = groups.join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.select(
        "lang",
        "source",
        "source_no",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.col("lang_total"),
    )
    zero = F.when(F.col("kept") > 0, price(F.lit(0), F.col("total"), F.col("kept")))
    groups = stored(groups.withColumn("p0", zero), "priced")
    entries = found.join(groups, ["lang", "source"]).withColumns(
        {
            "p": price(F.col("count"), F.col("total"), F.col("kept")),
            "q": price(F.col("lang_count"), F.col("lang_total"), F.col("kept")),
        }
    )
    entries = stored(entries, "entries")
    words = entries.filter("p > q").select(
        "lang",
        "source",
        F.lit("term").alias("part"),
        F.col("term").alias("item"),
        difference(F.col("p"), F.col("q")).alias("value"),
    )
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    words = words.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    pairs = _pairs(groups, entries).withColumn("part", F.lit("pair"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.select(*words.columns).unionByName(words)
