"""Document fingerprints by one-permutation MinHash, in built-in column functions only.

The shingles of a text are its sequences of ``SHINGLE`` words (runs of other than ASCII white space),
or all its words as one if there are fewer. Each shingle is hashed once; the upper ``LANE_BITS`` bits
of the hash name one of ``LANES`` bins, and each bin keeps its least hash. An empty bin takes the value of
the first filled bin in an order of its own (optimal densification): ``ATTEMPTS`` pseudo-random bins,
then all bins by a pseudo-random rank. Of every bin the lowest four bits are kept, one
hexadecimal digit each; in binary, ``unhex``, that is 128 bytes a text.

Two different values agree in four bits once in sixteen, so ``likeness`` takes the share s of equal
digits to ``(s - 1/16) / (1 - 1/16)``, from 0 to 1: an estimate of the Jaccard similarity of the
shingle sets with a standard error of at most 0.034. A text without words has an empty fingerprint, which
is like itself (1) and unlike all others (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import stored

SHINGLE = 5
LANE_BITS, VALUE_BITS = 8, 4
LANES = 1 << LANE_BITS
ATTEMPTS = 12

_SPACE = " \t\n\x0b\f\r"
_KEEP = 64 - LANE_BITS
#: All bits below the bin number: the hash that stands for an empty bin.
_EMPTY = (1 << _KEEP) - 1


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\t-\r]+")).otherwise(F.array().cast("array<string>"))


def _hashes(found: Column) -> Column:
    """Hash of every shingle of an array of words."""
    last = F.size(found) - (SHINGLE - 1)
    moved = [F.slice(found, F.lit(1 + i), F.greatest(last, F.lit(0))) for i in range(SHINGLE)]
    # All slices are equally long: a struct of the words of each shingle.
    whole = F.transform(F.arrays_zip(*moved), lambda shingle: F.xxhash64(shingle))
    none = F.array().cast("array<bigint>")
    return F.when(last > 0, whole).when(F.size(found) > 0, F.array(F.xxhash64(found))).otherwise(none)


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, _KEEP)


def _is_empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_EMPTY)) == F.lit(_EMPTY)


def _with_minima(frame: DataFrame, hashes: str, minima: str) -> DataFrame:
    """Least hash of every bin, in order of the bins from 128 on, as the sign sorts them. A hash of
    all ones for every bin makes sure that each has one."""
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)),
        lambda b: F.shiftleft(b.cast("bigint"), _KEEP).bitwiseOR(F.lit(_EMPTY)),
    )
    # A column of its own, so that the filter does not sort anew for each element.
    frame = frame.withColumn(hashes, F.sort_array(F.concat(hashes, ends)))
    held = F.col(hashes)
    first = F.filter(
        held, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(held, F.greatest(i - 1, F.lit(0)))))
    )
    return frame.withColumn(minima, first)


def _value(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << VALUE_BITS) - 1))


def _digits(minima: Column) -> Column:
    """The fingerprint of an array of minima."""

    def filled(i: Column) -> Column:
        """The first filled bin in the order of bin i."""
        tries = [
            F.get(minima, F.xxhash64(i, F.lit(t)).bitwiseAND(F.lit(LANES - 1)).cast("int")) for t in range(ATTEMPTS)
        ]
        early = [F.when(~_is_empty(x), _value(x)) for x in tries]
        ranked = F.transform(
            minima,
            lambda x, j: F.when(~_is_empty(x), F.struct(F.xxhash64(i, j).alias("rank"), _value(x).alias("value"))),
        )
        return F.coalesce(*early, F.array_min(ranked)["value"])

    each = F.transform(minima, lambda x, i: F.lower(F.hex(F.when(_is_empty(x), filled(i)).otherwise(_value(x)))))
    return F.array_join(each, "")


def with_fingerprints(frame: DataFrame, **texts: str) -> DataFrame:
    """Adds the fingerprint of each named text column: ``fingerprint="text"``. Null counts as
    empty."""
    columns = frame.columns
    for name, text in texts.items():
        part = f"_{name}"
        frame = frame.withColumn(part, words(F.coalesce(F.col(text), F.lit(""))))
        frame = frame.withColumn(part, _hashes(F.col(part)))
        frame = _with_minima(frame, part, f"{part}_minima")
        digits = F.when(F.size(part) > LANES, _digits(F.col(f"{part}_minima"))).otherwise(F.lit(""))
        frame = frame.withColumn(name, digits)
    return frame.select(*(c for c in columns if c not in texts), *texts)


def _equal_digits(one: Column, other: Column) -> Column:
    """How many digits agree, 16 at a time as the bits of one number."""

    def number(packed: Column, i: int) -> Column:
        return F.conv(F.substring(packed, 16 * i + 1, 16), 16, -10).cast("bigint")

    counts = []
    for i in range(LANES * VALUE_BITS // 64):
        differ = number(one, i).bitwiseXOR(number(other, i))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        counts.append(F.lit(16) - F.bit_count(differ.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(Column.__add__, counts)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints."""
    chance = 1 / (1 << VALUE_BITS)
    share = _equal_digits(one, other) / F.lit(float(LANES))
    return (
        F.when((one == "") | (other == ""), F.when(one == other, 1.0).otherwise(0.0))
        .when(one == other, 1.0)
        .otherwise(F.greatest(F.lit(0.0), (share - F.lit(chance)) / F.lit(1 - chance)))
    )


# Each document with the next one: descending id, null last, then by a hash of the text.

_ORDER = ["_null", "_down", "_hash"]


def _ordered(docs: DataFrame) -> DataFrame:
    """``doc_id``, text and what they are ordered by, ascending. ``~id`` descends without overflow."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        doc_id.isNull().alias("_null"),
        F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("bigint").alias("_down"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )


def _literal(row) -> Column:
    return F.struct(*(F.lit(row[c]).alias(c) for c in _ORDER))


def _range_of(lasts: list) -> Column:
    """Number of the range a row falls into: of the first range whose last row is not below it.
    Ranges are looked up in two steps of about the square root of their number."""
    own = F.struct(*_ORDER)
    if len(lasts) == 1:
        return F.lit(0)
    width = math.isqrt(len(lasts) - 1) + 1
    parts = [lasts[i : i + width] for i in range(0, len(lasts), width)]
    ends = F.array(*(_literal(p[-1]) for p in parts))
    # Only a row that this pass has not seen could be beyond the last end.
    part = F.least(F.size(F.filter(ends, lambda x: x < own)), F.lit(len(parts) - 1))
    inside = F.element_at(F.array(*(F.array(*map(_literal, p)) for p in parts)), part + 1)
    return part * width + F.least(F.size(F.filter(inside, lambda x: x < own)), F.size(inside) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its place and the text of the next: ``doc_id, text, next_text, range, place``.

    Rows are dealt over ranges of the order, whose limits come from a sort of the ids alone, so texts are
    shuffled once. The last row of a range is followed by the first of the next one, whose text is
    looked up: one text for each range. Rows that share id and text go to one range.
    """
    spark = docs.sparkSession
    rows = _ordered(docs)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*_ORDER)
    # One row for each range.
    ranges = (
        rows.select(*_ORDER)
        .repartitionByRange(parts, *_ORDER)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(key).alias("first"), F.max(key).alias("last"))
        .orderBy("part")
        .collect()
    )
    if not ranges:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), F.lit(0).alias("range"), F.lit(0).alias("place"))
    dealt = rows.withColumn("range", _range_of([r["last"] for r in ranges]).cast("int"))
    starts = spark.createDataFrame(
        [(*ranges[(i + 1) % len(ranges)]["first"], i) for i in range(len(ranges))],
        "_null boolean, _down bigint, _hash bigint, range int",
    )
    firsts = rows.join(F.broadcast(starts), _ORDER).select("range", F.col("text").alias("first_text"))
    firsts = stored(firsts.dropDuplicates(["range"]), "firsts")
    order = W.partitionBy("range").orderBy(*_ORDER)
    placed = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn(
        "place", F.row_number().over(order)
    )
    next_text = F.coalesce("next_text", "first_text").alias("next_text")
    return placed.join(firsts, "range").select("doc_id", "text", next_text, "range", "place")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text: the last third, rounded down, of its code
    points is replaced by as many of the first of the next document, or all that it has.

    Documents follow each other by descending id, then by a hash of the text; rows with a null id come
    last, and after the last row the first one follows. Repeated rows follow each other; each is
    a document. Null texts count as empty. A single row follows itself. An empty table gives no rows;
    other columns are not looked at.
    """
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    changed = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).select(
        "range", "place", "doc_id", F.col("text"), changed.alias("edited"), size.cast("bigint").alias("n_chars")
    )
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "utf-8"), 256))
    printed = with_fingerprints(rows, fingerprint="text", edited_fingerprint="edited")
    printed = stored(printed.drop("text", "edited"), "fingerprints")
    order = W.partitionBy("range").orderBy("place")
    # The first row of each range follows the last one of the range before it: a row a range.
    starts = printed.filter("place = 1").select("range", F.col("fingerprint").alias("first"))
    ring = W.orderBy("range")
    starts = starts.select(
        "range",
        F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("first"),
    )
    following = F.coalesce(F.lead("fingerprint").over(order), F.col("first"))
    told = printed.join(starts, "range").withColumn("following", following)
    return told.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
