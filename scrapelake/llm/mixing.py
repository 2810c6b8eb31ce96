"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times in the mix. The
documents of a source stand in a fixed order, their expected copies are summed up, one offset of
the source is added, and a document is emitted once for every integer its span of the sum
crosses. The order is by size first, and every second stretch of one expected copy runs backwards,
so that neither offset favours the longer documents: a source's words come near its target, not
only its documents.

Null and empty texts have size 0 and are never needed; they are kept in the order like the rest,
so they may be taken (with 0 words). A null source is a source of its own, the last. Repeated
rows are sampled one by one. An empty table gives an empty mix. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import numbered, row_key, stored

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST_COPIES = 3
_ONE = 1 << 32  # a whole copy in fixed point


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.when(
        F.col(text).isNotNull(), F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    ).otherwise(0).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Target words of every source: a row per ``source`` with ``source_size`` and ``target``.

    The targets are weight times one level, but at most ``most`` times the source's size. The
    level is such that they sum up to the size of all sources: sources are sorted by the level at
    which they reach their limit, and running sums tell for each whether the level of the rest
    lies above its own. This is what resharing the excess again and again ends at.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_limit = W.orderBy("full_at", F.col("source").asc_nulls_last())
    below = by_limit.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("limit").over(below), F.lit(0)))
        .withColumn(
            "weight_left",
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
        )
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    )
    # The first source whose limit the level of it and all after it does not pass sets the level.
    reached = F.col("full_at") >= F.col("level")
    level = F.min(F.when(reached, F.struct("full_at", "level"))).over(everything)
    return source.withColumn("final", level["level"]).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull() | (F.col("full_at") <= F.col("final")), F.col("limit"))
        .otherwise(F.col("final") * F.col("weight"))
        .cast("double")
        .alias("target"),
    )


def _class(size: Column) -> Column:
    """Sizes that differ by less than about two hundredths share a class."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) * 50).cast("int")


def copies(
    sizes: DataFrame,
    spread: list[str],
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 1,
) -> DataFrame:
    """``sizes`` (a stored table with ``source`` and ``size``) with ``source_size``, ``target``
    and ``copies``. Sums are in fixed point, so runs agree and no document is taken more than
    ``most`` times. ``spread`` names the columns that order documents of one size class."""
    targets = stored(source_targets(sizes, weights, most), "targets")
    classed = sizes.withColumn("_class", _class(F.col("size")))
    placed = numbered(classed, ["source"], ["_class"], [*spread, "size"], "_place")
    joined = placed.join(
        targets.select(F.col("source").alias("_source"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    step = F.when(
        F.col("source_size") > 0,
        F.least(F.round(F.col("target") / F.col("source_size") * _ONE), F.lit(float(most * _ONE))),
    ).otherwise(0.0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(_ONE))
    # Sums are whole numbers: place * step passes 64 bits in a very large source. A stretch is the
    # places that share the whole part of place * fraction of the step.
    one, wide = f"CAST({_ONE} AS DECIMAL(11,0))", "CAST({} AS DECIMAL(18,0))"
    stretch = f"({wide.format('_place')} * _part) DIV {one}"
    first = f"(({wide.format('_stretch')} * {one} + _part - 1) DIV _part)"
    end = f"(({wide.format('_stretch + 1')} * {one} + _part - 1) DIV _part)"
    turned = f"CASE WHEN _part > 0 AND _stretch % 2 = 1 THEN {first} + {end} - 1 - _place ELSE _place END"
    passed = f"({wide.format('_turned')} * _step + _offset) DIV {one}"
    after = f"({wide.format('_turned + 1')} * _step + _offset) DIV {one}"
    return (
        joined.withColumn("_step", step.cast("decimal(18,0)"))
        .withColumn("_part", F.expr(f"CAST(_step % {one} AS DECIMAL(11,0))"))
        .withColumn("_offset", offset.cast("decimal(11,0)"))
        .withColumn("_stretch", F.expr(stretch))
        .withColumn("_turned", F.expr(turned))
        .withColumn("copies", F.expr(f"{after} - {passed}"))
        .drop("_class", "_place", "_step", "_part", "_offset", "_source", "_stretch", "_turned")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 1,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` (with ``source`` and ``text``), each as often as it
    is taken."""
    own = docs.columns
    keyed = docs.withColumn("_key", row_key(*[c for c, t in docs.dtypes if t != "void"]))
    # Equal rows need no names of their own: what they are taken together is what counts.
    sizes = stored(
        keyed.select("source", "_key", word_count().alias("size")), "mix-sizes"
    )
    taken = stored(
        copies(sizes, ["_key"], weights, most, seed).groupBy("_key").agg(F.sum("copies").alias("_n")),
        "mix-taken",
    )
    once = keyed.dropDuplicates(["_key"]).join(taken.filter("_n > 0"), "_key")
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(
        *own
    )
