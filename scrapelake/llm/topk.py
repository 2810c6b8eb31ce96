"""Exact top-k search by inner product, with a pivot table.

``|q - c|`` is at least ``|d(q, p) - d(c, p)|`` for every pivot p, and
``q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2``. So distances to the pivots, computed once, bound every
score from above. Candidates are evaluated in the order of their bounds until the next bound lies
below the k-th score found.

Distances are kept in single precision, and bounds are widened by what that may be off.

Vectors are kept in blocks of about ``BLOCK`` rows around their nearest pivot; a block's ranges of
pivot distances bound all its scores at once. A query first searches a block near it, which gives it a
k-th score to beat, and then only blocks, and candidates in them, whose bounds reach that score.

A vector that is null or has a null or non-finite component, or whose ``vec_id`` is null, takes no
part. A shorter vector counts as padded with zeros. Rows of the query's own ``vec_id`` are no
candidates. A query row that is repeated is answered once; repeated candidates count each. Ties go
to the smaller ``vec_id``. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import stored

PIVOTS, SAMPLE = 64, 1024
#: What distances kept in single precision may be off, as a share of them.
SLACK = 1e-6
BLOCK, QUERY_BLOCK, METAS = 4096, 512, 256


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of usable rows: each component is ``floor(64 * x)``."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = table.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 64))
    return usable.select(F.col("vec_id").cast("bigint"), whole.alias("vector"))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest first: each pivot is the vector farthest from those before it."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _placed(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their distances to the pivots and the number of the nearest."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _padded(batch["vector"].to_pylist(), width)
            # One pivot after the other: a batch is held once, not once for each pivot.
            distances = np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"],
                    pa.array([r.tobytes() for r in rows.astype("<i8")], pa.binary()),
                    pa.array([d.tobytes() for d in distances.astype("<f4")], pa.binary()),
                    pa.array(distances.argmin(axis=1), pa.int32()),
                ],
                ["vec_id", "vector", "distances", "cell"],
            )

    return table.mapInArrow(run, "vec_id bigint, vector binary, distances binary, cell int")


def _blocks(placed: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows of one cell, as lists. Rows are dealt by hash, so a cell that
    holds most rows becomes many blocks."""
    counts = {r.cell: -(-r["count"] // size) for r in placed.groupBy("cell").count().collect()}
    # At most as many entries as pivots.
    parts: Column = F.lit(1)
    for cell, count in counts.items():
        parts = F.when(F.col("cell") == cell, F.lit(count)).otherwise(parts)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), parts).cast("int"))
    return dealt.groupBy("cell", "part").agg(
        F.collect_list("vec_id").alias(f"{name}_ids"),
        F.collect_list("vector").alias(f"{name}_vectors"),
        F.collect_list("distances").alias(f"{name}_distances"),
    )


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


class Block:
    """Candidates of a block, ready to be searched."""

    def __init__(self, ids: list[int], vectors: list[bytes], distances: list[bytes]) -> None:
        self.ids = np.array(ids, np.int64)
        self.vectors = _matrix(vectors, "<i8")
        self.distances = np.ascontiguousarray(_matrix(distances, "<f4").T)
        self.farthest = float(self.distances.max(initial=0))
        self.floats = self.vectors.astype(float)
        self.squares = (self.floats**2).sum(axis=1)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def scores(self, vector: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact inner products: in floating point as long as every sum is a whole number it can
        hold."""
        if float(np.abs(vector).max(initial=0)) * self.largest * max(1, len(vector)) < 2**53:
            if 4 * len(places) > len(self.ids):
                # So many rows are gathered more slowly than all are multiplied.
                return (self.floats @ vector.astype(float))[places].astype(np.int64)
            return (self.floats[places] @ vector.astype(float)).astype(np.int64)
        return (self.vectors[places].astype(object) @ vector.astype(object)).astype(np.int64)

    def bounds(self, square: float, distances: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of one query, wide enough for rounding."""
        gaps = self.distances - distances[:, None]
        lower = np.abs(gaps, out=gaps).max(axis=0, initial=0).astype(float)
        slack = SLACK * (self.farthest + float(distances.max(initial=0)))
        lower = np.maximum(lower - slack, 0)
        total = square + self.squares
        return (total - lower * lower) / 2 + 1e-9 * total + 1e-6

    def search(
        self, query: int, vector: np.ndarray, distances: np.ndarray, k: int, least: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k candidates that reach ``least``, best first."""
        bounds = self.bounds(float((vector.astype(float) ** 2).sum()), distances)
        alive = np.flatnonzero((bounds >= least) & (self.ids != query))
        order = alive[np.argsort(-bounds[alive])]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, 4 * k
        while at < len(order) and bounds[order[at]] >= least:
            part = order[at : at + step]
            found = self.scores(vector, part)
            good = found >= least
            if good.any():
                ids = np.concatenate([ids, self.ids[part[good]]])
                scores = np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, float(scores[-1]))
            at, step = at + step, step * 8
        return ids, scores


_FOUND = "query_id bigint, query_vector binary, vec_id bigint, score bigint"
_QUERY = ["q_ids", "q_vectors", "q_distances"]
_CANDIDATES = ["c_ids", "c_vectors", "c_distances"]


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Searches each pair of a query block and a candidate block. ``q_least`` is what each query's
    scores must reach; queries of a pair that cannot reach it are null there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                block = Block(*(row[c] for c in _CANDIDATES))
                queries, distances = _matrix(row["q_vectors"], "<i8"), _matrix(row["q_distances"], "<f4")
                names, keys, ids, scores = [], [], [], []
                for j, least in enumerate(row["q_least"]):
                    if least is None:
                        continue
                    query = row["q_ids"][j]
                    found, score = block.search(query, queries[j], distances[j], k, least)
                    names += [query] * len(found)
                    keys += [row["q_vectors"][j]] * len(found)
                    ids.append(found)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(np.concatenate(ids) if ids else [], pa.int64()),
                        pa.array(np.concatenate(scores) if scores else [], pa.int64()),
                    ],
                    ["query_id", "query_vector", "vec_id", "score"],
                )

    return pairs.select(*_QUERY, "q_least", *_CANDIDATES).mapInArrow(run, _FOUND)


def _ranges(blocks: DataFrame) -> DataFrame:
    """Ranges of each block: smallest and largest distance to each pivot, largest square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, square = [], [], []
            for i in range(batch.num_rows):
                block = Block(*(batch[c][i].as_py() for c in _CANDIDATES))
                low.append(block.distances.min(axis=1).tolist())
                high.append(block.distances.max(axis=1).tolist())
                square.append(float(block.squares.max()))
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch["cell"], batch["part"], pa.array(low, kinds), pa.array(high, kinds), pa.array(square, pa.float64())],
                ["cell", "part", "low", "high", "square"],
            )

    return blocks.select("cell", "part", *_CANDIDATES).mapInArrow(
        run, "cell int, part int, low array<double>, high array<double>, square double"
    )


def _reachable(pairs: DataFrame) -> DataFrame:
    """Pairs of blocks in which some query's bound reaches its k-th score: ``q_least`` is null for
    the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                distances = _matrix(row["q_distances"], "<f4").astype(float)
                squares = (_matrix(row["q_vectors"], "<i8").astype(float) ** 2).sum(axis=1)
                least = np.array(row["q_least"], float)
                home = np.array(row["q_home"])
                for meta in row["metas"]:
                    low, high = np.array(meta["low"]), np.array(meta["high"])
                    gap = np.maximum(low - distances, distances - high).max(axis=1)
                    gap = np.maximum(gap - SLACK * (distances.max(axis=1) + high.max()), 0)
                    total = squares + meta["square"]
                    bounds = (total - gap * gap) / 2 + 1e-9 * total + 1e-6
                    alive = (bounds >= least) & ~((meta["cell"] == row["cell"]) & (home == meta["part"]))
                    if alive.any():
                        values = [x if a else None for x, a in zip(least.tolist(), alive.tolist(), strict=True)]
                        out.append((row["cell"], row["part"], meta["cell"], meta["part"], values))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32()] * 4 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["cell", "part", "c_cell", "c_part", "q_least"],
            )

    return pairs.mapInArrow(run, "cell int, part int, c_cell int, c_part int, q_least array<double>")


def search(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k best candidates of every row whose ``vec_id`` is a multiple of ``every``: ``query_id,
    rank, vec_id, score``."""
    spark = table.sparkSession
    rows = stored(vectors(table), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose_pivots(_padded([r.vector for r in sample], width))
    placed = stored(_placed(rows, pivots), "placed")
    blocks = stored(_blocks(placed, BLOCK, "c"), "blocks")
    queries = placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    asked = stored(_blocks(queries, QUERY_BLOCK, "q"), "queries")
    # First search: a block of the query's own cell.
    homes = blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("parts"))
    asked = asked.join(homes, "cell").withColumn("home", F.pmod("part", "parts").cast("int"))
    near = asked.withColumn("q_least", F.transform("q_ids", lambda _: F.lit(float("-inf"))))
    pairs = near.drop("part").join(blocks.withColumnRenamed("part", "home"), ["cell", "home"])
    first = stored(_searched(pairs, k), "first")
    kth = first.groupBy("query_id", "query_vector").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least")
    )
    # Then all other blocks that may hold something better.
    one = F.arrays_zip("q_ids", "q_vectors", "q_distances")
    single = asked.select("cell", "part", "home", F.explode(one).alias("q")).select(
        "cell", "part", "home", F.col("q.q_ids").alias("query_id"), F.col("q.q_vectors").alias("query_vector"), F.col("q.q_distances").alias("d")
    )
    told = single.join(kth, ["query_id", "query_vector"], "left")
    item = F.struct("query_id", "query_vector", "d", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "home")
    told = told.groupBy("cell", "part").agg(F.collect_list(item).alias("q"))
    told = stored(
        told.select(
            "cell",
            "part",
            F.col("q.query_id").alias("q_ids"),
            F.col("q.query_vector").alias("q_vectors"),
            F.col("q.d").alias("q_distances"),
            F.col("q.least").alias("q_least"),
            F.col("q.home").alias("q_home"),
        ),
        "told",
    )
    # Query blocks meet lists of block ranges; neither grows, only their number does.
    ranges = stored(_ranges(blocks), "ranges")
    lists = -(-ranges.count() // METAS)
    listed = ranges.groupBy(F.pmod(F.xxhash64("cell", "part"), F.lit(lists)).cast("int").alias("list")).agg(
        F.collect_list(F.struct("cell", "part", "low", "high", "square")).alias("metas")
    )
    fanned = told.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
    alive = stored(_reachable(fanned.join(listed, "list")), "alive")
    targets = blocks.withColumnRenamed("cell", "c_cell").withColumnRenamed("part", "c_part")
    pairs = alive.join(told.drop("q_least", "q_home"), ["cell", "part"]).join(targets, ["c_cell", "c_part"])
    found = first.unionByName(_searched(pairs, k))
    best = W.partitionBy("query_id", "query_vector").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
