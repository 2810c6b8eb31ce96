"""Hard negatives of anchors: rows of other labels that score a little below a positive.

Every row keeps its norm and its angles to ``REFERENCES`` reference directions. By the triangle
inequality on the sphere the angle between two rows is at least ``|x - y|`` and at most ``x + y`` and
``2 pi - x - y``, for their angles x and y to any reference. The cosines of these limits times both
norms, widened for rounding, bound the score from both sides. Only rows whose bounds overlap what an anchor
looks for are scored, with exact integers: for positives, scores that reach the anchor's best lower
bounds; for negatives, the score windows of its positives.

Rows are kept in blocks of about ``BLOCK``, dealt by hash, so a label that holds most rows fills as many
blocks as it needs. Anchors travel to the blocks, ``ANCHOR_BLOCK`` at a time, and are compared ``TILE`` at a
time. All anchors go to every block, many times the size of their table, so that join is never a broadcast.

Vectors become ``floor(scale * x)`` by component. A row with a null ``vec_id``, label or vector, or a null or
non-finite component, takes no part. A shorter vector counts as padded with zeros. Rows of the
anchor's own ``vec_id`` are neither its positives nor its negatives. An anchor row that is repeated is
answered once; repeated positives and negatives count each. Ties go to the smaller ``vec_id``. A
negative positive score has an empty window. An empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.llm.common import row_key, stored

REFERENCES, SAMPLE = 16, 1024
BLOCK, ANCHOR_BLOCK, TILE, FEW = 4096, 2048, 128, 16
#: What angles stored in single precision, and the arithmetic on them and on their cosines, may be off.
ANGLE_SLACK, SLACK = 2e-6, 1e-6
_RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)


def vectors(table: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = table.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad
    )
    return usable.select(
        F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"),
    )


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1)[:, None], norms


def choose_references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other: each is the sampled one whose largest cosine to those
    before it is smallest."""
    units, norms = _units(sample)
    units = units[norms > 0]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], np.full(len(units), -np.inf)
    while len(chosen) < min(count, len(units)):
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
        chosen.append(int(nearest.argmin()))
    return units[chosen]


def angles(rows: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references; a zero vector is at right angles to all."""
    units, norms = _units(rows)
    return norms, np.arccos(np.clip(units @ references.T, -1, 1)).astype(np.float32)


def bounds(
    one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the scores of every row of ``one`` with every row of ``other``."""
    (norm, x), (norm2, y) = one, other
    pi, off = np.float32(np.pi), np.float32(ANGLE_SLACK)
    columns = np.ascontiguousarray(y.T)
    low, high = np.empty((2, len(norm), len(norm2)))
    # A few rows at a time, so that what is compared stays in the processor's cache.
    for at in range(0, len(norm), FEW):
        rows = slice(at, at + FEW)
        # The least of x + y and 2 pi - x - y is pi - |x + y - pi|.
        nearest, across, gap = np.zeros((3, len(norm[rows]), len(norm2)), np.float32)
        for left, right in zip(x[rows].T, columns, strict=True):
            np.subtract(left[:, None], right, out=gap)
            np.maximum(nearest, np.abs(gap, out=gap), out=nearest)
            np.add((left - pi)[:, None], right, out=gap)
            np.maximum(across, np.abs(gap, out=gap), out=across)
        product = norm[rows, None] * norm2[None, :]
        slack = SLACK * product + 1e-6
        high[rows] = product * np.cos(np.maximum(nearest - off, 0)) + slack
        low[rows] = product * np.cos(np.minimum(pi - across + off, pi)) - slack
    return low, high


def scores(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum is a whole number it can hold."""
    largest = float(np.abs(one).max(initial=0)) * float(np.abs(other).max(initial=0))
    if largest * max(1, one.shape[1]) < 2**53:
        return (one.astype(float) @ other.T.astype(float)).astype(np.int64)
    return (one.astype(object) @ other.T.astype(object)).astype(np.int64)


def _placed(table: DataFrame, references: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _padded(batch["vector"].to_pylist(), references.shape[1])
            norms, held = angles(rows, references)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"],
                    batch["label"],
                    pa.array([r.tobytes() for r in rows.astype("<i8")], pa.binary()),
                    pa.array(norms, pa.float64()),
                    pa.array([a.tobytes() for a in held], pa.binary()),
                ],
                ["vec_id", "label", "vector", "norm", "angles"],
            )

    return table.mapInArrow(run, "vec_id bigint, label bigint, vector binary, norm double, angles binary")


class Rows:
    """Rows of a block as arrays, by label and id."""

    def __init__(self, items: pa.StructScalar, width: int) -> None:
        field = {f.name: items.values.field(f.name) for f in items.values.type}
        ids, labels = (field[c].to_numpy() for c in ("vec_id", "label"))
        order = np.lexsort((ids, labels))
        self.order, self.ids, self.labels = order, ids[order], labels[order]
        self.vectors = self._matrix(field["vector"], "<i8", len(ids), width)[order]
        self.angles = self._matrix(field["angles"], "<f4", len(ids))[order]
        self.norms = field["norm"].to_numpy()[order]

    @staticmethod
    def _matrix(column: pa.Array, kind: str, count: int, width: int = -1) -> np.ndarray:
        packed = b"".join(column.to_pylist())
        return np.frombuffer(packed, kind).reshape(count, width if packed or width > 0 else 0)

    def label(self, value: int) -> slice:
        return slice(*np.searchsorted(self.labels, [value, value + 1]))

    def bounds(self, rows: slice, other: Rows, others: slice) -> tuple[np.ndarray, np.ndarray]:
        return bounds(
            (self.norms[rows], self.angles[rows]), (other.norms[others], other.angles[others])
        )


def best(values: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest values, ties to the earlier place, largest first."""
    if len(values) > count:
        least = -np.partition(-values, count - 1)[count - 1]
        places = np.flatnonzero(values >= least)
    else:
        places = np.arange(len(values))
    return places[np.argsort(-values[places], kind="stable")][:count]


def _tiles(rows: slice) -> Iterator[slice]:
    return (slice(at, min(at + TILE, rows.stop)) for at in range(rows.start, rows.stop, TILE))


def positives(anchors: Rows, block: Rows, count: int) -> Iterator[tuple[int, int, int]]:
    """Anchor's place, and id and score of its best rows of its label in the block. A row whose
    upper bound is below ``count`` lower bounds is not scored."""
    for value in np.unique(anchors.labels):
        every, rows = anchors.label(value), block.label(value)
        size = rows.stop - rows.start
        for own in _tiles(every) if size else ():
            low, high = anchors.bounds(own, block, rows)
            ids = block.ids[rows]
            other = ids[None, :] != anchors.ids[own, None]
            low = np.where(other, low, -np.inf)
            least = -np.partition(-low, count - 1, axis=1)[:, count - 1] if size >= count else np.full(len(low), -np.inf)
            alive = other & (high >= least[:, None])
            used = np.flatnonzero(alive.any(axis=0))
            found = scores(anchors.vectors[own], block.vectors[rows][used])
            for i in range(len(found)):
                mine = used[alive[i, used]]
                values = found[i, alive[i, used]]
                for place in best(values, count):
                    yield own.start + i, int(ids[mine[place]]), int(values[place])


def negatives(
    anchors: Rows, windows: list[list[dict]], block: Rows, count: int, low_pct: int, high_pct: int
) -> Iterator[tuple[int, dict, int, int]]:
    """Anchor's place, its positive, and id and score of the first rows of other labels in that
    positive's window. Rows whose bounds miss all windows of an anchor are not scored."""
    wanted = [[w for w in ws if w["score"] >= 0] for ws in windows]
    floors = np.array([min((low_pct * w["score"] / 100 for w in ws), default=np.inf) for ws in wanted])
    roofs = np.array([max((high_pct * w["score"] / 100 for w in ws), default=-np.inf) for ws in wanted])
    whole = slice(0, len(block.ids))
    for own in _tiles(slice(0, len(anchors.ids))):
        low, high = anchors.bounds(own, block, whole)
        alive = (high >= floors[own, None] - 1) & (low <= roofs[own, None] + 1)
        alive &= block.labels[None, :] != anchors.labels[own, None]
        alive &= block.ids[None, :] != anchors.ids[own, None]
        used = np.flatnonzero(alive.any(axis=0))
        # Ties go to the smaller id, whatever its label.
        used = used[np.argsort(block.ids[used], kind="stable")]
        found = scores(anchors.vectors[own], block.vectors[used])
        for i, ws in enumerate(wanted[own]):
            if not ws:
                continue
            hundred = 100 * found[i]
            least, most = (pick(w["score"] for w in ws) for pick in (min, max))
            near = np.flatnonzero(alive[i, used] & (hundred >= low_pct * least) & (hundred <= high_pct * most))
            mine, values, hundred = used[near], found[i, near], hundred[near]
            for w in ws:
                inside = np.flatnonzero((hundred >= low_pct * w["score"]) & (hundred <= high_pct * w["score"]))
                for place in best(values[inside], count):
                    at = inside[place]
                    yield own.start + i, w, int(block.ids[mine[at]]), int(values[at])


_ROW = ["vec_id", "label", "vector", "norm", "angles"]


def _blocks(rows: DataFrame, keys: int, key: str, items: str, *more: str) -> DataFrame:
    dealt = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(keys)).cast("int").alias(key)
    return rows.groupBy(dealt).agg(F.collect_list(F.struct(*_ROW, *more)).alias(items))


def mine(
    table: DataFrame,
    *,
    scale: int = 256,
    every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
) -> DataFrame:
    """For every row whose ``vec_id`` is a multiple of ``every``, an anchor, and each of its
    ``n_positives`` best rows of the same label: the first ``n_negatives`` rows of other labels whose
    score is from ``low_pct`` to ``high_pct`` per cent of the positive's."""
    spark = table.sparkSession
    rows = stored(vectors(table, scale), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], _RESULT)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = size["width"]
    references = choose_references(_padded([r.vector for r in sample], width))
    placed = stored(_placed(rows, references), "placed")
    n_blocks = -(-size["n"] // BLOCK)
    # Made anew for each of the two joins, already dealt by block: a reader of stored lists takes all of a
    # file's vectors into one buffer.
    blocks = _blocks(placed, n_blocks, "block", "rows")
    asked = placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"])
    asked = stored(asked.withColumn("key", row_key("label", "vector")), "anchors")
    n_asked = -(-asked.count() // ANCHOR_BLOCK)
    if not n_asked:
        return spark.createDataFrame([], _RESULT)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")

    def sent(anchors: DataFrame, *more: str) -> DataFrame:
        """Every block of anchors with every block of rows."""
        packed = _blocks(anchors, n_asked, "part", "anchors", "key", *more).select("anchors", everywhere)
        # Spark takes the exploded anchors for as small as their table, and would send them through the driver.
        return packed.hint("merge").join(blocks, "block").select("anchors", "rows")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, block = (Rows(batch[c][i], width) for c in ("anchors", "rows"))
                keys = batch["anchors"][i].values.field("key").take(pa.array(anchors.order)).to_pylist()
                out = [(int(anchors.ids[a]), keys[a], *found) for a, *found in positives(anchors, block, n_positives)]
                yield _batch(out, ["anchor_id", "key", "positive_id", "score"], [_I, _B, _I, _I])

    found = sent(asked).mapInArrow(first, "anchor_id bigint, key binary, positive_id bigint, score bigint")
    order = W.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "positive_id")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives)
    # At most n_positives for each anchor.
    item = F.struct("place", "positive_id", "score")
    windows = ranked.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list(item).alias("windows"))
    told = stored(asked.join(windows, ["vec_id", "key"]), "windows")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, block = (Rows(batch[c][i], width) for c in ("anchors", "rows"))
                field = {c: batch["anchors"][i].values.field(c).take(pa.array(anchors.order)).to_pylist() for c in ("key", "windows")}
                out = [
                    (int(anchors.ids[a]), field["key"][a], w["place"], w["positive_id"], w["score"], *negative)
                    for a, w, *negative in negatives(anchors, field["windows"], block, n_negatives, low_pct, high_pct)
                ]
                yield _batch(out, ["anchor_id", "key", "place", "positive_id", "positive_score", "negative_id", "negative_score"], [_I, _B, _I, _I, _I, _I, _I])

    hard = sent(told, "windows").mapInArrow(
        second,
        "anchor_id bigint, key binary, place bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    order = W.partitionBy("anchor_id", "key", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_I, _B = pa.int64(), pa.binary()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
