"""What several operators share: words, hashes of word sequences, row keys, ranks."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Sequence
from functools import wraps
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.session import materialize, scratch_folder

#: Word hashes a Python worker keeps; beyond that it starts over.
WORD_CACHE = 200_000


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="scrapelake-")) / "scrapelake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)


_SHIPPED: set[str] = set()


def on_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage whose workers have this package."""

    @wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder. It stays there for the plans that read it,
    below ``spark.checkpoint.dir``, whose contents the cluster expires."""
    return materialize(frame, scratch_folder(frame.sparkSession, purpose))


def row_key(*columns: str) -> Column:
    """16 bytes that identify the contents of a row; equal rows share them."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized)))


class WordHashes(dict):
    """64-bit hash of a word, each computed once while it stays in the cache."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The worker's word hashes, one cache for all operators.
WORDS = WordHashes()

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finalizer of MurmurHash3)."""
    shift = np.uint64(33)
    values = values ^ (values >> shift)
    values = values * _MIX[0]
    values ^= values >> shift
    values *= _MIX[1]
    values ^= values >> shift
    return values


#: Odd, so that powers have inverses modulo 2^64.
_BASE = 0xD6E8FEB86659FD95
_CHUNK = 1 << 20


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as were asked for."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, 1 << 64))
        self.held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def up_to(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.held[0]) < count:
            for i, base in enumerate(self.bases):
                own = self.held[i]
                self.held[i] = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])
        return self.held[0][:count], self.held[1][:count]


_POWERS = _Powers(_BASE)


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of all beginnings, the empty one first, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total


def _spaces(text: np.ndarray) -> np.ndarray:
    return (text == 32) | (text - np.uint8(9) <= 4)


def _chunk_hashes(text: np.ndarray) -> np.ndarray:
    space = _spaces(text)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first = [] if space[0] else [0]
    last = [] if space[-1] else [len(text)]
    edges = np.concatenate([first, edges, last]).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _POWERS.up_to(len(text) + 1)
    # Bytes count from 1, so that each adds something.
    total = _running((text.astype(np.uint64) + np.uint64(1)) * powers[: len(text)])
    return mixed((total[ends] - total[starts]) * inverses[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word of a text, in order, without making the words: the differences of one
    running sum over the bytes, each with the power of its place, moved to place 0 and mixed."""
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _spaces(data[end : end + 1])[0]:
            end += 1
        parts.append(_chunk_hashes(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n consecutive word hashes by one running sum, whatever n is."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    powers, inverses = _POWERS.up_to(len(hashes))
    total = _running(hashes * powers)
    return mixed((total[n:] - total[:count]) * inverses[:count])


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n consecutive word hashes, in order; empty if there is none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for i in range(1, n):
        total *= _MULTIPLIER
        total += hashes[i : i + count]
    return mixed(total)


def sequence_hash(hashes: np.ndarray) -> bytes:
    """16 bytes that identify a sequence of word hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def numbered(
    rows: DataFrame, keys: list[str], order: list[str], spread: list[str], number: str
) -> DataFrame:
    """Rows with their place, from 0, among the rows of equal ``keys``, ordered by ``order``.

    Rows of equal keys and order are dealt over buckets by a hash of ``spread``, so no task holds
    all rows of a hot key. Places within a bucket come from a window, the bucket's first place
    from a running sum over counts, of which there is one for each key, order and bucket.
    ``rows`` is read twice and so must give the same rows both times. ``spread`` and the other
    columns decide between rows of one bucket, so a repeated row may take either place.
    """
    session = rows.sparkSession
    buckets = max(16, min(256, int(session.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    group = [*keys, *order, "_bucket"]
    counts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("_count"))
    before = W.partitionBy(*keys).orderBy(*order, "_bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(*group, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"))
    placed = dealt.withColumn(
        "_place", F.row_number().over(W.partitionBy(*group).orderBy(*spread)).cast("bigint")
    )
    firsts = firsts.select("_first", *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    joined = placed.join(firsts, condition)
    return joined.select(*rows.columns, (F.col("_first") + F.col("_place") - 1).alias(number))
