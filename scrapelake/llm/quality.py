"""Quality rules: measures of single documents, and lines that many documents of a host share.

Lines are normalised (lower-cased in A-Z, runs of white space as one space) and hashed. A line that
stands in more than ``LINE_LIMIT`` distinct documents of its host is boilerplate and is removed.
Documents are told apart by id and text, so copies of a text under different ids count each; with
``copies_once`` documents of the same normalised lines in the same order are one document for this
count, for use before near duplicates are removed. A document that keeps less than ``LEAST_KEPT``
percent of its words is depleted and rejected.

A null text is empty: it has no words and fails the base rules. A null host is a host of its own.
Repeated rows count once and get the same verdict. Lines and texts of any length are processed
whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrapelake.llm.common import WORDS, ngram_hashes, row_key, sequence_hash, stored

LINE_LIMIT = 30
LEAST_KEPT = 30
LEAST_WORDS = 50
MOST_REPEATED = 50
_SYMBOLS = b"#*$%&|<>"
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line: bytes) -> int:
    """Hash of a normalised line, as a signed number."""
    value = xxhash.xxh3_64_intdigest(b" ".join(line.split()).lower())
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the list."""
    windows = ngram_hashes(WORDS.of(words), width)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    covered = np.zeros(len(words), bool)
    starts = np.flatnonzero(np.isin(windows, twice))
    for i in range(width):
        covered[starts + i] = True
    return int(covered.sum())


def measures(text: bytes) -> tuple:
    """The base measures, then hashes and words of the distinct normalised lines, then a hash of
    these lines together, which is null without any."""
    lines = text.split(b"\n")
    split = [line.split() for line in lines]
    words = [w for s in split for w in s]
    joined = b"".join(words)
    seen: set[bytes] = set()
    repeated = 0
    counts: dict[int, int] = {}
    for line, own in zip(lines, split, strict=True):
        if not own:
            continue
        repeated += line in seen
        seen.add(line)
        number = line_hash(line)
        counts[number] = counts.get(number, 0) + len(own)
    content = int.from_bytes(sequence_hash(np.array(list(counts), np.int64))[:8], "big", signed=True) if counts else None
    return (
        len(words),
        len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        repeated,
        repeated_words(words),
        list(counts),
        list(counts.values()),
        content,
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures of every row, with ``key`` for its contents and ``host``."""
    names = ["key", "doc_id", "host", *_MEASURES, "lines", "line_words", "content"]
    longs = pa.list_(pa.int64())
    kinds = [pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 5, longs, longs, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = zip(*(measures(t or b"") for t in part["text"].to_pylist()), strict=True)
                made = [pa.array(c, t) for c, t in zip(found, kinds[3:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["key"].cast(pa.binary()), part["doc_id"], part["host"].cast(pa.string()), *made], names
                )

    return docs.select(
        row_key("doc_id", host, "text").alias("key"),
        F.col("doc_id").cast("bigint"),
        F.col(host).cast("string").alias("host"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(
        run,
        "key binary, doc_id bigint, host string, "
        + ", ".join(f"{m} bigint" for m in _MEASURES)
        + ", lines array<bigint>, line_words array<bigint>, content bigint",
    )


def common_lines(rows: DataFrame, limit: int = LINE_LIMIT, copies_once: bool = False) -> DataFrame:
    """``host, line`` of the lines above the limit. A hot line is spread by its documents, which
    makes them distinct, and then is one row for each task."""
    document = F.col("content" if copies_once else "key").alias("document")
    lines = rows.select("host", document, F.explode("lines").alias("line"))
    documents = lines.groupBy("host", "line", "document").agg(F.lit(1).alias("one"))
    counts = documents.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    return counts.filter(F.col("documents") > limit).select("host", "line")


def verdicts(
    docs: DataFrame,
    host: str = "source",
    limit: int = LINE_LIMIT,
    least_kept: int = LEAST_KEPT,
    copies_once: bool = False,
) -> DataFrame:
    """A row per document: measures, ``base_failed``, ``lost_words``, ``kept``, ``key``, and the
    hashes of the lines to remove (null: none)."""
    rows = stored(measured(docs, host), "measures")
    common = stored(common_lines(rows, limit, copies_once), "common-lines")
    common = common.select(F.coalesce("host", F.lit("\0")).alias("host"), "line")
    own = rows.select(
        "key",
        F.coalesce("host", F.lit("\0")).alias("host"),
        F.explode(F.map_from_arrays("lines", "line_words")).alias("line", "words"),
    )
    # Repeated rows share a key, so a line counts once for it.
    lost = (
        own.join(common, ["host", "line"])
        .groupBy("key", "line")
        .agg(F.max("words").alias("words"))
        .groupBy("key")
        .agg(F.sum("words").alias("lost_words"), F.collect_list("line").alias("removed"))
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    enough = 100 * (F.col("n_words") - F.col("lost_words")) >= least_kept * F.col("n_words")
    return (
        rows.join(lost, "key", "left")
        .withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
        .select(
            "doc_id",
            *_MEASURES,
            base_failed.alias("base_failed"),
            (~base_failed & enough).alias("kept"),
            "lost_words",
            "removed",
            "key",
        )
    )


#: Rows whose texts a task holds as Python objects, which take several times their size.
ROWS_AT_ONCE = 500


def cleaned_batches(batches: Iterator[pa.RecordBatch], own: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``own`` of batches, their texts without the lines in ``_removed``."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            texts = []
            for text, removed in zip(part["text"].to_pylist(), part["_removed"].to_pylist(), strict=True):
                if removed:
                    gone = set(removed)
                    lines = text.split("\n")
                    text = "\n".join(
                        x for x in lines if not x or line_hash(x.encode()) not in gone
                    )
                texts.append(text)
            place = part.schema.get_field_index("text")
            out = part.set_column(place, "text", pa.array(texts, part.schema.field(place).type))
            yield out.select(own)


def cleaned(
    docs: DataFrame,
    host: str = "source",
    limit: int = LINE_LIMIT,
    least_kept: int = LEAST_KEPT,
    copies_once: bool = False,
) -> DataFrame:
    """The kept documents without the removed lines, in the columns of ``docs``; ``n_chars``, if
    there, follows the text."""
    own = docs.columns
    kept = verdicts(docs, host, limit, least_kept, copies_once).filter("kept").select(
        F.col("key").alias("_key"), F.col("removed").alias("_removed")
    )
    kept = stored(kept.dropDuplicates(["_key"]), "kept")
    joined = docs.withColumn("_key", row_key("doc_id", host, "text")).join(kept, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cleaned_batches(batches, own)

    out = joined.select(*own, "_removed").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in own else out
