"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrapelake.llm import (
    chat,
    debruijn,
    divergence,
    edits,
    fingerprint,
    jaccard,
    mixing,
    negatives,
    packing,
    quality,
    secret_scan,
    token_files,
    topk,
)
from scrapelake.llm.common import documents, on_workers, stored
from scrapelake.llm.oracle import ORACLE as ORACLE
from scrapelake.session import scratch_folder


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir)).drop("key", "removed")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard.classes(documents(spark, sf_dir), words=3, percent=90)
    return classes.drop("n_verified", "component", "key")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: its source inserted after a third,
    twenty characters deleted in the middle, its last ten replaced by its language."""
    docs = documents(spark, sf_dir)
    size = F.length(F.coalesce("text", F.lit("")))

    def edit(start, length: int, text):
        return F.struct(
            start.cast("int").alias("start"), F.lit(length).alias("length"), text.alias("text")
        )

    changes = F.array(
        edit(F.floor(size / 3), 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
        edit(F.floor(size / 2), 20, F.lit("")),
        edit(F.greatest(size - 10, F.lit(0)), 10, F.coalesce("lang", F.lit(""))),
    )
    return edits.edited_counts(docs.select("doc_id", "text", changes.alias("edits")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    own = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    return chat.digests(chat.formatted(own.unionByName(extra)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sizes = stored(docs.select("doc_id", "source", mixing.word_count().alias("size")), "sizes")
    taken = mixing.copies(sizes, ["doc_id"])
    return taken.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written(documents(spark, sf_dir), scratch_folder(spark, "token-files"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicated(documents(spark, sf_dir))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(documents(spark, sf_dir))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table.withColumn("label", moved))


_ALL = (
    op1_quality_rules,
    op2_jaccard_join,
    op3_topk_search,
    op4_token_counts,
    op5_chat_formatting,
    op6_mixing,
    op7_packing,
    op8_secret_scans,
    op9_token_files,
    op10_substring_dedup,
    op11_document_fingerprints,
    op12_divergence_audit,
    op13_hard_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: on_workers(query) for query in _ALL
}
