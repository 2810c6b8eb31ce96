"""The documents table as packed training sequences, in five stages.

Quality rules reject documents and remove lines that a host repeats; of near duplicates the
smallest document stays; secrets are masked; sources are mixed to their weights; the mix is packed.
Every stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrapelake.llm import jaccard, mixing, packing, quality, secret_scan
from scrapelake.llm.common import on_workers, stored

#: Near duplicates share words in fives and this percentage of them.
SHINGLE_WORDS, SIMILARITY = 5, 80


@on_workers
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a text count once for its lines: the next stage removes them, so here they must
    not make all their lines common and vanish altogether."""
    return quality.cleaned(docs, copies_once=True)


@on_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with its smallest ``doc_id``. Rows without words have no
    component of their own to lose in and stay."""
    return jaccard.representatives(docs, SHINGLE_WORDS, SIMILARITY)


@on_workers
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


@on_workers
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@on_workers
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in the sequences."""
    return packing.packed(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Packing needs token ids, which SQL cannot make; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
