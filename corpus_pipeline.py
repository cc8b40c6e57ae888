"""A training corpus from raw documents, in stages that each pass their rows on as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.functions.tables import drop_tables, write_and_clear
from quillgraph.llm.decontaminate import clean
from quillgraph.llm.packing import pack
from quillgraph.llm.quality import keep_good
from quillgraph.llm.secrets import redact
from quillgraph.llm.shingles import keep_one_of_each_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest ``doc_id`` of each group of near copies: similarity 0.8 or more on five-word shingles, the verified form of SimHash near-dedup."""
    return keep_one_of_each_similar(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; fewer hit words than that are cut out of the text."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Perplexity models and token ids are beyond SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's input and what it stored on the way are deleted once its output stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = write_and_clear(spark, lambda stage=stage, rows=before: stage(spark, rows, sf_dir), f"stage-{name}")
        drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
