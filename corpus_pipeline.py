"""A cleaning pipeline for documents, from raw texts to packed sequences.

Stages take the documents that the stage before has kept and return those they
keep, with the columns of ``documents``; the last returns one row per packed piece.
Documents are expected to have different ids; rows that repeat an id are treated as
documents of their own by every stage but count as one where ids are reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castsieve.llm import quality
from castsieve.llm.decontamination import without_passages
from castsieve.llm.line_dedup import without_repeated_lines
from castsieve.llm.ngram_join import without_similar
from castsieve.llm.packing import cut, pack
from castsieve.workspace import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on these documents, accepts."""
    return quality.accepted(docs, quality.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; ``n_chars`` follows the text."""
    return with_length(without_repeated_lines(docs, least=1))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar ones: five words, similarity 0.8."""
    return without_similar(docs, 5, 80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    columns = ["_id", "piece", "start", "length", "ids_crc32"]
    return pack(cut(docs, 2048), 2048, columns).withColumnRenamed("_id", "doc_id")


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, as the characters of the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# No SQL: the classifier, the similarity joins and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
