"""The registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives as negatives
from . import language_model, licenses, quality, vector_codes
from .common import table
from .decontamination import find_passages
from .exact_dedup import exact_duplicates
from .language import fit, held_out, predict
from .line_dedup import repeated_lines
from .ngram_join import similar_groups
from .packing import cut, pack
from .sharding import shard_rows
from .token_files import read_tokens, write_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among all documents and their lines."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


ORACLE["op1_license_scans"] = licenses.comparison_sql()


@register
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and a similarity of 0.9."""
    return similar_groups(table(spark, sf_dir, "documents"), 3, 90).drop("first")


@register
def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2))


@register
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose numbers of rows differ by one at most."""
    return shard_rows(table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that repeat an earlier line, exactly or nearly."""
    found = repeated_lines(table(spark, sf_dir, "documents"), least=1)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@register
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the scorer trained on weak labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs), keep=["doc_id"])


@register
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all benchmark items in all documents."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        "contaminated",
    )


@register
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens at most."""
    pieces = cut(table(spark, sf_dir, "documents"), 2048, "word_bpe_49k.json", end_id=0)
    columns = ["_id", "piece", "start", "length", "ids_crc32"]
    return pack(pieces, 2048, columns).withColumnRenamed("_id", "doc_id")


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    codes = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, codes, keep=["doc_id", held_out().alias("held_out")])


@register
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = language_model.held_out()
    fitted = language_model.fit(docs.where(~held))
    return language_model.score(docs, fitted, keep=["doc_id", held.alias("held_out")])


@register
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four-byte codes, with their errors and the digest of the codebooks."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_error(codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


ORACLE["op12_vector_codes"] = vector_codes.comparison_sql()


@register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding; every seventh row has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted))


ORACLE["op13_hard_negatives"] = negatives.comparison_sql()

ORACLE["op6_exact_dedup"] = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
