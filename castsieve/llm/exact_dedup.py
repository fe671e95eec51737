"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition reduces its rows to a run: one row per digest, sorted by
digest, with the identifier to keep and a count.  Runs are merged up a binomial
tree, four of its rounds at a time: in each step the runs of ``FAN_IN`` neighbouring
nodes are exchanged by (parent node, digest), sorted together by digest and
identifier, and merged by going along the sorted rows: of equal digests the first
identifier stays, with the sum of the counts.  A digest that a third of all rows
share is one row per run after the first step, and at most ``FAN_IN`` rows per
parent in every later one, so no task ever gathers a group of copies.  The way back
down is a join by (run, digest), which splits the same group over its runs.

Two texts count as equal only if their SHA-256, their length and a 64-bit hash of
another family agree; all three are compared at every level, so a row that differs
in one of them is never merged.  The texts themselves are not compared again: by the
birthday bound, 10^12 texts hold an unequal pair that agrees in all three with a
probability below 10^-70.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize
from .common import whole_text

# Runs merged into one at each level.
FAN_IN = 16

_KEY = ["_sha", "_size", "_hash"]


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and who stays.

    Columns: the id, ``keep_id`` (id of the row that stays), ``group_size``,
    ``kept``, ``text_sha256`` (lower-case hex of the UTF-8 bytes).  ``keep`` is
    "smallest" or "largest" id.

    Texts are equal when their bytes are.  Null counts as the empty text; empty
    texts form one group.  A null id never stays when its group has another.
    Repeated rows (same id, same text) count singly in ``group_size`` and share
    the decision.  Other columns are ignored, whatever their names.  An empty
    table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    # A null id comes last.
    first: Column = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    value = whole_text(f"`{text}`")
    rows = materialize(
        docs.select(
            F.col(f"`{id_column}`").alias("_id"),
            F.unhex(F.sha2(value.cast("binary"), 256)).alias("_sha"),
            F.octet_length(value).cast("long").alias("_size"),
            F.xxhash64(value).alias("_hash"),
            F.spark_partition_id().alias("_run"),
        ),
        "digests",
    )
    best = F.min("_id") if keep == "smallest" else F.max("_id")
    runs = rows.groupBy("_run", *_KEY).agg(best.alias("_id"), F.count(F.lit(1)).alias("_n"))
    runs = materialize(runs.sortWithinPartitions("_run", *_KEY), "runs")
    last = runs.agg(F.max("_run")).first()[0] or 0
    top = _merge(runs, last, first)
    decided = runs.select("_run", *_KEY).join(
        top.select(*_KEY, F.col("_id").alias("keep_id"), F.col("_n").alias("group_size")), _KEY
    )
    return rows.join(decided, ["_run", *_KEY], "left").select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _merge(runs: DataFrame, last: int, first: Column) -> DataFrame:
    """Merge the runs 0..last in rounds; the rounds grow with the log of their number.

    The rows of a node are sorted by digest and identifier, and every row that begins
    a digest takes the counts of those that follow it.
    """
    level = runs.withColumnRenamed("_run", "_node")
    while True:
        level = level.withColumn("_node", F.floor(F.col("_node") / FAN_IN).cast("int"))
        same = Window.partitionBy("_node", *_KEY).orderBy(first)
        following = same.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = (
            level.withColumn("_place", F.row_number().over(same))
            .withColumn("_n", F.sum("_n").over(following))
            .where("_place = 1")
            .drop("_place")
        )
        last //= FAN_IN
        if last == 0:
            return level


def without_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Ids must be unique and not null: rows are found again by their id.
    """
    stays = exact_duplicates(docs, id_column, text, keep).where("kept").select(F.col(id_column).alias("_stays"))
    return docs.join(stays, F.col(f"`{id_column}`") == F.col("_stays"), "left_semi").select(*docs.columns)
