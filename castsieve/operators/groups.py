"""Splitting by group, and the numbers of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import effective_group
from ..functions.text import fold, sort_key
from ..workspace import materialize
from .dedupe import group_labels
from .lookup import lookup
from .ordering import renumber


def with_group_label(df: DataFrame) -> DataFrame:
    """Add ``group_label``: the first spelling of the row's group."""
    labels = materialize(group_labels(df).drop("rows"), "groups")
    keyed = (
        df.withColumn("_group", effective_group(F.col("group_name")))
        .withColumn("group_key", fold(F.col("_group")))
        .drop("_group")
    )
    return lookup(keyed, labels, "group_key", F.col("id")).drop("group_key")


def split_by_group(df: DataFrame) -> DataFrame:
    """Rows with their ``group_label``, numbered group after group."""
    columns = [*df.columns, "group_label"]
    order = [F.asc("_group_order"), F.asc("id")]
    keyed = with_group_label(df).withColumn("_group_order", sort_key(F.col("group_label")))
    return renumber(keyed, *order, columns=columns).select(*columns)


def group_count() -> Column:
    """Number of groups, ignoring case."""
    return F.count_distinct(fold(effective_group(F.col("group_name"))))


def one_row(figures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Aggregates over different tables, side by side in one row.

    Tables named several times are read once for all their figures.
    """
    by_table: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, (df, figure) in figures.items():
        by_table.setdefault(id(df), (df, {}))[1][name] = figure
    rows = None
    for df, columns in by_table.values():
        row = df.agg(*[c.cast("bigint").alias(n) for n, c in columns.items()])
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows.agg(*[F.max(name).alias(name) for name in figures])


def processing_report(
    original: DataFrame,
    deduplicated: DataFrame,
    enriched: DataFrame,
    working: DataFrame,
    categorized: bool = True,
    languages: bool = True,
) -> DataFrame:
    """The seven figures of a run as a one-row table.

    Categories and languages count what the run added: those after the step less
    those before, 0 for a step that is off.
    """
    everything = F.count("*")
    with_category, with_language = F.count_if(F.col("category") != "Unknown"), F.count("language")
    figures = {}
    if categorized:
        figures |= {"categorized_before": (deduplicated, with_category), "categorized_after": (enriched, with_category)}
    if languages:
        figures |= {"languages_before": (deduplicated, with_language), "languages_after": (enriched, with_language)}

    def added(name: str) -> Column:
        known = f"{name}_after" in figures
        return (F.col(f"{name}_after") - F.col(f"{name}_before")) if known else F.lit(0).cast("bigint")

    report = one_row(
        {
            "working_count": (working, everything),
            "group_count": (working, group_count()),
            "total_count": (enriched, everything),
            **figures,
            "original_count": (original, everything),
            "kept_count": (deduplicated, everything),
        }
    )
    return report.select(
        "working_count",
        "total_count",
        (F.col("original_count") - F.col("kept_count")).alias("doubles_removed_count"),
        "original_count",
        "group_count",
        added("categorized").alias("categorized_count"),
        added("languages").alias("languages_count"),
    )
