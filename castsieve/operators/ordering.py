"""Sorting and dense numbering.

Row order is data here: ``id`` is the position of a row in its list.  Numbering
uses one range shuffle and per-partition counts, never a global window.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import display_name
from ..functions.text import sort_key
from ..workspace import materialize

# monotonically_increasing_id keeps the partition above this bit.
_PARTITION_BIT = 33


def renumber(
    df: DataFrame, *order: Column, id_column: str = "id", columns: list[str] | None = None
) -> DataFrame:
    """Number rows 0..n-1 in the given order, which must be total.

    ``columns`` are the columns to keep besides the number, by default all.  The
    numbered table is written once, so that the numbers stay what they are.
    Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    kept = [c for c in columns or df.columns if c != id_column]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*kept, F.monotonically_increasing_id().alias("_mark"))
    )
    placed = materialize(placed, "ordered").withColumn(
        "_part", F.shiftrightunsigned("_mark", _PARTITION_BIT)
    )
    counts = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = spark.createDataFrame(
        [(part, start) for (part, _), start in zip(counts, starts)] or [(0, 0)],
        "_part long, _start long",
    )
    within = F.col("_mark") - F.shiftleft("_part", _PARTITION_BIT)
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_start") + within).alias(id_column), *kept
    )


def sort_channels(df: DataFrame, by: str = "none", descending: bool = False) -> DataFrame:
    """Sort by ``name``, ``group`` or ``group-name`` ignoring case and renumber.

    Ties keep their order, also when descending.  ``none`` returns the rows as
    they are, numbers included.
    """
    name = sort_key(display_name(F.col("name"), F.col("tvg_name")))
    group = sort_key(F.col("group_name"))
    keys = {"none": [], "name": [name], "group": [group], "group-name": [group, name]}[by]
    if not keys:
        return df
    named = {f"_key{i}": key for i, key in enumerate(keys)}
    order = [F.desc(k) if descending else F.asc(k) for k in named]
    return renumber(df.withColumns(named), *order, F.asc("id"), columns=df.columns).select(*df.columns)


def first_epg(df: DataFrame) -> DataFrame:
    """The first non-empty programme-guide link, as one row."""
    filled = F.coalesce(F.col("epg_url"), F.lit("")) != ""
    return df.where(filled).agg(F.min_by("epg_url", "id").alias("epg_url"))
