"""Join rows to a one-row-per-key table without a hot key hurting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, unique: Column) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per ``key``.

    A key that a large share of the rows has is one row of the table, so Spark's
    adaptive execution splits its rows over tasks and gives each of them that row.
    Rows without a key, which match nothing, are spread by ``unique``, a value unique
    per row.
    """
    values = [c for c in table.columns if c != key]
    found = table.select(*[F.col(c).alias(f"_found_{c}") for c in (key, *values)])
    own = F.concat(F.lit("\x00"), unique.cast("string"))
    return (
        rows.withColumn("_spread", F.coalesce(key, own))
        .join(found, F.col("_spread") == F.col(f"_found_{key}"), "left")
        .select(*[F.col(c) for c in rows.columns], *[F.col(f"_found_{c}").alias(c) for c in values])
    )
