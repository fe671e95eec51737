"""Distinct operators: merge by link, two-key removal, distinct groups.

``id`` is the position of a row; the first position wins everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import effective_group, with_name_key
from ..functions.text import fold, sort_key
from ..functions.urls import with_link_key
from ..workspace import materialize, release
from .ordering import renumber

# Rounds of plain mutual-first matching before chains are followed as well.
PLAIN_ROUNDS = 3
# Rows with the smallest open ids that one task decides in every further round, some 60 bytes each.
PREFIX_ROWS = 200_000


def first_per_link(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first row, by default by ``id``, of every normalised link.

    Spark keeps one row per link already before the shuffle, so a link that
    holds a large share of all rows costs no more than any other.
    """
    first = Window.partitionBy("_link_key").orderBy(*(order or ["id"]))
    return (
        with_link_key(df, "link", "_link_key")
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .drop("_link_key", "_rank")
    )


def merge_channels(df: DataFrame) -> DataFrame:
    """Union of sources, distinct by normalised link, first wins, new numbers."""
    return renumber(first_per_link(df), F.asc("id")).select(*df.columns)


def row_keys(df: DataFrame) -> DataFrame:
    """The rows with ``link_key`` and ``name_key``, 16 bytes each; no name key where the name does not count."""
    keyed = with_name_key(with_link_key(df))
    return keyed.withColumns({k: F.unhex(F.md5(F.col(k).cast("binary"))) for k in ("link_key", "name_key")})


def remove_duplicates(df: DataFrame, plain_rounds: int = PLAIN_ROUNDS, earlier: DataFrame | None = None) -> DataFrame:
    """Drop rows whose link or eligible name belongs to an earlier kept row.

    ``earlier`` holds ``link_key, name_key`` of rows kept before all of these.
    """
    keys = row_keys(df.select("id", "link", "name")).select("id", "link_key", "name_key")
    if earlier is not None:
        for key in ("link_key", "name_key"):
            keys = keys.join(earlier.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    kept = kept_ids(keys, plain_rounds)
    return df.join(kept, "id", "left_semi")


def kept_ids(rows: DataFrame, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """Ids of the rows that survive the two-key rule, as a table.

    ``rows`` holds ``id, link_key, name_key``; a null name key conflicts with
    nothing.  A row is kept if and only if no earlier kept row shares its link
    or its name, which makes the kept rows the greedy matching between links and
    names.  It is found in rounds over the rows still open: a row that is first
    among them in both its link and its name is kept, and all rows that share a
    key with a kept row are out.

    Random input takes a handful of rounds.  Once the plain rounds are over, rows
    that hold each other up in a long chain are decided together, by following the
    chain with doubled strides; and the ``PREFIX_ROWS`` smallest open ids, whose
    decisions depend on none behind them, are decided one after the other by one
    task.  So n rows that are still open then take ``n / PREFIX_ROWS`` more rounds
    at most, however they depend on each other.  The loop ends when nothing is open.
    """
    # Equal link and name: only the first can ever be kept.  A row without a
    # name gets one of its own afterwards.
    own_name = F.concat(F.lit("\x00no name of row "), F.col("id").cast("string")).cast(rows.schema["name_key"].dataType)
    open_rows = materialize(
        rows.groupBy("link_key", "name_key")
        .agg(F.min("id").alias("id"))
        .select("id", "link_key", F.coalesce("name_key", own_name).alias("name_key")),
        "open-rows",
    )
    rounds: list[DataFrame] = []
    while not rounds or not open_rows.isEmpty():
        chosen = _mutual_first(open_rows)
        if len(rounds) >= plain_rounds:
            chosen = materialize(chosen, "mutual-first")
            prefix = _kept_of_first(open_rows, PREFIX_ROWS)
            in_chain = open_rows.join(_kept_along_chains(open_rows, chosen), "id", "left_semi")
            chosen = chosen.unionByName(prefix).unionByName(in_chain).dropDuplicates(["id"])
        chosen = materialize(chosen, "kept")
        rounds.append(chosen.select("id"))
        before = open_rows
        open_rows = materialize(
            open_rows.join(chosen.select("link_key"), "link_key", "left_anti")
            .join(chosen.select("name_key"), "name_key", "left_anti")
            .select("id", "link_key", "name_key"),
            "open-rows",
        )
        release(before)
    return reduce(DataFrame.unionByName, rounds)


def _mutual_first(open_rows: DataFrame) -> DataFrame:
    """Rows that are first in their link and first in their name."""
    by_link = open_rows.groupBy("link_key").agg(F.min("id").alias("id"))
    by_name = open_rows.groupBy("name_key").agg(F.min("id").alias("id"))
    return by_link.join(by_name, "id").select("id", "link_key", "name_key")


def _kept_of_first(open_rows: DataFrame, number: int) -> DataFrame:
    """Of the smallest open ids those that are kept, found row by row in one task."""

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, names = set(), set()
        for frame in frames:
            kept = []
            for link, name in zip(frame["link_key"], frame["name_key"]):
                free = link not in links and name not in names
                if free:
                    links.add(link)
                    names.add(name)
                kept.append(free)
            yield frame[kept]

    first = open_rows.orderBy("id").limit(number).select(open_rows.columns)
    return materialize(first.mapInPandas(decide, open_rows.schema), "first-rows")


def _kept_along_chains(open_rows: DataFrame, free: DataFrame) -> DataFrame:
    """Ids kept because of chains of rows that each wait for exactly one row.

    The second row of a key waits for the first only, whatever comes after it.  A
    row that waits for one other row is kept exactly if that one is not, so along a
    chain kept and dropped alternate, starting from a row that waits for nobody
    (``free``).  Rows that are second in both keys wait for two and are left open.
    Each step joins the chain to itself on unique ids and doubles its strides.
    """
    waits, firsts = {}, {}
    for key in ("link_key", "name_key"):
        ends = open_rows.groupBy(key).agg(F.min("id").alias("target"))
        firsts[key] = ends.select(F.col("target").alias("id"))
        later = open_rows.select(key, "id").join(ends, key).where("id > target")
        waits[key] = later.groupBy(key, "target").agg(F.min("id").alias("id")).select("id", "target")
    single = (
        waits["link_key"]
        .join(firsts["name_key"], "id", "left_semi")
        .unionByName(waits["name_key"].join(firsts["link_key"], "id", "left_semi"))
    )
    roots = free.select(F.col("id").alias("target"), F.lit(True).alias("free"))
    chain = materialize(
        single.join(roots, "target", "left").select(
            "id", "target", F.coalesce("free", F.lit(False)).alias("free"),
            F.lit(1).alias("flips"), F.lit(False).alias("done"),
        ),
        "chain",
    )
    while not chain.where(~F.col("done")).isEmpty():
        ahead = chain.select(
            F.col("id").alias("target"), *[F.col(c).alias(f"_{c}") for c in ("target", "free", "flips", "done")]
        )
        moved = (
            chain.where(~F.col("done"))
            .join(ahead, "target", "left")
            .select(
                "id",
                F.coalesce("_target", "target").alias("target"),
                F.coalesce("_free", "free").alias("free"),
                ((F.col("flips") + F.coalesce("_flips", F.lit(0))) % 2).alias("flips"),
                F.coalesce("_done", F.lit(True)).alias("done"),
            )
        )
        before = chain
        chain = materialize(chain.where("done").unionByName(moved), "chain")
        release(before)
    return chain.where(F.col("free") & (F.col("flips") == 0)).select("id")


def group_labels(df: DataFrame) -> DataFrame:
    """``group_key, group_label, rows``: groups ignoring case, first spelling.

    Rows are first counted per exact spelling, so that only distinct spellings
    are folded and compared.
    """
    return (
        df.groupBy(effective_group(F.col("group_name")).alias("spelling"))
        .agg(F.min("id").alias("id"), F.count("*").alias("rows"))
        .groupBy(fold(F.col("spelling")).alias("group_key"))
        .agg(F.min_by("spelling", "id").alias("group_label"), F.sum("rows").alias("rows"))
    )


def distinct_groups(df: DataFrame) -> DataFrame:
    """Group labels, sorted ignoring case."""
    return group_labels(df).select("group_label").orderBy(sort_key(F.col("group_label")))
