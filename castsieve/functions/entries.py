"""Columns read from, and written to, one ``#EXTINF`` line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import KNOWN_ATTRIBUTES
from .names import display_name
from .text import WHITESPACE, WORD_CHARS, blank_to_null, contains_ci, starts_ci

# The grammar of an entry line.
_DISPLAY_NAME = r"(?iUd)#EXTINF\s*:\s*-?\d+[^,]*,\s*(.+)$"
_ATTRIBUTE = rf'(?U)[{WORD_CHARS}][-{WORD_CHARS}]*\s*=\s*"[^"]*"'
# Pairs with a column of their own, or without a value.
_NO_EXTRA = rf'(?iU)^(?:{"|".join(KNOWN_ATTRIBUTES)})\s*=|"\s*"$'


def is_entry(line: Column) -> Column:
    return starts_ci(line, "#EXTINF")


def is_group_override(line: Column) -> Column:
    return starts_ci(line, "#EXTGRP:")


def named_attribute(line: Column, name: str) -> Column:
    """First value of ``name="..."``, trimmed, null when blank or absent."""
    return blank_to_null(F.regexp_extract(line, rf'(?iU){name}\s*=\s*"([^"]*)"', 1))


def header_epg(line: Column) -> Column:
    """Programme-guide link of a playlist header line, else null."""
    return F.when(
        starts_ci(line, "#EXTM3U"),
        F.coalesce(named_attribute(line, "x-tvg-url"), named_attribute(line, "url-tvg")),
    )


def entry_name(line: Column, tvg_name: Column) -> Column:
    """Text after the comma that ends the duration, else tvg-name, else the line."""
    return F.coalesce(blank_to_null(F.regexp_extract(line, _DISPLAY_NAME, 1)), tvg_name, line)


def with_extra_attributes(df: DataFrame, line: str, out: str = "extra_attributes") -> DataFrame:
    """Add all other ``key="value"`` pairs as a map.

    Keys are equal ignoring case: the first spelling and place stay, the last
    value wins.
    """
    pairs, keys = F.col("_pairs"), F.col("_keys")
    found = F.regexp_extract_all(line, F.lit(_ATTRIBUTE), F.lit(0))
    extras = F.transform(
        F.filter(found, lambda pair: ~pair.rlike(_NO_EXTRA)),
        lambda pair: F.struct(
            F.rtrim(F.substring_index(pair, "=", 1), F.lit(WHITESPACE)).alias("key"),
            F.substring_index(F.substring_index(pair, '"', 2), '"', -1).alias("value"),
        ),
    )

    def merged(key: Column) -> Column:
        def same(p: Column) -> Column:
            return F.upper(p["key"]) == key

        return F.struct(
            F.element_at(F.filter(pairs, same), 1)["key"].alias("key"),
            F.element_at(F.filter(pairs, same), -1)["value"].alias("value"),
        )

    return (
        df.withColumn("_pairs", extras)
        .withColumn("_keys", F.array_distinct(F.transform(pairs, lambda p: F.upper(p["key"]))))
        .withColumn(
            out,
            F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs)).otherwise(
                F.map_from_entries(F.transform(keys, merged))
            ),
        )
        .drop("_pairs", "_keys")
    )


def _quoted(name: str, value: Column) -> Column:
    text = F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    return F.when(F.coalesce(value, F.lit("")) != "", text).otherwise("")


def format_entry() -> Column:
    """The ``#EXTINF`` line of a channel row; raw entry lines stay as they are."""
    name, tvg_name = F.col("name"), F.col("tvg_name")
    extras = F.array_join(
        F.transform(
            F.map_entries("extra_attributes"),
            lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"')),
        ),
        "",
    )
    built = F.concat(
        F.lit("#EXTINF:-1"),
        _quoted("tvg-id", F.col("tvg_id")),
        _quoted("tvg-name", tvg_name),
        _quoted("tvg-logo", F.col("tvg_logo")),
        F.when(
            F.col("language").isNotNull(),
            F.concat(F.lit(' tvg-language="'), F.col("language.name"), F.lit('"')),
        ).otherwise(""),
        _quoted("group-title", F.col("group_name")),
        F.coalesce(extras, F.lit("")),
        F.lit(","),
        display_name(name, tvg_name),
    )
    return F.when(is_entry(name), name).otherwise(built)


def format_group_line() -> Column:
    """The ``#EXTGRP:`` line of a channel row, null when it has none."""
    group = F.col("group_name")
    return F.when(
        (group != "") & ~contains_ci(F.col("name"), "group-title="),
        F.concat(F.lit("#EXTGRP:"), group),
    )


def format_header(epg_url: Column) -> Column:
    """First line of a playlist."""
    return F.when(
        F.coalesce(epg_url, F.lit("")) != "",
        F.concat(F.lit('#EXTM3U x-tvg-url="'), epg_url, F.lit('"')),
    ).otherwise("#EXTM3U")
