"""Name and group functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import GENERIC_NAMES, QUALITY_TAGS, UNCATEGORIZED
from .text import WORD_CHARS, fold, is_blank, starts_ci, trim

_QUALITY_SUFFIX = r"(?U)\s*(?:" + "|".join(QUALITY_TAGS) + r")$"
# Anything but word characters; characters beyond the basic plane never are.
_BETWEEN_WORDS = rf"[[^{WORD_CHARS}]\x{{10000}}-\x{{10FFFF}}]+"


def with_normalized_name(df: DataFrame, name: str, out: str) -> DataFrame:
    """Add a name in lower case, without a trailing quality tag, single-spaced."""
    text = F.coalesce(name, F.lit(""))
    comma = F.instr(text, ",")
    raw_entry = starts_ci(text, "#EXTINF") & (comma > 1) & (comma < F.length(text))
    text = F.when(raw_entry, F.substr(text, comma + 1)).otherwise(text)
    tagged = reduce(lambda a, b: a | b, [F.col("_lowered").endswith(tag) for tag in QUALITY_TAGS])
    untagged = F.when(tagged, F.regexp_replace("_lowered", _QUALITY_SUFFIX, "")).otherwise(F.col("_lowered"))
    return (
        df.withColumn("_lowered", F.lower(trim(text)))
        .withColumn(out, F.trim(F.regexp_replace(untagged, _BETWEEN_WORDS, " ")))
        .drop("_lowered")
    )


def is_generic_name(normalized: Column) -> Column:
    """True for a normalised name that says nothing about the channel."""
    return normalized.isin(GENERIC_NAMES)


def with_eligible_name(df: DataFrame, name: str, out: str) -> DataFrame:
    """Add the normalised name, null where it does not identify a channel."""
    normalized = F.col(out)
    identifying = (F.length(normalized) > 3) & ~is_generic_name(normalized)
    return with_normalized_name(df, name, out).withColumn(out, F.when(identifying, normalized))


def with_name_key(df: DataFrame, name: str = "name", out: str = "name_key") -> DataFrame:
    """Add a key that is equal for the same channel name, null for other names."""
    return with_eligible_name(df, name, out).withColumn(out, fold(F.col(out)))


def display_name(name: Column, tvg_name: Column) -> Column:
    """The name shown to people; an empty tvg-name still counts."""
    return F.coalesce(tvg_name, name)


def effective_group(group: Column) -> Column:
    """Group, with blank ones gathered under one label."""
    return F.when(is_blank(group), F.lit(UNCATEGORIZED)).otherwise(group)


def safe_group_name(group: Column) -> Column:
    """Group as part of a file name."""
    return F.regexp_replace(group, r"[ /\x00]", "_")


def resolution(info: Column) -> Column:
    """``WxH`` of a stream, null unless both are known."""
    width, height = info["width"], info["height"]
    return F.when(
        width.isNotNull() & height.isNotNull(),
        F.concat(width.cast("string"), F.lit("x"), height.cast("string")),
    )
