"""Row filters on group and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import matches_regex, pattern_is_valid
from ..functions.text import WHITESPACE, contains_ci


def group_contains(part: str) -> Column:
    return contains_ci(F.col("group_name"), part)


def name_contains(part: str) -> Column:
    in_tvg_name = F.coalesce(contains_ci(F.col("tvg_name"), part), F.lit(False))
    return contains_ci(F.col("name"), part) | in_tvg_name


def name_matches(pattern: str) -> Column:
    in_tvg_name = F.coalesce(matches_regex(F.col("tvg_name"), pattern), F.lit(False))
    return matches_regex(F.col("name"), pattern) | in_tvg_name


def filter_channels(
    df: DataFrame, group: str | None = None, name: str | None = None, use_regex: bool = False
) -> DataFrame:
    """Rows whose group and whose name or tvg-name match, ignoring case.

    Blank filters are off.  A pattern that is no regular expression is looked
    for as plain text, in the name only.
    """
    group, name = (group or "").strip(WHITESPACE), (name or "").strip(WHITESPACE)
    if group:
        df = df.where(group_contains(group))
    if not name:
        return df
    if not use_regex:
        return df.where(name_contains(name))
    if pattern_is_valid(df.sparkSession, name):
        return df.where(name_matches(name))
    return df.where(contains_ci(F.col("name"), name))
