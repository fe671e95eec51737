"""Playlist lines to channel rows.

An entry is the first ``#EXTINF`` line after the previous link among the four
raw lines before a link; everything a link needs is therefore in those lines.
Both ways of reading reduce to rows ``(link line, lines before it)``: whole
small files are split inside one row, without any shuffle, and numbered lines of
any file size meet their neighbours in blocks of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import (
    entry_name,
    header_epg,
    is_entry,
    is_group_override,
    named_attribute,
    with_extra_attributes,
)
from ..functions.fixed_values import LOOK_AHEAD
from ..functions.text import trim
from ..functions.urls import is_stream_url
from ..schema import CHANNEL
from .lookup import lookup
from .ordering import renumber

# Lines per block when numbered lines are brought together.
BLOCK_LINES = 8192

# Where a line stands; the order of all parsed rows.
PLACE = ["src_ord", "file", "line_no"]

_LINE_BREAK = r"\r\n|\r|\n"


def split_lines(text: Column) -> Column:
    """Lines of a whole text."""
    return F.split(text, _LINE_BREAK)


def links_in_texts(texts: DataFrame) -> DataFrame:
    """Link lines with the lines before them, from ``src_ord, file, text``.

    Works inside each row: only lines with a link leave it, each with the few
    lines before it, and the header of the file.
    """
    lines = F.transform(split_lines(F.col("text")), trim)
    numbered = F.transform(
        F.col("_lines"), lambda line, i: F.struct(i.cast("bigint").alias("line_no"), line.alias("link_line"))
    )
    links = F.filter(numbered, lambda s: is_stream_url(s["link_line"]))
    with_before = F.transform(
        links,
        lambda s: F.struct(
            s["line_no"],
            s["link_line"],
            F.slice(
                F.col("_lines"),
                F.greatest(s["line_no"].cast("int") - LOOK_AHEAD, F.lit(0)) + 1,
                F.least(s["line_no"].cast("int"), F.lit(LOOK_AHEAD)),
            ).alias("before"),
        ),
    )
    first_line = F.regexp_extract("text", r"^[^\r\n]*", 0)
    return (
        texts.select("src_ord", "file", lines.alias("_lines"), first_line.alias("_first_line"))
        .withColumn("header_epg", header_epg(F.col("_first_line")))
        .select("src_ord", "file", "header_epg", F.inline(with_before))
    )


def links_in_lines(
    lines: DataFrame, headers: DataFrame | None = None, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Link lines with the lines before them, from ``src_ord, file, line_no, line``.

    ``headers`` (``src_ord, file, header_epg``), if given, saves a scan of the lines.
    Only entry, group and link lines are shuffled, by file and block of lines, so
    the size of a file does not matter.  The last lines of a block also go to the
    next one.
    """
    relevant = (
        lines.withColumn("link_line", trim(F.col("line")))
        .withColumn("is_link", is_stream_url(F.col("link_line")))
        .where(
            F.col("is_link") | is_entry(F.col("link_line")) | is_group_override(F.col("link_line"))
        )
    )
    own = F.floor(F.col("line_no") / block_lines)
    near_end = F.col("line_no") % block_lines >= block_lines - LOOK_AHEAD
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    before = Window.partitionBy("src_ord", "file", "_block").orderBy("line_no").rangeBetween(-LOOK_AHEAD, -1)
    found = (
        relevant.withColumn("_block", F.explode(blocks))
        .withColumn("before", F.collect_list("link_line").over(before))
        .where(F.col("is_link") & (F.col("_block") == own))
        .select(*PLACE, "link_line", "before")
    )
    if headers is None:
        headers = lines.where("line_no = 0").select("src_ord", "file", header_epg(F.col("line")).alias("header_epg"))
    key = F.concat_ws("\x00", F.col("src_ord").cast("string"), F.col("file"))
    known = headers.where("header_epg is not null").select(key.alias("_file_key"), "header_epg")
    place = F.concat_ws("\x00", *[F.col(c).cast("string") for c in PLACE])
    return lookup(found.withColumn("_file_key", key), known, "_file_key", place).drop("_file_key")


def entries_of_links(links: DataFrame) -> DataFrame:
    """Channels, not yet numbered, from link lines and the lines before them."""
    since_last_link = F.slice("before", F.col("_last_link") + 1, LOOK_AHEAD)
    positions = F.transform(
        F.col("before"), lambda line, i: F.when(is_stream_url(line), i + 1).otherwise(F.lit(0))
    )
    entry = F.try_element_at(F.filter("_near", is_entry), F.lit(1))
    overrides = F.filter(F.col("_after_entry"), is_group_override)
    override = F.when(
        F.size(overrides) > 0,
        trim(F.substring(F.try_element_at(overrides, F.lit(-1)), len("#EXTGRP:") + 1, 2**31 - 1)),
    )
    line = F.col("_entry")
    tvg_name = F.col("tvg_name")
    columns = {
        "name": entry_name(line, tvg_name),
        "link": F.regexp_replace("link_line", "^[\"']+|[\"']+$", ""),
        "group_name": F.coalesce(override, named_attribute(line, "group-title"), F.lit("")),
        "tvg_id": named_attribute(line, "tvg-id"),
        "tvg_name": tvg_name,
        "tvg_logo": named_attribute(line, "tvg-logo"),
        "epg_url": F.coalesce(named_attribute(line, "x-tvg-url"), F.col("header_epg")),
        "extra_attributes": F.col("extra_attributes"),
        "category": F.lit("Unknown"),
    }
    staged = (
        links.where(F.exists("before", is_entry))
        .withColumn("_last_link", F.array_max(positions))
        .withColumn("_near", since_last_link)
        .where(F.exists("_near", is_entry))
        .withColumn("_entry", entry)
        .withColumn(
            "_after_entry",
            F.slice("_near", F.array_position("_near", F.col("_entry")).cast("int") + 1, LOOK_AHEAD),
        )
        .withColumn("tvg_name", named_attribute(line, "tvg-name"))
    )
    channel = [
        columns[f.name].alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in CHANNEL.fields
        if f.name != "id"
    ]
    return with_extra_attributes(staged, "_entry").select(*PLACE, *channel)


def number_channels(parsed: DataFrame) -> DataFrame:
    """Channels numbered in order of source, file and line."""
    return renumber(parsed, *[F.asc(c) for c in PLACE], columns=CHANNEL.names[1:]).select(*CHANNEL.names)
