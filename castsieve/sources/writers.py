"""Writing channels: playlist text, one playlist per group, table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entries import format_entry, format_group_line, format_header
from ..functions.names import safe_group_name
from ..operators.groups import split_by_group
from ..workspace import materialize


def _channel_lines(df: DataFrame, *keys: str) -> DataFrame:
    lines = F.array_compact(F.array(format_entry(), format_group_line(), F.col("link")))
    return df.select(*keys, "id", F.posexplode(lines).alias("part", "line"))


def playlist_lines(df: DataFrame) -> DataFrame:
    """``id, part, line``: the playlist of the channels, header first at id -1."""
    filled = F.coalesce(F.col("epg_url"), F.lit("")) != ""
    header = df.agg(F.min_by("epg_url", F.when(filled, F.col("id"))).alias("epg_url")).select(
        F.lit(-1).cast("bigint").alias("id"),
        F.lit(0).alias("part"),
        format_header(F.col("epg_url")).alias("line"),
    )
    return header.unionByName(_channel_lines(df))


def group_playlist_lines(df: DataFrame, name: str = "playlist") -> DataFrame:
    """``playlist, id, part, line``: one playlist per group, each with its header.

    The group goes between the base and the extension of the name.

    Groups whose names become the same file name share one playlist.
    """
    base, extension = os.path.splitext(name)
    playlist = F.concat(F.lit(base + "_"), safe_group_name(F.col("group_label")), F.lit(extension))
    named = split_by_group(df).withColumn("playlist", playlist)
    filled = F.coalesce(F.col("epg_url"), F.lit("")) != ""
    headers = (
        named.groupBy("playlist")
        .agg(F.min_by("epg_url", F.when(filled, F.col("id"))).alias("epg_url"))
        .select(
            "playlist",
            F.lit(-1).cast("bigint").alias("id"),
            F.lit(0).alias("part"),
            format_header(F.col("epg_url")).alias("line"),
        )
    )
    return headers.unionByName(_channel_lines(named, "playlist"))


def write_playlist(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write one playlist as text parts whose names are in playlist order."""
    lines = playlist_lines(df)
    ordered = lines.repartitionByRange("id", "part").sortWithinPartitions("id", "part")
    ordered.select("line").write.mode(mode).text(path, lineSep="\n")


def write_group_playlists(df: DataFrame, path: str, name: str = "playlist", mode: str = "error") -> None:
    """Write one folder ``playlist={base}_{group}{extension}`` of ordered text parts per group.

    A large group is spread over several parts instead of one task.
    """
    order = ["playlist", "id", "part"]
    lines = group_playlist_lines(df, name).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("playlist", "line").write.mode(mode).partitionBy("playlist").text(path, lineSep="\n")


def write_group_files(df: DataFrame, path: str, name: str = "playlist.m3u", mode: str = "error") -> None:
    """Write one file ``{base}_{group}{extension}`` per group into the folder ``path``.

    Two phases.  Spark first writes the lines as ordered parts into a folder of this
    attempt, hidden inside ``path``; a large group is spread over several tasks.  Parts
    of one group are then joined by a task that copies bytes, one block at a time.  Only
    when all that has succeeded do the files get their names, which moves no data; an
    attempt that fails leaves nothing but is removed as a whole.  ``mode`` is "error"
    (no file of these names may be there) or "overwrite" (of these names only).

    Needs a folder that Arrow can open (local or mounted, S3, GCS, HDFS) where a group
    has several parts.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError("mode must be 'error' or 'overwrite'")
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    attempt = jvm.Path(target, f"_attempt-{uuid.uuid4().hex}")
    try:
        # Numbers stand for names, which a folder name could not hold as they are.
        order = ["number", "id", "part"]
        lines = group_playlist_lines(df, name).withColumn("number", F.xxhash64("playlist"))
        lines = materialize(lines, "group-lines")
        names = {r.number: r.playlist for r in lines.select("number", "playlist").distinct().collect()}
        ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.select("number", "line").write.partitionBy("number").text(attempt.toString(), lineSep="\n")
        parts = {n: _part_files(fs, jvm.Path(attempt, f"number={n}")) for n in names}
        several = [(n, own, f"{attempt}/number={n}/whole") for n, own in parts.items() if len(own) > 1]
        if several:
            asked = spark.createDataFrame(several, "number long, parts array<string>, whole string")
            # The result is one row per joined file.
            asked.repartition(len(several)).mapInPandas(_join_parts, "whole string").collect()
        found = {names[n]: own[0] if len(own) == 1 else f"{attempt}/number={n}/whole" for n, own in parts.items()}
        taken = [file for file in found if fs.exists(jvm.Path(target, file))]
        if taken and mode == "error":
            raise FileExistsError(f"{path}: {taken[0]} is already there")
        for file, staged in found.items():
            place = jvm.Path(target, file)
            if file in taken:
                fs.delete(place, False)
            if not fs.rename(jvm.Path(staged), place):
                raise OSError(f"{place}: cannot be named")
    finally:
        fs.delete(attempt, True)


def _part_files(fs, folder) -> list[str]:
    """The parts of a folder in the order of their names, which is that of their lines."""
    files = [status.getPath() for status in fs.listStatus(folder)]
    return [f.toString() for f in sorted(files, key=lambda f: f.getName()) if not f.getName().startswith(("_", "."))]


def _join_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for parts, whole in zip(frame["parts"], frame["whole"]):
            fs, place = pyarrow.fs.FileSystem.from_uri(whole)
            # A repeated task writes the file anew.
            with fs.open_output_stream(place) as out:
                for part in parts:
                    with fs.open_input_stream(pyarrow.fs.FileSystem.from_uri(part)[1], compression=None) as source:
                        while block := source.read(1 << 20):
                            out.write(block)
            yield pd.DataFrame({"whole": [whole]})


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write all columns, also those a playlist cannot hold."""
    df.write.mode(mode).parquet(path)
