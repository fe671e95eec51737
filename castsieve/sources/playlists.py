"""Reading playlist files of any number and size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entries import header_epg
from ..operators.dedupe import first_per_link
from ..operators.parse import (
    PLACE,
    entries_of_links,
    links_in_lines,
    links_in_texts,
    number_channels,
    split_lines,
)
from ..workspace import materialize

# Files up to this size are parsed whole, inside one row.
WHOLE_FILE_BYTES = 16 * 1024 * 1024
# So many files of a folder are named one by one; more are listed with their folder, if they are all it holds.
NAMED_FILES = 32
# Rows of a file that are put in order together; totals are carried from block to block.
BLOCK_ROWS = 65_536


def decode_text(content: Column) -> Column:
    """Text of a file by its byte order mark, UTF-8 without one."""
    mark = F.hex(F.substring(content, 1, 4))
    utf8 = F.when(
        mark.startswith("EFBBBF"), F.substring(content, 4, 2**31 - 1)
    ).otherwise(content)
    text = (
        F.when(mark.isin("0000FEFF", "FFFE0000"), F.decode(content, "UTF-32"))
        .when(mark.startswith("FEFF") | mark.startswith("FFFE"), F.decode(content, "UTF-16"))
        .otherwise(F.make_valid_utf8(utf8.cast("string")))
    )
    return F.regexp_replace(text, "^﻿", "")


# Byte order marks of the encodings with wide characters, as hex.
WIDE = {"FFFE0000": "UTF-32LE", "0000FEFF": "UTF-32BE", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}

# Files that the line reader decompresses by their name.
_COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$"


def is_web_link(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def find_files(spark: SparkSession, sources: list[tuple[int, str]]) -> tuple[list[str], list[tuple[int, str]]]:
    """What Spark has to load, and order and place of every named file or folder.

    A source is an existing file or folder, whatever characters its name has, or
    else a glob.  One that yields no readable file is an error, also a file that
    Spark leaves out because its name begins with "_" or ".".
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    load: dict[str, str] = {}
    folders = set()
    places = []
    for order, source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(conf)
        exists = fs.exists(path)
        folder = None if exists else _folder_of_all(jvm, fs, path)
        if folder is not None:
            name = folder.toString()
            load[name] = folder.getParent().toString()
            folders.add(name)
            places.append((order, _plain_path(folder.toUri().toString())))
            continue
        found = [fs.getFileStatus(path)] if exists else list(fs.globStatus(path) or [])
        usable = 0
        for status in found:
            if status.getPath().getName().startswith(("_", ".")):
                continue
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            if all(s.getPath().getName().startswith(("_", ".")) for s in inside):
                continue
            usable += 1
            name = status.getPath().toString()
            load[name] = status.getPath().getParent().toString()
            if status.isDirectory():
                folders.add(name)
            places.append((order, _plain_path(status.getPath().toUri().toString())))
        if not usable:
            raise FileNotFoundError(f"{source}: no file that can be read")
    # A file named besides its folder is loaded once.
    names = [name for name, folder in load.items() if folder not in folders or name in folders]
    return [_escaped(name) for name in names], places


def _folder_of_all(jvm, fs, pattern):
    """The qualified folder whose files a glob names, many and without exception; None for any other glob.

    Such a folder is listed once, where single names are asked for one by one.
    """
    folder = pattern.getParent()
    if folder is None or folder.getParent() is None or not fs.exists(folder):
        return None
    found = fs.globStatus(pattern)
    if found is None or len(found) <= NAMED_FILES:
        return None
    name = pattern.getName()
    # Names that begin with a character of the pattern's own are not hidden ones; these are looked for only where they count.
    if name[0] not in "_.[]{}*?\\" and _holds_only(fs, folder, len(found), []):
        return fs.makeQualified(folder)
    same_names = jvm.org.apache.hadoop.fs.GlobPattern(name)
    hidden = _hidden(jvm, fs, folder)
    number = len(found) - sum(same_names.matches(name) for name in hidden)
    return fs.makeQualified(folder) if number and _holds_only(fs, folder, number, hidden) else None


def _hidden(jvm, fs, folder) -> list[str]:
    """Names in a folder that Spark leaves out."""
    return [s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "[_.]*"))]


def _holds_only(fs, folder, number: int, hidden: list[str]) -> bool:
    """Whether a folder holds so many files besides the hidden ones, and no folders."""
    held = fs.getContentSummary(folder)
    return held.getDirectoryCount() == 1 and held.getFileCount() == number + len(hidden)


def _gathered(spark: SparkSession, paths: list[str]) -> list[str]:
    """What Spark has to load for some existing files: folders where all their files are named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    by_folder: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        by_folder.setdefault(path.rpartition("/")[0], []).append(path)
    load = []
    for folder, own in by_folder.items():
        if len(own) > NAMED_FILES:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            fs = place.getFileSystem(conf)
            if _holds_only(fs, place, len(own), _hidden(jvm, fs, place)):
                load.append(_escaped(folder))
                continue
        load += [_escaped(path) for path in own]
    return load


def _escaped(name: str) -> str:
    """A name without characters that a glob would read otherwise."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _plain_path(place: str) -> str:
    """An empty authority may be written or not."""
    return re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", place)


def list_files(content: DataFrame, places: list[tuple[int, str]], limit: int) -> DataFrame:
    """``src_ord, file, length, by_lines, encoding`` of all files, one row each time a file is named; written.

    ``encoding`` tells by the first bytes how a file that is read by lines has to be read: empty for UTF-8, null if
    it is not known yet.  Compressed files and those above ``WHOLE_FILE_BYTES`` are not opened here.
    """
    file, length = F.col("_metadata.file_path"), F.col("length")
    compressed = file.rlike(_COMPRESSED)

    def described(some: DataFrame, encoding: Column) -> DataFrame:
        return some.select(file.alias("file"), "length", ((length > limit) | compressed).alias("by_lines"), encoding.alias("encoding"))

    unknown = F.lit(None).cast("string")
    opened = (length > limit) & (length <= WHOLE_FILE_BYTES)
    files = described(content.where(~opened), unknown)
    if limit < WHOLE_FILE_BYTES:
        head = F.hex(F.substring("content", 1, 4))
        files = files.unionByName(described(content.where(opened), F.when(~compressed, F.coalesce(_wide(head), F.lit("")))))
    # An empty authority may be written or not.
    plain = F.regexp_replace("file", "^([A-Za-z0-9+.-]+):///", "$1:/")
    folder = F.regexp_extract(plain, "^(.*)/[^/]*$", 1)
    keyed = files.withColumn("place", F.explode(F.array(plain, folder)))
    named = content.sparkSession.createDataFrame(places, "src_ord int, place string")
    return materialize(keyed.join(named, "place").select("src_ord", *files.columns), "files")


def _wide(head: Column) -> Column:
    """The encoding that a byte order mark, as hex, stands for; null if it has no wide characters."""
    return F.coalesce(*[F.when(head.startswith(mark), F.lit(name)) for mark, name in WIDE.items()])


def read_texts(
    spark: SparkSession,
    load: list[str],
    limit: int,
    order: int = 0,
    files: DataFrame | None = None,
    content: DataFrame | None = None,
) -> DataFrame:
    """``src_ord, file, text`` of the files up to a size.  Larger and compressed ones are not opened.

    ``files`` gives the order of every file where it is not ``order`` for all; ``content`` are the files if they
    have been listed before.
    """
    content = _contents(spark, load) if content is None else content
    texts = content.where(F.col("length") <= limit).select(F.col("_metadata.file_path").alias("file"), decode_text(F.col("content")).alias("text"))
    texts = texts.where(~F.col("file").rlike(_COMPRESSED))
    if files is None:
        return texts.select(F.lit(order).alias("src_ord"), "file", "text")
    return texts.join(files.select("src_ord", "file"), "file").select("src_ord", "file", "text")


def _contents(spark: SparkSession, load: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(load)


def _marked_lines(spark: SparkSession, load: list[str], **options: str) -> DataFrame:
    """Lines with their file, split and the mark of their place in the scan."""
    return spark.read.options(**options).text(load).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("mark"),
    )


def read_numbered_lines(spark: SparkSession, load: list[str], files: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``src_ord, file, line_no, line`` of the files read by lines, and their headers.

    None without such files.

    The lines are written once with the mark of their place in the scan; the number
    of lines per split then gives every line its number, and the first line of a
    file its header and, where it is not known, its encoding.  Files with wide
    characters are read with theirs.
    """
    chosen = files.where("by_lines").select("file", "length", "encoding").distinct()
    encodings = {r[0] for r in chosen.select("encoding").distinct().collect()}
    if not encodings:
        return None
    wide = chosen.where("encoding != ''")
    lines, headers = [], []
    if encodings & {None, ""}:
        plain = chosen.where("coalesce(encoding, '') = ''").select("file")
        written = materialize(_marked_lines(spark, load).join(F.broadcast(plain), "file"), "lines")
        splits = materialize(_with_starts(written), "splits")
        first = splits.where("start = 0").select("file", F.col("first_mark").alias("mark"))
        first = written.join(first, ["file", "mark"]).select(
            "file",
            header_epg(F.make_valid_utf8("line")).alias("header_epg"),
            _wide(F.hex(F.substring(F.col("line").cast("binary"), 1, 4))).alias("encoding"),
        )
        numbered = written.join(splits, ["file", "split"]).select(
            "file",
            (F.col("start") + F.col("mark") - F.col("first_mark")).alias("line_no"),
            F.make_valid_utf8("line").alias("line"),
        )
        first = materialize(first, "first-lines")
        found = first.where("encoding is not null") if None in encodings else None
        if found is not None and not found.isEmpty():
            encodings |= {r[0] for r in found.select("encoding").distinct().collect()}
            wide = wide.unionByName(found.join(chosen.drop("encoding"), "file").select("file", "length", "encoding"))
            numbered = numbered.join(first.where("encoding is null").select("file"), "file", "left_semi")
        lines.append(numbered)
        headers.append(first.where("encoding is null").select("file", "header_epg"))
    for encoding in sorted(encodings - {None, ""}):
        own = wide.where(F.col("encoding") == encoding)
        # A piece of a line is a character at least: such files have no more than a block of them.
        short = F.col("length") <= 2 * BLOCK_ROWS
        for part, read in ((own.where(short), _short_wide_lines), (own.where(~short), _wide_lines)):
            if not part.isEmpty():
                lines.append(materialize(read(spark, load, part, encoding), "lines"))
                headers.append(lines[-1].where("line_no = 0").select("file", header_epg(F.col("line")).alias("header_epg")))
    named = files.where("by_lines").select("src_ord", "file")
    return tuple(reduce(DataFrame.unionByName, parts).join(named, "file") for parts in (lines, headers))


def _with_starts(marked: DataFrame, *more: Column) -> DataFrame:
    """Per split of a file: its first mark and the number of lines before it."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.groupBy("file", "split")
        .agg(F.min("mark").alias("first_mark"), F.count("*").alias("n"), *more)
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )


def _wide_pieces(spark: SparkSession, load: list[str], files: DataFrame, encoding: str) -> DataFrame:
    """Pieces between line feeds, as bytes, with their file, split and mark."""
    scan = _marked_lines(spark, load, encoding=encoding, lineSep="\n").join(F.broadcast(files.select("file")), "file")
    return scan.withColumn("line", F.col("line").cast("binary"))


def _wide_feed(encoding: str) -> str:
    """A line feed in an encoding with wide characters, as hex."""
    width = _width(encoding)
    return {"LE": "0A", "BE": "0A".zfill(2 * width)}[encoding[-2:]].ljust(2 * width, "0")


def _width(encoding: str) -> int:
    return 4 if "32" in encoding else 2


def _decoded(content: Column, encoding: str, first: Column) -> Column:
    """Text of a file or of one line; the first one without a mark."""
    mark = {"UTF-32LE": "FFFE0000", "UTF-32BE": "0000FEFF"}.get(encoding)
    text = F.decode(F.concat(F.unhex(F.lit(mark)), content), "UTF-32") if mark else F.decode(content, encoding)
    return F.when(first, F.regexp_replace(text, "^\uFEFF", "")).otherwise(text)


def _short_wide_lines(spark: SparkSession, load: list[str], files: DataFrame, encoding: str) -> DataFrame:
    """``file, line_no, line`` of files of at most ``BLOCK_ROWS`` pieces with wide characters.

    The pieces of a file are put together again in one aggregate and decoded at once.
    """
    pieces = _wide_pieces(spark, load, files, encoding)
    whole = F.expr(f"listagg(line, X'{_wide_feed(encoding)}') within group (order by split, mark)")
    texts = pieces.groupBy("file").agg(whole.alias("content"))
    lines = texts.select("file", F.posexplode(split_lines(_decoded(F.col("content"), encoding, F.lit(True)))).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def _wide_lines(spark: SparkSession, load: list[str], files: DataFrame, encoding: str) -> DataFrame:
    """``file, line_no, line`` of files of any size whose characters have two or four bytes.

    The line reader looks for the bytes of a line feed and can find them across two
    characters.  Such a cut leaves pieces that are no whole number of characters;
    these are joined again before decoding.  Other line ends are split afterwards.
    """
    width = _width(encoding)
    marked = materialize(_wide_pieces(spark, load, files, encoding), "wide")
    pieces = marked.join(_with_starts(marked), ["file", "split"]).select(
        "file", (F.col("start") + F.col("mark") - F.col("first_mark")).alias("no"), "line"
    )
    pieces = pieces.withColumn("block", F.floor(F.col("no") / BLOCK_ROWS))
    # A piece begins a line if the pieces before it are a whole number of characters.
    rest = F.length("line") % width
    before = _carried(pieces.groupBy("file", "block").agg(F.sum(rest).alias("n")))
    own = Window.partitionBy("file", "block").orderBy("no")
    above = F.col("above") + F.coalesce(F.sum(rest).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = pieces.join(before, ["file", "block"]).withColumn("begin", F.when(above % width == 0, F.col("no")))
    begun = materialize(begun.select("file", "block", "no", "line", "begin"), "wide-pieces")
    # The line that a block goes on with, when its first pieces begin none.
    open_lines = begun.groupBy("file", "block").agg(F.max("begin").alias("begin"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_lines = open_lines.select("file", "block", F.last("begin", ignorenulls=True).over(earlier).alias("open"))
    last = F.last("begin", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (
        begun.withColumn("from", last)
        .join(open_lines, ["file", "block"])
        .groupBy("file", F.coalesce("from", "open").alias("no"))
        .agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("parts"))
    )
    feed_bytes = F.unhex(F.lit(_wide_feed(encoding)))
    whole = F.expr("parts[0].line")
    more = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), whole, lambda a, p: F.concat(a, feed_bytes, p["line"]))
    text = _decoded(more, encoding, F.col("no") == 0)
    lines = joined.select("file", "no", F.split(F.regexp_replace(text, r"\r\z", ""), "\r", -1).alias("lines"))
    # Lines before a row: those of earlier blocks of rows, and of earlier rows of its block.
    lines = lines.withColumn("block", F.floor(F.col("no") / BLOCK_ROWS))
    blocks = _carried(lines.groupBy("file", "block").agg(F.sum(F.size("lines")).alias("n")))
    within = F.coalesce(F.sum(F.size("lines")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("within", within).join(blocks, ["file", "block"])
    return placed.select(
        "file", (F.col("above") + F.col("within")).alias("first"), F.posexplode("lines").alias("at", "line")
    ).select("file", (F.col("first") + F.col("at")).alias("line_no"), "line")


def _carried(totals: DataFrame) -> DataFrame:
    """``above``: the sum of ``n`` over the earlier blocks of a file; one row per block."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("above"))


def parse_sources(
    spark: SparkSession,
    sources: list[str],
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    fetch_playlist: Callable[[str], bytes] | None = None,
) -> DataFrame:
    """Channels of all sources with their place, not yet numbered.

    ``whole_file_bytes`` only chooses how a file is read, never what is found in it.
    Web links among the sources are fetched by the caller's ``fetch_playlist``.
    """
    ordered = list(enumerate(sources))
    web = [(i, s) for i, s in ordered if is_web_link(s)]
    parsed = []
    if web:
        if fetch_playlist is None:
            raise ValueError(f"{web[0][1]} needs a fetch_playlist function")
        links = spark.createDataFrame(web, "src_ord int, url string")
        parsed.append(entries_of_links(links_in_texts(fetched_texts(links, fetch_playlist))))
    local = [(i, s) for i, s in ordered if not is_web_link(s)]
    if local:
        parsed.append(_parse_found(spark, *find_files(spark, local), whole_file_bytes))
    return reduce(DataFrame.unionByName, parsed)


def parse_files(spark: SparkSession, paths: list[str], whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Channels of existing files, given by full paths as Spark lists them, in this order."""
    places = [(i, _plain_path(path)) for i, path in enumerate(paths)]
    return _parse_found(spark, _gathered(spark, paths), places, whole_file_bytes)


def _parse_found(
    spark: SparkSession, load: list[str], places: list[tuple[int, str]], whole_file_bytes: int
) -> DataFrame:
    content = _contents(spark, load)
    files = list_files(content, places, whole_file_bytes)
    # One source, nothing named twice: all files have its order.
    single = len(load) == len(places) == 1
    by_lines = read_numbered_lines(spark, load, files)
    links = [] if by_lines is None else [links_in_lines(*by_lines)]
    if by_lines is None or not files.where("not by_lines").isEmpty():
        texts = read_texts(spark, load, whole_file_bytes, places[0][0], None if single else files, content)
        links.append(links_in_texts(texts))
    return reduce(DataFrame.unionByName, map(entries_of_links, links))


def read_playlists(
    spark: SparkSession,
    sources: list[str],
    merge: bool = False,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    fetch_playlist: Callable[[str], bytes] | None = None,
) -> DataFrame:
    """Numbered channels of the sources.

    With ``merge`` and more than one source, all of them, distinct by normalised
    link; otherwise the first source only.
    """
    if not sources:
        raise ValueError("no source given")
    merging = merge and len(sources) > 1
    parsed = parse_sources(spark, sources if merging else sources[:1], whole_file_bytes, fetch_playlist)
    return load_parsed(parsed, merging)


def load_parsed(parsed: DataFrame, merging: bool) -> DataFrame:
    """Number parsed channels, after merging them if asked.

    Merging compares places, so that a single numbering pass is enough.
    """
    if merging:
        return number_channels(first_per_link(parsed, PLACE))
    # Ranges are sampled before they are shuffled; parse only once for both.
    return number_channels(materialize(parsed, "parsed"))


def fetched_texts(urls: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """``src_ord, file, text`` of playlists behind web links.

    ``urls`` holds ``src_ord, url``; ``fetch`` is the caller's and returns the
    bytes.  The texts are written once, then parsed like files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One body in memory at a time.
        for batch in batches:
            for order, url in zip(batch["src_ord"], batch["url"]):
                yield pd.DataFrame({"src_ord": [order], "url": [url], "content": [fetch(url)]})

    web = F.lower("url").rlike("^https?://")
    checked = urls.select(
        "src_ord", F.when(web, F.col("url")).otherwise(F.raise_error(F.lit("not a web link"))).alias("url")
    )
    landed = materialize(
        checked.repartition("url").mapInPandas(run, "src_ord int, url string, content binary"), "landed"
    )
    return landed.select("src_ord", F.col("url").alias("file"), decode_text(F.col("content")).alias("text"))
