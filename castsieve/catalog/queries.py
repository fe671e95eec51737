"""One registered query per operator, over whole tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
have the same names as in the comparison SQL.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable
from dataclasses import replace

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries, enrich, names, responses, urls
from ..functions.text import trim
from ..operators import dedupe, enrichment, filters, groups, ordering, parse, probe
from ..plans.clean import CleanOptions, clean_channels
from ..sources import writers
from ..sources.playlists import fetched_texts, load_parsed, parse_sources, read_playlists
from ..sources.writers import group_playlist_lines, playlist_lines
from ..streaming.incremental import start_cleaning
from ..workspace import materialize, shared_folder
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _extras(name: str = "extra_attributes") -> list[Column]:
    """A map as comparable text: its entries in order."""
    text = F.array_join(
        F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )
    return [text.alias(name)]


def _language() -> list[Column]:
    return [F.col(f"language.{f}").alias(f"language_{f}") for f in ("code", "name", "country")]


def _info() -> list[Column]:
    fields = ("width", "height", "bitrate", "video_codec", "audio_codec")
    return [F.col(f"stream_info.{f}").alias(f) for f in fields]


# --- scalar functions -------------------------------------------------------


@register
def normalize_url(spark, sf):
    rows = views.channels(spark, sf).select(F.lit("channel").alias("src"), "id", "link")
    pages = views.table(spark, sf, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("link")
    )
    links = rows.unionByName(pages)
    return urls.with_normalized_url(links, "link", "normalized").select("src", "id", "normalized")


@register
def tracking_param(spark, sf):
    query = F.substring_index("link", "?", -1)
    return (
        views.channels(spark, sf)
        .where(F.contains("link", F.lit("?")))
        .select("id", F.explode(F.split(query, "&")).alias("param"))
        .select("id", "param", urls.is_tracking_param(F.lower("param")).alias("tracking"))
    )


@register
def valid_stream_url(spark, sf):
    rows = views.channels(spark, sf).select(F.lit("channel").alias("src"), "id", "link")
    pages = views.table(spark, sf, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("link")
    )
    link = trim(F.col("link"))
    return rows.unionByName(pages).select("src", "id", urls.is_stream_url(link).alias("valid"))


@register
def probeable_url(spark, sf):
    return views.channels(spark, sf).select("id", urls.is_probeable(F.col("link")).alias("probeable"))


@register
def normalize_name(spark, sf):
    return names.with_normalized_name(views.channels(spark, sf), "name", "normalized").select("id", "normalized")


@register
def normalize_document_text(spark, sf):
    named = names.with_normalized_name(views.documents(spark, sf), "name", "normalized")
    return named.select("id", F.md5(F.col("normalized").cast("binary")).alias("digest"))


@register
def generic_name(spark, sf):
    words = F.explode(F.split(F.lower("p_name"), " "))
    part = views.table(spark, sf, "part").select("p_partkey", words.alias("word"))
    channel = views.channels(spark, sf).select(F.col("id").alias("p_partkey"), F.lower("group_name").alias("word"))
    return part.unionByName(channel).select(
        "p_partkey", "word", names.is_generic_name(F.col("word")).alias("generic")
    )


@register
def name_eligible(spark, sf):
    rows = names.with_eligible_name(views.channels(spark, sf), "name", "eligible")
    rows = names.with_eligible_name(rows, "group_name", "eligible_group")
    return rows.select("id", "eligible", "eligible_group")


@register
def display_name(spark, sf):
    shown = names.display_name(F.col("name"), F.col("tvg_name"))
    return views.channels(spark, sf).select("id", shown.alias("shown"))


@register
def effective_group(spark, sf):
    return views.channels(spark, sf).select(
        "id", names.effective_group(F.col("group_name")).alias("effective")
    )


@register
def safe_group_name(spark, sf):
    return views.channels(spark, sf).select(
        "id",
        names.safe_group_name(F.col("group_name")).alias("safe_group"),
        names.safe_group_name(F.col("link")).alias("safe_link"),
    )


# --- parsing ----------------------------------------------------------------


def _parsed(spark, sf):
    # Numbered lines are a written table, as they are when files are read in splits.
    lines = materialize(views.lines(spark, sf), "lines")
    return parse.entries_of_links(parse.links_in_lines(lines))


_ENTRY_COLUMNS = [
    "file", "line_no", "name", "link", "group_name", "tvg_id", "tvg_name", "tvg_logo", "epg_url",
]


@register
def parse_channels(spark, sf):
    parsed = materialize(_parsed(spark, sf), "parsed")
    numbered = ordering.renumber(parsed, *[F.asc(c) for c in parse.PLACE])
    return numbered.select("id", *_ENTRY_COLUMNS, *_extras())


@register
def parse_small_playlists(spark, sf):
    links = parse.links_in_texts(views.small_texts(spark, sf))
    return parse.entries_of_links(links).select(*_ENTRY_COLUMNS, *_extras())


def _written_texts(texts: DataFrame, folder: str, encoding: str = "utf-8", mark: bytes = b"", packed: bool = False) -> str:
    """Playlists (``file``, ``text``) as files, all in one new folder; a glob of the files."""
    spark = texts.sparkSession
    # A folder of Spark's own file system; files are put into it through Arrow.
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    uri = fs.makeQualified(place).toString()
    ending = ".txt.gz" if packed else ".txt"

    def write(frames):
        fs, base = pyarrow.fs.FileSystem.from_uri(uri)
        for frame in frames:
            for file, text in zip(frame["file"], frame["text"]):
                content = mark + text.encode(encoding)
                with fs.open_output_stream(f"{base}/playlist={file.removesuffix('.m3u')}{ending}", compression=None) as out:
                    out.write(gzip.compress(content, 6, mtime=0) if packed else content)
            yield frame[["file"]]

    texts.select("file", "text").mapInPandas(write, "file string").count()
    return f"{folder}/playlist=*"


def _small_texts(spark, sf) -> DataFrame:
    """The small playlists, worked out once for several folders of files."""
    return materialize(views.small_texts(spark, sf).select("file", "text"), "texts")


def _ended(texts: DataFrame) -> DataFrame:
    """Texts with a line end behind the last line."""
    return texts.withColumn("text", F.concat("text", F.lit("\n")))


@register
def read_written_playlists(spark, sf):
    texts = _small_texts(spark, sf)
    plain, packed = (_written_texts(_ended(texts), _new_folder(spark, "playlists"), packed=p) for p in (False, True))
    forms = {"whole": (plain, 1 << 24), "lines": (plain, 4096), "gzip": (packed, 1 << 24)}
    forms["utf16"] = (_written_texts(texts, _new_folder(spark, "utf-16-le"), "utf-16-le", b"\xff\xfe"), 4096)
    forms["utf32"] = (_written_texts(texts, _new_folder(spark, "utf-32-be"), "utf-32-be", b"\0\0\xfe\xff"), 4096)
    rows = None
    for form, (source, limit) in forms.items():
        playlist = F.regexp_extract("file", r"playlist=([^/.]*)", 1)
        columns = [c for c in _ENTRY_COLUMNS if c != "file"]
        read = parse_sources(spark, [source], limit).select(
            F.lit(form).alias("form"), playlist.alias("playlist"), *columns, *_extras()
        )
        rows = read if rows is None else rows.unionByName(read)
    return rows


@register
def read_fetched_playlists(spark, sf):
    """Playlists behind web links, one per supplier; the bytes of a link follow from the link."""
    key = F.col("s_suppkey")
    links = views.table(spark, sf, "supplier").select(
        key.cast("int").alias("src_ord"), F.concat(F.lit("https://lists.example/"), key.cast("string"), F.lit(".m3u")).alias("url")
    )

    def fetch(link: str) -> bytes:
        number = link.rsplit("/", 1)[1].removesuffix(".m3u")
        text = f"#EXTM3U\n#EXTINF:-1 tvg-id=\"{number}\",Supplier {number}\nhttp://s.example/{number}\n"
        return text.encode("utf-16" if int(number) % 2 else "utf-8")

    parsed = parse.entries_of_links(parse.links_in_texts(fetched_texts(links, fetch)))
    return parsed.select("file", "name", "link", "tvg_id")


@register
def merge_sources(spark, sf):
    texts = _ended(_small_texts(spark, sf))
    sources = [_written_texts(texts, _new_folder(spark, "playlists"), packed=p) for p in (True, False)]
    return read_playlists(spark, sources, merge=True, whole_file_bytes=4096).select("id", "name", "link", "epg_url")


@register
def parse_extra_attributes(spark, sf):
    found = views.lines(spark, sf).withColumn("line", trim(F.col("line"))).where(entries.is_entry(F.col("line")))
    return entries.with_extra_attributes(found, "line").select("file", "line_no", *_extras())


@register
def named_attributes(spark, sf):
    line = F.col("line")
    wanted = {"tvg_id": "tvg-id", "tvg_name": "tvg-name", "tvg_logo": "tvg-logo", "group_title": "group-title"}
    return (
        views.lines(spark, sf)
        .withColumn("line", trim(line))
        .where(entries.is_entry(line))
        .select(
            "file",
            "line_no",
            *[entries.named_attribute(line, a).alias(c) for c, a in wanted.items()],
            entries.entry_name(line, entries.named_attribute(line, "tvg-name")).alias("name"),
        )
    )


@register
def header_epg(spark, sf):
    return (
        views.lines(spark, sf)
        .where("line_no = 0")
        .select("file", entries.header_epg(F.col("line")).alias("epg_url"))
    )


@register
def group_override(spark, sf):
    return _parsed(spark, sf).groupBy("file", "group_name").agg(F.count("*").alias("channels"))


# --- distinct ---------------------------------------------------------------


@register
def merge_playlists(spark, sf):
    merged = dedupe.merge_channels(views.channels(spark, sf))
    return merged.select("id", "name", "link", "group_name")


@register
def merge_parsed_playlists(spark, sf):
    return load_parsed(_parsed(spark, sf), merging=True).select("id", "name", "link", "epg_url")


@register
def remove_duplicates(spark, sf):
    return dedupe.remove_duplicates(views.channels(spark, sf)).select("id", "name", "link")


@register
def remove_duplicate_documents(spark, sf):
    return dedupe.remove_duplicates(views.documents(spark, sf)).select("id", "link")


@register
def remove_duplicates_counts(spark, sf):
    rows = views.channels(spark, sf)
    kept = dedupe.remove_duplicates(rows)
    counts = groups.one_row({"total": (rows, F.count("*")), "kept": (kept, F.count("*"))})
    return counts.select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"))


@register
def distinct_groups(spark, sf):
    return dedupe.distinct_groups(views.channels(spark, sf))


# --- filters ----------------------------------------------------------------


def _names(df):
    return df.select("id", "name", "tvg_name", "group_name")


@register
def filter_group(spark, sf):
    return _names(filters.filter_channels(views.channels(spark, sf), group=" econ "))


@register
def filter_name(spark, sf):
    return _names(filters.filter_channels(views.channels(spark, sf), name="BOLT"))


@register
def filter_regex(spark, sf):
    return _names(filters.filter_channels(views.channels(spark, sf), name="^(us|fr).*bolt", use_regex=True))


@register
def filter_bad_regex(spark, sf):
    return _names(filters.filter_channels(views.channels(spark, sf), name="[de", use_regex=True))


@register
def filter_group_and_name(spark, sf):
    return _names(
        filters.filter_channels(views.channels(spark, sf), group="SPORT", name=r"\d 4k$", use_regex=True)
    )


@register
def filter_documents(spark, sf):
    found = filters.filter_channels(views.documents(spark, sf), name="Licensed under")
    return found.select("id", "group_name", "link")


@register
def filter_documents_regex(spark, sf):
    found = filters.filter_channels(
        views.documents(spark, sf), name=r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", use_regex=True
    )
    return found.select("id", "group_name", "link")


# --- enrichment -------------------------------------------------------------


@register
def categorize(spark, sf):
    return enrichment.auto_categorize(views.channels(spark, sf)).select("id", "category", "group_name")


@register
def categorize_keywords(spark, sf):
    """Keywords from a table: every name of a part with its size, for the brand of the first such part."""
    parts = views.table(spark, sf, "part")
    keyword = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    keywords = parts.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("rank"), keyword.alias("keyword"))
    return enrichment.categorize_by_table(views.channels(spark, sf), keywords).select("id", "name", "category")


@register
def categorize_documents(spark, sf):
    return enrichment.auto_categorize(views.documents(spark, sf)).select("id", "category", "group_name")


@register
def detect_language(spark, sf):
    return enrich.with_language(views.channels(spark, sf)).select("id", *_language())


@register
def detect_language_documents(spark, sf):
    return enrich.with_language(views.documents(spark, sf)).select("id", *_language())


@register
def rename_literal(spark, sf):
    renamed = enrichment.rename_channels(views.channels(spark, sf), "Bolt", "$1\\")
    return renamed.select("id", "name", "tvg_name")


@register
def rename_regex(spark, sf):
    renamed = enrichment.rename_channels(
        views.channels(spark, sf), r"([a-z]+) (\d+)", "$2 $1 <$&> $$", use_regex=True
    )
    return renamed.select("id", "name", "tvg_name")


@register
def rename_bad_regex(spark, sf):
    renamed = enrichment.rename_channels(views.channels(spark, sf), "(", "x", use_regex=True)
    return renamed.select("id", "name", "tvg_name")


@register
def rename_empty(spark, sf):
    rows = views.channels(spark, sf)
    kept = enrichment.rename_channels(rows, "", "x").select("id", "name", "tvg_name")
    # The shown name replaces the name, so only rows without one keep their own.
    gone = enrichment.rename_channels(rows.withColumn("tvg_name", F.lit(None).cast("string")), " ", None)
    return kept.join(gone.select("id", F.col("name").alias("without_blanks")), "id")


@register
def rename_documents(spark, sf):
    renamed = enrichment.rename_channels(views.documents(spark, sf), "the ", "THE* ")
    return renamed.select("id", F.md5(F.col("name").cast("binary")).alias("digest"))


# --- order and groups -------------------------------------------------------


def _sorted_query(by: str, descending: bool) -> Query:
    def query(spark, sf):
        ordered = ordering.sort_channels(views.channels(spark, sf), by, descending)
        return ordered.select("id", "name", "tvg_name", "group_name", "link")

    return query


for _by in ("name", "group", "group-name"):
    QUERIES[f"sort_{_by.replace('-', '_')}"] = _sorted_query(_by, False)
    QUERIES[f"sort_{_by.replace('-', '_')}_desc"] = _sorted_query(_by, True)


@register
def split_by_group(spark, sf):
    return groups.split_by_group(views.channels(spark, sf)).select("id", "group_label", "name", "link")


@register
def group_sizes(spark, sf):
    return dedupe.group_labels(views.channels(spark, sf)).select("group_label", "rows")


@register
def first_epg(spark, sf):
    return ordering.first_epg(load_parsed(_parsed(spark, sf), merging=False))


@register
def stage_counts(spark, sf):
    rows = enrich.with_language(enrichment.auto_categorize(views.channels(spark, sf)))
    return rows.agg(
        groups.group_count().alias("group_count"),
        F.count_if(F.col("category") != "Unknown").alias("categorized_count"),
        F.count("language").alias("languages_count"),
    )


# --- responses --------------------------------------------------------------


@register
def acceptable_status(spark, sf):
    return views.responses(spark, sf).select(
        "id", "attempt", responses.is_success(F.col("status")).alias("acceptable")
    )


@register
def error_page(spark, sf):
    text = responses.page_text(F.col("body"))
    return views.responses(spark, sf).select(
        "id", "attempt", responses.is_error_page(text).alias("error_page")
    )


@register
def error_page_in_pages(spark, sf):
    text = responses.page_text(F.encode("html", "UTF-8"))
    return views.table(spark, sf, "pages").select("page_id", responses.is_error_page(text).alias("error_page"))


@register
def header_bitrate(spark, sf):
    return views.responses(spark, sf).select(
        "id",
        "attempt",
        responses.header_bitrate(F.col("icy_br")).alias("bitrate"),
        responses.header_bitrate((F.col("id") * 7_919).cast("string")).alias("wrapped"),
    )


@register
def parse_codecs(spark, sf):
    codec_list = F.concat_ws(
        ", ",
        F.element_at(F.array(*map(F.lit, ["avc1.4d", "HVC1.1", "vp9", "av01.0", "text"])), (F.col("id") % 5 + 1).cast("int")),
        F.element_at(F.array(*map(F.lit, ["mp4a.40", "ac-3", "opus"])), (F.col("id") % 3 + 1).cast("int")),
        F.col("name"),
        F.when(F.col("id") % 7 == 0, "hev1.2"),
    )
    return (
        views.channels(spark, sf)
        .withColumn("codecs", codec_list)
        .select(
            "id",
            responses.video_codec(F.col("codecs")).alias("video"),
            responses.audio_codec(F.col("codecs")).alias("audio"),
        )
    )


@register
def classify_responses(spark, sf):
    classified = responses.with_verdict(views.responses(spark, sf))
    return classified.select("id", "attempt", "is_alive", *_info())


@register
def resolution(spark, sf):
    classified = responses.with_verdict(views.responses(spark, sf))
    return classified.select("id", "attempt", names.resolution(F.col("stream_info")).alias("resolution"))



@register
def probe_retry(spark, sf):
    # Links that several rows share have one captured answer per row; probe rows.
    by_row = views.responses(spark, sf).withColumn("link", F.concat("link", F.lit("#"), F.col("id")))
    return probe.probe_results(responses.with_verdict(by_row)).select("link", "is_alive", *_info())


def _one_response_per_link(spark, sf):
    """Responses of the first row of every link."""
    first = views.channels(spark, sf).groupBy("link").agg(F.min("id").alias("id"))
    return views.responses(spark, sf).join(first, ["link", "id"], "left_semi")


def _link_probes(spark, sf):
    return probe.probe_results(responses.with_verdict(_one_response_per_link(spark, sf)))


@register
def filter_working(spark, sf):
    working = probe.filter_working(views.channels(spark, sf), _link_probes(spark, sf))
    return working.select("id", "name", "link", *_info())


@register
def success_rate(spark, sf):
    return probe.link_counts(views.channels(spark, sf), _link_probes(spark, sf))


@register
def content_signature(spark, sf):
    hashed = responses.content_signature(F.col("status"), F.col("body"))
    return views.responses(spark, sf).select("id", "attempt", hashed.alias("content_hash"))


@register
def content_signature_documents(spark, sf):
    hashed = responses.content_signature(F.col("status"), F.col("body"))
    return views.document_responses(spark, sf).select("id", hashed.alias("content_hash"))


def _flagged(df: DataFrame, captured: DataFrame) -> DataFrame:
    flagged = enrichment.flag_content_duplicates(probe.attach_content_hash(df, captured))
    return flagged.select("id", "content_hash", F.col("extra_attributes")["duplicate-of"].alias("duplicate_of"))


@register
def content_duplicates(spark, sf):
    return _flagged(views.channels(spark, sf), _one_response_per_link(spark, sf))


@register
def content_duplicate_documents(spark, sf):
    named = views.documents(spark, sf).withColumn("name", F.concat(F.lit("doc "), F.col("id")))
    return _flagged(named, views.document_responses(spark, sf))


# --- sinks and the whole run ------------------------------------------------


@register
def format_entry(spark, sf):
    rows = enrich.with_language(load_parsed(_parsed(spark, sf), merging=False))
    return rows.select(
        "id", entries.format_entry().alias("entry"), entries.format_group_line().alias("group_line")
    )


@register
def write_playlist_lines(spark, sf):
    return playlist_lines(load_parsed(_parsed(spark, sf), merging=False))


@register
def write_group_lines(spark, sf):
    return group_playlist_lines(views.channels(spark, sf), "out")


def _new_folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/castsieve/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@register
def write_group_playlists(spark, sf):
    folder = _new_folder(spark, "groups")
    writers.write_group_playlists(views.channels(spark, sf), folder, "out.m3u")
    return spark.read.text(folder).select("playlist", F.col("value").alias("line"))


@register
def write_group_files(spark, sf):
    """One file per group: names, sizes and contents."""
    folder = _new_folder(spark, "group-files")
    writers.write_group_files(views.channels(spark, sf), folder, "out.m3u")
    content = F.col("content")
    return spark.read.format("binaryFile").load(folder).select(
        F.col("_metadata.file_name").alias("file_name"), "length", F.md5(content).alias("md5")
    )


@register
def write_table(spark, sf):
    folder = _new_folder(spark, "table")
    writers.write_table(views.channels(spark, sf), folder)
    return spark.read.parquet(folder).select("id", "name", "link", "group_name", "tvg_name", "category")


@register
def probe_links(spark, sf):
    def fetch(link, timeout):
        # The answer follows from the link: dead, with a bitrate, or plain.
        kind = len(link) % 3
        return (200 if kind else 404), ("128" if kind == 1 else None), b"media"

    return probe.probe_links(views.channels(spark, sf), fetch).select(
        "link", "is_alive", F.col("stream_info.bitrate").alias("bitrate")
    )


_CLEAN = CleanOptions(
    name_filter="l", rename_pattern="bolt", rename_replacement="Bolt TV", sort_by="group-name",
    skip_validation=True,
)


@register
def clean_unvalidated(spark, sf):
    cleaned = clean_channels(load_parsed(_parsed(spark, sf), merging=True), _CLEAN).channels
    return cleaned.select("id", "name", "link", "tvg_name", "group_name", "category", *_language())


@register
def stream_playlists(spark, sf):
    """Two deliveries of compressed playlists to a watched folder, the second cleaned against the first."""
    folder, out, mark = (_new_folder(spark, name) for name in ("arriving", "cleaned", "mark"))
    options = replace(_CLEAN, sort_by="none")
    texts = _ended(_small_texts(spark, sf))
    playlist = F.regexp_replace("file", r"\.m3u$", "")
    # Each delivery has a folder of its own in the watched one.
    for number, delivery in enumerate((playlist < "small5", playlist >= "small5")):
        _written_texts(texts.where(delivery), f"{folder}/delivery={number}", packed=True)
        start_cleaning(spark, folder, out, mark, options).awaitTermination()
    cleaned = spark.read.parquet(out)
    return cleaned.select("id", "name", "link", "tvg_name", "group_name", "category", *_language())


@register
def clean_validated(spark, sf):
    options = CleanOptions(content_duplicates=True, sort_by="name", descending=True)
    rows = views.channels(spark, sf)
    cleaned = clean_channels(
        rows, options, probes=_link_probes(spark, sf), responses=_one_response_per_link(spark, sf)
    ).channels
    return cleaned.select(
        "id", "name", "link", "group_name", "category", *_language(), *_info(), "content_hash", *_extras()
    )


@register
def clean_defaults(spark, sf):
    options = CleanOptions(export_path=_new_folder(spark, "out"))
    cleaned = clean_channels(views.channels(spark, sf), options, probes=_link_probes(spark, sf)).channels
    return cleaned.select("id", "name", "link", "group_name", "category", *_language(), *_info())


@register
def processing_report(spark, sf):
    return clean_channels(
        views.channels(spark, sf), CleanOptions(name_filter="o"), probes=_link_probes(spark, sf)
    ).report
