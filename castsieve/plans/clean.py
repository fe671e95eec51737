"""The whole cleaning run, step after step in fixed order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.enrich import with_language
from ..operators.dedupe import remove_duplicates
from ..operators.enrichment import (
    auto_categorize,
    flag_content_duplicates,
    rename_channels,
)
from ..operators.filters import filter_channels
from ..operators.groups import group_count
from ..operators.ordering import sort_channels
from ..operators.probe import (
    Fetch,
    attach_content_hash,
    capture_once,
    filter_working,
    probe_links,
)
from ..sources.playlists import WHOLE_FILE_BYTES, read_playlists
from ..sources.writers import write_group_files, write_group_playlists, write_playlist
from ..workspace import materialize


@dataclass(frozen=True)
class CleanOptions:
    """What a run does.  ``use_regex`` is for both the name filter and rename."""

    merge: bool = False
    remove_doubles: bool = True
    group_filter: str | None = None
    name_filter: str | None = None
    use_regex: bool = False
    rename_pattern: str | None = None
    rename_replacement: str | None = None
    categorize: bool = True
    detect_language: bool = True
    content_duplicates: bool = False
    sort_by: str = "none"
    descending: bool = False
    skip_validation: bool = False
    concurrency: int = 10
    timeout: float = 10.0
    split_by_group: bool = False
    # One file per group instead of one folder of parts.
    group_files: bool = False
    export_path: str | None = None
    export_name: str = "playlist"


@dataclass(frozen=True)
class Earlier:
    """What runs before this one have kept: ``link_key, name_key``, and ``content_hash, name`` of flagged contents."""

    kept: DataFrame
    contents: DataFrame


@dataclass(frozen=True)
class CleanResult:
    """``kept`` is what duplicates have left, ``flagged`` the rows with content signatures; None if not asked for."""

    channels: DataFrame
    report: DataFrame
    kept: DataFrame | None = None
    flagged: DataFrame | None = None


def clean_channels(
    loaded: DataFrame,
    options: CleanOptions = CleanOptions(),
    probes: DataFrame | None = None,
    responses: DataFrame | None = None,
    fetch: Fetch | None = None,
    earlier: Earlier | None = None,
) -> CleanResult:
    """Clean numbered channels, as a continuation of ``earlier`` runs if given.

    Links are judged by ``probes`` (one row per link), content signatures come
    from ``responses``; what is not given is fetched.  Duplicates go before the
    filters, as a filtered-out row can still push out a later one.
    """
    # Figures of the report are counted while the rows go by, in the jobs that write them.
    figures = {name: Observation() for name in ("loaded", "kept", "enriched", "working")}
    rows = F.count(F.lit(1)).alias("rows")
    named = [F.count_if(F.col("category") != "Unknown").alias("categorized"), F.count("language").alias("languages")]
    loaded = loaded.observe(figures["loaded"], rows)
    kept = remove_duplicates(loaded, earlier=earlier.kept if earlier else None) if options.remove_doubles else loaded
    if earlier:
        # Read for this run and for those that continue it.
        kept = materialize(kept, "kept-rows")
    chosen = filter_channels(kept.observe(figures["kept"], rows, *named), options.group_filter, options.name_filter, options.use_regex)
    chosen = rename_channels(
        chosen, options.rename_pattern, options.rename_replacement, options.use_regex
    )
    if options.categorize:
        chosen = auto_categorize(chosen)
    if options.detect_language:
        chosen = with_language(chosen)
    # Read by the report, by sorting (twice) and by the link join.
    enriched = materialize(chosen.observe(figures["enriched"], rows, *named), "enriched")
    working = enriched
    if options.content_duplicates:
        if responses is None:
            if fetch is None:
                raise ValueError("content duplicates need captured responses or a fetch function")
            responses = capture_once(working, fetch, options.concurrency, options.timeout)
        working = flag_content_duplicates(attach_content_hash(working, responses), earlier.contents if earlier else None)
    flagged = working
    working = sort_channels(working, options.sort_by, options.descending)
    if not options.skip_validation:
        if probes is None:
            if fetch is None:
                raise ValueError("validation needs probe results or a fetch function")
            probes = probe_links(working, fetch, options.concurrency, options.timeout)
        working = filter_working(working, probes)
    if options.content_duplicates or not options.skip_validation:
        # Read by the report, the writers and the caller.
        working = materialize(working.observe(figures["working"], rows), "working")
    else:
        figures["working"] = figures["enriched"]
    if options.export_path and options.split_by_group and options.group_files:
        write_group_files(working, options.export_path, options.export_name)
    elif options.export_path and options.split_by_group:
        write_group_playlists(working, options.export_path, options.export_name)
    elif options.export_path:
        write_playlist(working, options.export_path)
    tables = {"loaded": loaded, "kept": kept, "enriched": enriched, "working": working}
    wanted = {"loaded": [rows], "kept": [rows, *named], "enriched": [rows, *named], "working": [rows]}
    seen = {name: _seen(figures[name], tables[name], wanted[name]) for name in tables}
    report = _report(working, seen, options)
    return CleanResult(working, report, kept if options.remove_doubles else None, flagged)


def _seen(observation: Observation, table: DataFrame, figures: list[Column]) -> dict[str, int]:
    try:
        return observation.get
    except Py4JJavaError:
        # Spark does not count where it knows beforehand that there are no rows.
        return table.agg(*figures).first().asDict()


def _report(working: DataFrame, seen: dict[str, dict[str, int]], options: CleanOptions) -> DataFrame:
    """The figures of a run; only the groups are counted on the written rows, from one column."""

    def added(name: str, on: bool) -> int:
        return seen["enriched"][name] - seen["kept"][name] if on else 0

    counted = {
        "working_count": seen["working"]["rows"],
        "total_count": seen["enriched"]["rows"],
        "doubles_removed_count": seen["loaded"]["rows"] - seen["kept"]["rows"],
        "original_count": seen["loaded"]["rows"],
        "group_count": None,
        "categorized_count": added("categorized", options.categorize),
        "languages_count": added("languages", options.detect_language),
    }
    groups = working.agg(group_count().cast("bigint").alias("group_count"))
    return groups.select(*[F.col(c) if n is None else F.lit(n).cast("bigint").alias(c) for c, n in counted.items()])


def clean_playlists(
    spark: SparkSession,
    sources: list[str],
    options: CleanOptions = CleanOptions(),
    probes: DataFrame | None = None,
    responses: DataFrame | None = None,
    fetch: Fetch | None = None,
    fetch_playlist: Callable[[str], bytes] | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> CleanResult:
    """Read, clean and, with an export path, write playlists.

    Sources may be files, folders, globs and, with ``fetch_playlist``, web links.
    """
    loaded = read_playlists(spark, sources, options.merge, whole_file_bytes, fetch_playlist)
    return clean_channels(loaded, options, probes, responses, fetch)
