"""What the physical plans of the wide operators must and must not hold."""

import pytest
from pyspark.sql import functions as F

from castsieve.catalog import views
from castsieve.operators import dedupe, enrichment, groups, ordering, parse
from castsieve.sources import playlists
from castsieve.workspace import materialize

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(views.channels(spark, SF), "plan-rows")


def test_nothing_gathers_all_rows_in_one_partition(spark, rows):
    lines = views.lines(spark, SF)
    for df in (
        dedupe.first_per_link(rows),
        dedupe.merge_channels(rows),
        dedupe.remove_duplicates(rows),
        ordering.sort_channels(rows, "group-name"),
        groups.split_by_group(rows),
        enrichment.flag_content_duplicates(rows),
        parse.entries_of_links(parse.links_in_lines(lines)),
    ):
        plan = plan_of(df)
        assert "SinglePartition" not in plan
        assert "CartesianProduct" not in plan


def test_merge_keeps_one_row_per_link_before_the_shuffle(rows):
    plan = plan_of(dedupe.first_per_link(rows))
    assert "row_number(), 1, Partial" in plan
    assert plan.count("Exchange") == 1


def test_small_files_are_parsed_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.m3u").write_text("#EXTINF:-1,a\nhttp://ok.tv/1\n")
    texts = playlists.read_texts(spark, [str(tmp_path)], 1 << 20)
    plan = plan_of(parse.entries_of_links(parse.links_in_texts(texts)))
    assert "Exchange" not in plan and "Window" not in plan


def test_large_files_are_not_opened_as_a_whole(spark, tmp_path):
    (tmp_path / "a.m3u").write_text("#EXTINF:-1,a\nhttp://ok.tv/1\n")
    plan = playlists.read_texts(spark, [str(tmp_path)], 5)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,5)]" in plan


def test_lines_are_shuffled_by_block_and_only_when_needed(spark):
    lines = materialize(views.lines(spark, SF), "plan-lines")
    plan = plan_of(parse.links_in_lines(lines).select("link_line", "before"))
    window = plan[plan.index("Window") :]
    assert window.count("Exchange") >= 1 and "_block" in window.split("Exchange")[1].split("\n")[0]
    # The test for entry and link lines runs before that shuffle.
    assert window.index("Filter") > window.index("Exchange")


def test_scans_read_only_what_is_needed(rows):
    plan = plan_of(dedupe.group_labels(rows))
    assert "ReadSchema: struct<id:bigint,group_name:string>" in plan


def test_chosen_rows_are_removed_by_plain_joins_spark_can_split(rows):
    keys = materialize(rows.select("id", F.col("link").alias("link_key"), F.col("name").alias("name_key")), "keys")
    chosen = materialize(dedupe._mutual_first(keys), "chosen")
    plan = plan_of(keys.join(chosen.select("link_key").hint("merge"), "link_key", "left_anti"))
    # Scan, exchange, sort on both sides: the form adaptive skew handling knows.
    assert plan.count("Exchange hashpartitioning(link_key") == 2
    assert "Aggregate" not in plan


def test_figures_of_a_run_need_no_scan_of_their_own(spark, rows):
    from castsieve.operators.groups import processing_report
    from castsieve.operators.dedupe import remove_duplicates
    from castsieve.plans.clean import CleanOptions, clean_channels

    for options in (CleanOptions(skip_validation=True), CleanOptions(skip_validation=True, remove_doubles=False, categorize=False)):
        result = clean_channels(rows, options)
        plan = plan_of(result.report)
        # Groups are counted from one column of the written rows.
        assert plan.count("Scan parquet") == 1 and "ReadSchema: struct<group_name:string>" in plan
        kept = remove_duplicates(rows) if options.remove_doubles else rows
        scanned = processing_report(rows, kept, result.channels, result.channels, options.categorize).first()
        assert result.report.first() == scanned
    empty = clean_channels(rows.limit(0), CleanOptions(skip_validation=True)).report.first()
    assert list(empty) == [0] * 7
