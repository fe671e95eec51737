"""Repeated lines of one or two words: the registered query and the pipeline take them too."""

import random

import pytest
from test_line_dedup import made, plain

import corpus_pipeline
from castsieve.llm import queries
from castsieve.llm.line_dedup import repeated_lines, without_repeated_lines

LONG = "这是一行没有空格的很长的中文文字"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    few = ["a", "a a", " A", "a b", "b a", "b\ta", LONG, "ยินดีต้อนรับ", "-", "", " ", "a b c", "a b c d e", "e a b d c x"]
    return [(i, "\n".join(rng.choice(few) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(100, LONG), (101, LONG)]


def test_equals_all_comparisons_from_one_word(spark, rows):
    given = rows + [(1000 + i, t) for i, t in made(5)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_lines, r.removed) for r in repeated_lines(df, least=1).collect())
    assert found == sorted(plain(given, least=1))
    assert without_repeated_lines(df, least=1).where("doc_id = 101").count() == 0


def test_registered_query_has_no_floor(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_lines, r.removed) for r in found) == sorted(plain(rows, least=1))


def test_pipeline_stage_has_no_floor(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    expected = {}
    for doc_id, _, removed in plain(rows, least=1):
        text = dict(rows)[doc_id]
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in removed)
        if not removed or left.strip():
            expected[doc_id] = left
    assert kept == expected
