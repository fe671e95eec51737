"""The pipeline: each stage against a plain version on its own input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_decontamination as windows  # noqa: E402
import test_line_dedup as lines  # noqa: E402
import test_ngram_join as grams  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from castsieve.llm import quality  # noqa: E402
from castsieve.workspace import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(tables):
    assert [t.schema for t in tables[1:-1]] == [tables[0].schema] * 4
    # On these few documents line dedup leaves no similar ones; test_similar_documents has some.
    assert 0 < tables[4].count() <= tables[3].count() <= tables[2].count() <= tables[1].count() < tables[0].count()


def test_similar_documents(spark):
    """Texts that are alike but broken into other lines pass line dedup; one of them stays."""
    words = [f"word{i * 37 % 211}" for i in range(211)]
    broken = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [broken(words, 10), broken(words, 7), broken(words[:100] + ["new"] + words[101:], 13), broken(words[::-1], 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines_gone = corpus_pipeline.line_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in lines_gone.collect()) == [0, 1, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, lines_gone, SF).collect()) == [0, 3]


def test_classifier_follows_labels(spark, tables):
    kept = {d for d, _ in rows(tables[1])}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in kept) == bool(r.quality) for r in labels]
    assert sum(right) / len(right) > 0.95


def test_lines(tables):
    before = dict(rows(tables[1]))
    expected = {}
    for doc_id, _, removed in lines.plain(list(before.items())):
        left = [x for k, x in enumerate(before[doc_id].split("\n")) if k not in removed]
        if not removed or "\n".join(left).strip():
            expected[doc_id] = "\n".join(left)
    assert dict(rows(tables[2])) == expected
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())


def test_groups(tables):
    given = rows(tables[2])
    least = {c for _, _, c in grams.plain(given, 5, 80)[0]}
    assert {d for d, _ in rows(tables[3])} == least


def test_benchmark(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in windows.plain(rows(tables[3]), items) if not r[5]}
    assert {d for d, _ in rows(tables[4])} == clean


def test_packing(tables):
    pieces = tables[5].collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in rows(tables[4])}
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert quality.LABELLERS


def test_odd_documents(spark):
    """Nulls, repeated rows, other columns: no stage fails; an empty table passes through."""
    text = "Some words that make a text, and a few more of them. And then another line\nof words."
    docs = spark.createDataFrame(
        [(1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 1), (None, text, None, None, None, 2), (2, None, "x", "s", 0, 3), (3, "", None, "s", 0, 4)],
        "doc_id long, text string, lang string, source string, n_chars long, _row int",
    )
    for given in (docs, docs.limit(0)):
        at = given
        for name, stage in corpus_pipeline.STAGES:
            at = materialize(stage(spark, at, SF), name)
        assert (at.count() > 0) == (given is docs)
