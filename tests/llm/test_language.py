"""Language codes: held-out accuracy, codewords, odd inputs."""

import numpy as np
import pytest

from castsieve.llm.language import codewords, fit, held_out, predict


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, fit(docs.where(~held_out()))


def test_held_out_accuracy(learned):
    docs, codes = learned
    found = predict(docs.where(held_out()), codes, keep=["doc_id", "lang"]).collect()
    assert len(found) > 300 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    again = predict(docs.where(held_out()).repartition(3), fit(docs.where(~held_out()).repartition(5)), keep=["doc_id", "lang"])
    assert {(r.doc_id, r.lang_pred) for r in again.collect()} == {(r.doc_id, r.lang_pred) for r in found}


def test_only_the_text_counts(spark, learned):
    _, codes = learned
    rows = [(1, None, "en", 1), (2, "", None, 2), (3, "12 !? 3\n", "fr", 3), (4, "la de les", "x", 4), (None, "la de les", "de", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    assert predict(df, codes).columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    found = {r.doc_id: r for r in predict(df, codes).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0
    assert found[4][-3:] == found[None][-3:]
    assert predict(df.limit(0), codes).count() == 0


def test_few_languages(spark):
    schema = "doc_id long, text string, lang string"
    some = spark.createDataFrame([(1, "abc", None), (2, None, "en")], schema)
    assert [r.lang_pred for r in predict(some, fit(some)).collect()] == ["und", "und"]
    one = spark.createDataFrame([(1, "abc", "xx")] * 3, schema)
    assert {r.lang_pred for r in predict(one, fit(one, sample=1)).collect()} == {"xx"}
    two = spark.createDataFrame([(i, "uuuu", "u") if i % 2 else (i, "aaa ab", "a") for i in range(40)], schema)
    assert all(r.lang == r.lang_pred for r in predict(two, fit(two)).collect())


def test_codewords_are_apart():
    for classes in (1, 2, 3, 4, 5, 9, 40):
        code = codewords(classes)
        assert len(code) == classes and len({tuple(c) for c in code}) == classes
        if classes > 1:
            assert all(set(column) == {0, 1} for column in code.T)
        if classes > 3:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3
