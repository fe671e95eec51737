"""Weak labels: recovered rates, agreement with given labels, odd inputs."""

import random
from collections import Counter

import numpy as np

from castsieve.llm import quality


def test_rates_are_recovered():
    rng = np.random.default_rng(3)
    n, k = 60_000, len(quality.LABELLERS)
    poor = rng.random(n) < 0.2
    on_poor, on_sound = rng.uniform(0.4, 0.9, k), rng.uniform(0.001, 0.05, k)
    fired = rng.random((n, k)) < np.where(poor[:, None], on_poor, on_sound)
    codes = (fired << np.arange(k)).sum(1)
    found = quality.estimate(dict(Counter(codes.tolist())))
    assert abs(found.share - 0.2) < 0.01
    assert np.abs(found.speaks_on_poor - on_poor).max() < 0.03
    assert np.abs(found.speaks_on_sound - on_sound).max() < 0.01
    assert ((found.posterior(codes) > 0.5) == poor).mean() > 0.98
    # How often each labeller is right when it speaks, though nobody told.
    right = [poor[fired[:, i]].mean() for i in range(k)]
    assert np.abs(np.array(list(found.accuracies().values())) - right).max() < 0.05


def test_a_clean_corpus_stays():
    found = quality.estimate({0: 10_000, 1: 3})
    assert found.posterior(np.array([0]))[0] < 0.01
    assert quality.estimate({}).posterior(np.array([0]))[0] < 0.5


def test_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = quality.fit(docs)
    scored = quality.score(docs, scorer, keep=["doc_id"])
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "sound")
    both = scored.join(labels, "doc_id").collect()
    assert np.mean([r.accepted == bool(r.sound) for r in both]) > 0.97
    again = quality.score(docs, quality.fit(docs.repartition(4)), keep=["doc_id"]).collect()
    first = {r.doc_id: r.quality for r in scored.collect()}
    assert all(abs(first[r.doc_id] - r.quality) < 1e-3 for r in again)
    kept = quality.accepted(docs, scorer)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scored.where("accepted").collect()}


def test_odd_rows(spark):
    rng = random.Random(8)
    sound = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(3000)]
    good = "This is a plain sentence, as people write it, with words that differ and an end to it. "
    rows = [(i, good + f"Number {i}.", 0) for i in range(200)]
    rows += [(300, None, 1), (301, "", 1), (302, " \n", 1), (None, good, 1), (5, rows[5][1], 0), (303, ". ".join(" ".join(rng.sample(sound, 9)) for _ in range(300)), 1)]
    rows += [(400 + i, "WHAT!!! | *** | ### " * 30, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scorer = quality.fit(df)
    found = quality.score(df, scorer, keep=["doc_id"]).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    # A column named like a result gives way to it.
    assert quality.score(df, scorer).columns == ["doc_id", "text", "quality", "accepted"]
    assert all(by[k].quality == 0 for k in (300, 301, 302))
    assert not any(by[k].accepted for k in (300, 301, 302, 405))
    assert all(by[k].accepted for k in (None, 5, 17, 303))
    assert quality.accepted(df, scorer).count() == 203
    empty = df.limit(0)
    assert quality.score(empty, quality.fit(empty)).count() == 0
