"""Scores by counts against a plain count; the recurrent model against one step after the other."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from castsieve.llm import language_model
from castsieve.llm.gated_model import CLASS_SIZE, GatedModel, Lanes
from castsieve.llm.language_model import fit, held_out, score

SCHEMA = "doc_id long, text string, score int, _row long, _kept string"


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    counts = Counter(t for doc_id, text in rows if not is_held_out(doc_id) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((doc_id, is_held_out(doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    return out


def scored(df):
    return score(df, fit(df.where(~held_out())), keep=["doc_id", held_out().alias("held_out"), "text"])


def counted(rows):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]


def made():
    words = [f"w{int(k)}" for k in np.random.default_rng(3).zipf(1.4, 6000) % 900]
    texts = [" ".join(words[i * 37 : i * 37 + i % 60]) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "W1 w2\x0bw3"), (None, None), (300, None), (301, ""), (302, " \t\n")]
    rows += [(303, "x y İ É"), (304, "only-here " * 30), (304, "only-here " * 30), (305, "w1 " * 30000)]
    return rows


@pytest.mark.parametrize("listed", [1 << 16, 20, 0])
def test_counts_are_exact(spark, monkeypatch, listed):
    monkeypatch.setattr(language_model, "LISTED", listed)
    monkeypatch.setattr(language_model, "CHUNK_WORDS", 500)
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    found = scored(df).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    assert sorted(counted(found), key=key) == sorted(plain(rows), key=key)
    assert all(r.score < 0 for r in found)
    # Equal texts, equal scores.
    same = [r.score for r in found if r.doc_id == 304]
    assert abs(same[0] - same[1]) < 1e-3


def test_probabilities_add_up(spark):
    """One word and its end, over all words and one unseen, for the model as it came out."""
    df = spark.createDataFrame([(i, f"a b{i % 5} c{i % 3} a") for i in range(90)], "doc_id long, text string")
    fitted = fit(df.where(~held_out()))
    vocabulary = [*("a b0 b1 b2 b3 b4 c0 c1 c2".split()), "unseen", ""]
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(vocabulary)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in score(asked, fitted).collect()}
    end_after = []
    h0 = np.zeros((1, fitted.model.state), np.float32)
    for word in vocabulary:
        keys, _ = language_model._hashed([word])
        ids = [*fitted.vocabulary.find(keys)[0].tolist(), 1]
        total, h, before = 0.0, h0, 1
        for k in ids:
            h = fitted.model._states(np.array([[before]]), np.zeros((1, 1), bool), h)[0][-1]
            total, last, before = total + float(fitted.model.log_probabilities(h, np.array([k]))[0]), total, k
        end_after.append((last, total))
    first = [10 ** s / math.exp(t - l) for s, (l, t) in zip((found[i] for i in range(len(vocabulary))), end_after)]
    # The last asked text has no word: its only token is the end.
    first[-1] = 10 ** found[len(vocabulary) - 1]
    assert sum(first) == pytest.approx(1, abs=2e-2)


def test_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = scored(docs).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100
    per_token = lambda c: sum(getattr(r, c) for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score")


def test_every_text_is_learned_from_once(spark, monkeypatch):
    taken = []

    def round_of(texts, model, vocabulary):
        taken.extend(r[0] for r in texts.collect())
        return model

    monkeypatch.setattr(language_model, "_round", round_of)
    texts = [f"a b{i}" for i in range(400)]
    fit(spark.createDataFrame(list(enumerate([*texts, None, "a b7"])), "doc_id long, text string"))
    assert sorted(taken, key=str) == sorted([*texts, None, "a b7"], key=str)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    fitted = fit(empty)
    assert score(empty, fitted).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, 2, "x"), (2, None, 5, 2, "x")], SCHEMA)
    found = sorted(score(df, fitted).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score(df, fitted).columns == ["doc_id", "text", "_row", "_kept", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def one_by_one(model, text):
    """The score of a text, one word after the other, in plain steps."""
    s, total, h, before = model.state, 0.0, np.zeros(model.state), model.last
    for word in text.tolist():
        x, a = model.gates[before].astype(float), h @ model.turn.astype(float)
        z, r = (1 / (1 + np.exp(-(x + a)[k * s : (k + 1) * s] if k < 2 else 0)) for k in (0, 1))
        new = np.tanh(x[2 * s :] + r * a[2 * s :])
        h = z * h + (1 - z) * new
        for logits, at in (
            (h @ model.to_class + model.class_bias, word // CLASS_SIZE),
            (h @ model.to_word[word // CLASS_SIZE] + model.word_bias[word // CLASS_SIZE], word % CLASS_SIZE),
        ):
            total += logits[at] - np.log(np.exp(logits).sum())
        before = word
    return total


@pytest.mark.parametrize("lanes, window", [(1, 1), (3, 7), (256, 64)])
def test_state_goes_through_the_whole_text(lanes, window):
    rng = np.random.default_rng(4)
    model = GatedModel(200, rng.integers(1, 50, 200), 1, 8)
    model = model.with_weights(rng.standard_normal(len(model.weights)) * 0.5)
    texts = [rng.integers(0, 200, n).astype(np.int32) for n in (1, 150, 3, 40, 40, 2, 75)]
    expected = [one_by_one(model, t) for t in texts]
    assert model.score(texts, lanes, window) == pytest.approx(expected, rel=1e-4)
    assert model.score([], lanes, window).shape == (0,)


def test_gradients(monkeypatch):
    """The step of a window against differences of its loss."""
    from castsieve.llm import gated_model

    monkeypatch.setattr(gated_model, "LANES", 1)
    monkeypatch.setattr(gated_model, "WINDOW", 1)
    rng = np.random.default_rng(5)
    model = GatedModel(130, rng.integers(1, 50, 130), 1, 5)
    model = model.with_weights(rng.standard_normal(len(model.weights)) * 0.5)
    text = rng.integers(0, 130, 9).astype(np.int32)
    side = Lanes([text], 1)
    ((some, n, before, words),) = side.windows(16, 1)
    moved = model.with_weights(model.weights)
    gradient = np.zeros(len(model.weights))
    # Adagrad with huge sums makes plain small steps: weight -= rate * gradient / root.
    squares = np.full(len(model.weights), 1e6, np.float32)
    sums = {k: p.reshape(s) for (k, s), p in zip(model.shapes.items(), np.split(squares, model.ends[:-1]))}
    moved._step(before, words, side.first, np.ones((9, 1), bool), np.zeros((1, 5), np.float32), sums, 1e3)
    gradient = model.weights.astype(float) - moved.weights
    checked = np.flatnonzero(np.abs(gradient) > 0.05)
    assert len(checked) > 100
    for k in rng.choice(checked, 60, replace=False):
        sides = []
        for d in (1e-2, -1e-2):
            other = model.with_weights(model.weights)
            other.weights[k] += d
            sides.append(-one_by_one(other, text))
        assert gradient[k] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.05, abs=0.02)


def test_lanes():
    texts = [np.full(n, n) for n in (5, 1, 9, 2, 2)]
    side = Lanes(texts, 2)
    assert sorted(side.loads.tolist(), reverse=True) == side.loads.tolist() and side.loads.sum() == 19
    for text, (lane, start, end) in zip(texts, side.place):
        assert (side.words[start:end, lane] == text).all() and side.first[start, lane]
    assert side.first.sum() == 5


def test_words_of_many_blocks(monkeypatch):
    """Blocks of a few words, most of them without words of some class."""
    from castsieve.llm import gated_model

    monkeypatch.setattr(gated_model, "LANES", 2)
    monkeypatch.setattr(gated_model, "WINDOW", 3)
    rng = np.random.default_rng(6)
    model = GatedModel(400, rng.integers(1, 50, 400), 1, 8)
    model = model.with_weights(rng.standard_normal(len(model.weights)) * 0.5)
    texts = [rng.integers(0, 400, n).astype(np.int32) for n in (31, 1, 6, 7)]
    assert model.score(texts, 3, 7) == pytest.approx([one_by_one(model, t) for t in texts], rel=1e-4)
    # A class without words is left as it is.
    trained = model.with_weights(model.weights)
    trained.train([np.full(20, 70, np.int32)], trained.squares())
    assert (trained.to_word[[0, 2, 3]] == model.to_word[[0, 2, 3]]).all()
    assert not (trained.to_word[1] == model.to_word[1]).all()
