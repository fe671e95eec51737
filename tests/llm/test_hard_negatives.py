"""Hard negatives against comparison of every anchor with every row; cover trees against all products."""

import math
import random

import numpy as np
import pytest

from castsieve.llm import hard_negatives as module
from castsieve.llm.cover_tree import LEAF_ROWS, CoverTree
from castsieve.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label string, tree int, row string, q int"


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector], label))
    order = lambda found: sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))
    out = []
    for i, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        score = lambda v: sum(a * b for a, b in zip(q, v))
        same = [(r, score(v)) for k, (r, v, other) in enumerate(kept) if other == label and k != i]
        others = [(r, score(v)) for r, v, other in kept if other != label]
        for positive, p in order(same)[:positives]:
            within = [f for f in others if low * p <= 100 * f[1] <= high * p]
            for rank, (negative, n) in enumerate(order(within)[:negatives], 1):
                out.append((anchor, positive, rank, negative, p, n))
    return out


def made(seed, n=600, size=6):
    rng = random.Random(seed)
    point = lambda: [rng.gauss(0, 0.3) for _ in range(size)]
    centres = [point() for _ in range(12)]
    near = lambda c: [x + rng.gauss(0, 0.02) for x in c]
    rows = [(i, near(rng.choice(centres)) if rng.random() < 0.6 else point(), rng.choice("abc")) for i in range(n)]
    rows += [(n + i, centres[0], "b" if i % 3 else "a") for i in range(200)]
    rows += [(5000, None, "a"), (5050, [math.nan] * size, "a"), (5100, centres[1], None), (5150, [0.0] * size, "a")]
    rows += [(None, centres[2], "c"), (None, centres[0], "a"), rows[0], rows[0], (rows[50][0], centres[3], "c")]
    rows += [(6000, [None] + [0.0] * (size - 1), "c"), (6050, centres[4], "only"), (-50, centres[5], "b")]
    return [(*r, 1, "x", 2) for r in rows]


by_text = lambda rows: sorted(map(str, rows))
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("seed, tree_rows, turn_rows, sample", [(1, 2048, 4096, 2048), (2, 64, 5, 30), (3, 150, 4096, 600)])
def test_equals_all_comparisons(spark, monkeypatch, seed, tree_rows, turn_rows, sample):
    for name, value in (("TREE_ROWS", tree_rows), ("TURN_ROWS", turn_rows), ("SAMPLE", sample)):
        monkeypatch.setattr(module, name, value)
    rows = made(seed)
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert by_text(tuple(r[c] for c in NAMES) for r in found.collect()) == by_text(plain(rows))
    wide = hard_negatives(spark.createDataFrame(rows, SCHEMA), every=7, positives=2, negatives=9, low=-100, high=100)
    assert by_text(tuple(r[c] for c in NAMES) for r in wide.collect()) == by_text(plain(rows, 7, 2, 9, -100, 100))


def test_odd_tables(spark):
    df = spark.createDataFrame(made(1), SCHEMA)
    empty = hard_negatives(df.limit(0))
    assert empty.count() == 0 and set(empty.columns) == set(NAMES)
    assert hard_negatives(df.where("label is null")).count() == 0
    assert hard_negatives(df.where("vec_id % 50 <> 0")).count() == 0
    one = spark.createDataFrame([(50, [1.0], "a")], "vec_id int, embedding array<float>, label string")
    assert hard_negatives(one).count() == 0
    for bad in ([[1.0], [1.0, 2.0]], [[1e9], [1.0]]):
        with pytest.raises(Exception, match="one length"):
            hard_negatives(spark.createDataFrame([(i, v, "a") for i, v in enumerate(bad)], "vec_id int, embedding array<double>, label string"))


@pytest.mark.parametrize("seed", range(4))
def test_tree_search(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 9))
    centres = rng.integers(-300, 300, (6, size))
    rows = np.concatenate([centres[rng.integers(0, 6, 400)] + rng.integers(-4, 5, (400, size)), rng.integers(-300, 300, (200, size)), np.repeat(centres, 40, 0)])
    labels = rng.integers(0, 4, len(rows))
    tree = CoverTree.read(CoverTree.build(rows).written())
    nodes, order = tree.nodes, tree.nodes["order"]
    # Every row is below exactly one leaf; radii cover; a centre is its first child's centre.
    assert sorted(order) == list(range(len(rows)))
    leaves = np.flatnonzero(nodes["leaf"])
    assert (nodes["end"] - nodes["start"])[leaves].max() <= LEAF_ROWS
    unit = np.hstack([rows, np.sqrt(tree.longest - (rows**2).sum(1))[:, None]])
    for leaf in leaves:
        below, node = order[nodes["start"][leaf] : nodes["end"][leaf]], leaf
        while node >= 0:
            assert (np.linalg.norm(unit[below] - unit[nodes["centre"][node]], axis=1) <= nodes["radius"][node] + 1e-6).all()
            node = nodes["parent"][node]
    queries = np.concatenate([rows[::9], rng.integers(-300, 300, (9, size))])
    own = np.concatenate([labels[::9], np.full(9, 2)])
    self_row = np.concatenate([np.arange(0, len(rows), 9), np.full(9, -1)])
    products = queries @ rows.T
    low = np.stack([np.full(len(queries), -np.inf), products.max(1) // 2, np.full(len(queries), 5)], 1)
    high = np.stack([np.full(len(queries), np.inf), products.max(1) * 95 // 100, np.full(len(queries), 4)], 1)
    for same in (True, False):
        found, score = tree.search(queries, low, high, labels, own, same, self_row, 4)
        for i in range(len(queries)):
            for w in range(3):
                good = [r for r in range(len(rows)) if (labels[r] == own[i]) == same and r != self_row[i] and low[i, w] <= products[i, r] <= high[i, w]]
                good = sorted(good, key=lambda r: (-products[i, r], r))[:4]
                assert found[i, w].tolist() == good + [-1] * (4 - len(good))
                assert score[i, w, : len(good)].tolist() == products[i, good].tolist()


def test_few_nodes_are_opened(monkeypatch):
    """Near copies far from the query are skipped with their ball."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    rows = np.repeat(centres, 40, 0) + rng.normal(size=(1600, 16))
    tree = CoverTree.build(rows.astype(np.int64))
    opened = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: opened.append(len(a[1])) or einsum(*a))
    queries = rows[::40].astype(np.int64)
    everything = np.full((len(queries), 1), np.inf)
    zeros = np.zeros(len(rows), np.int64)
    tree.search(queries, -everything, everything, zeros, zeros[: len(queries)], True, np.full(len(queries), -1), 5)
    assert 0 < sum(opened) <= 4 * len(queries)
