"""Vector codes against a row-by-row model with all distances worked out."""

import hashlib
import math
import random

import numpy as np
import pytest

from castsieve.llm import vector_codes
from castsieve.llm.vector_codes import BLOCK_ROWS, Block, Codebooks, compress, with_label_error

SCHEMA = "vec_id long, embedding array<double>, label string, code int, id string, _label int"


def good(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain(rows, parts, entries, rounds, scale):
    """{(id, vector): (code, error)} and the codebooks, one distance after the other."""
    kept = sorted((r for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = []
    for _, vector, *_ in kept:
        q, w = [math.floor(scale * x) for x in vector], len(vector) // parts
        cut.append([q[p * w : (p + 1) * w] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min((distance(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, found in zip(cut, chosen) if found[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (vec_id, _, label, *_), c in zip(kept, cut):
        found = [nearest(c[p], p) for p in range(parts)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def made(seed, size, n=150):
    rng = random.Random(seed)
    number = lambda: rng.choice([rng.uniform(-1, 1), rng.uniform(-300, 300) if seed > 1 else 0.25, -0.5])
    rows = [(i * 7 % 1009, [number() for _ in range(size)], rng.choice(["a", "a", "b", None])) for i in range(n)]
    rows += [(2000, [0.5] * size, "hot")] * 60 + [(2000 + i, [0.5] * size, "hot") for i in range(40)]
    rows += [(None, [0.1] * size, "b"), (None, [-0.1] * size, None), (1, None, "a"), (2, [math.nan] * size, "a")]
    rows += [(3, [math.inf] + [0.0] * (size - 1), "a"), (4, [0.0] * (size - 1) + [None], "b"), rows[5]]
    return [(*r, 7, "x", 1) for r in rows]


by_text = lambda rows: sorted(map(str, rows))


@pytest.mark.parametrize("seed, parts, size, entries, rounds", [(1, 4, 8, 16, 4), (2, 2, 6, 256, 2), (3, 1, 3, 5, 0)])
def test_equals_all_distances(spark, seed, parts, size, entries, rounds):
    rows = made(seed, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    codes, books = compress(df, parts=parts, entries=entries, rounds=rounds)
    found = with_label_error(codes).collect()
    expected, plain_books = plain(rows, parts, entries, rounds, 1024)
    assert books.entries.tolist() == plain_books
    assert by_text((r.vec_id, r.label, r.code, r.error) for r in found) == by_text(expected)
    total = {label: sum(e for _, other, _, e in expected if other == label) for _, label, _, _ in expected}
    assert all(r.label_error == total[r.label] for r in found)
    assert books.decode(found[0].code) == [x for p, k in enumerate(bytes.fromhex(found[0].code)) for x in plain_books[p][k]]


def test_blocks_of_any_size_agree(spark, monkeypatch):
    df = spark.createDataFrame(made(1, 8), SCHEMA)
    whole, books = compress(df, entries=16)
    gathered, step = vector_codes._gathered, 37
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", step)
    parts = list(gathered(iter([b for b in _batches(100)])))
    assert [len(p[0]) for p in parts] == [37, 37, 26]
    monkeypatch.undo()
    again, same = compress(df.repartition(9), entries=16)
    assert same.entries.tolist() == books.entries.tolist() and same.sha256() == books.sha256()
    assert by_text(again.collect()) == by_text(whole.collect())


def _batches(n):
    import pyarrow as pa

    column = pa.array(range(n))
    return [pa.RecordBatch.from_arrays([column.slice(i, 9)] * 3, names=["a", "b", "c"]) for i in range(0, n, 9)]


def test_a_block_is_what_it_was_made_of():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(1 << 24), 1 << 24, (500, 6))
    rows[:200] = rows[0]
    block = Block.read(len(rows), *Block.of(rows).written())
    again = np.array([v[c] for v, c in zip(block.values, block.codes)]).T
    assert (again == rows).all() and len(block.values[0]) <= 301
    books = rng.integers(-(1 << 24), 1 << 24, (2, 9, 3))
    best, distance = block.nearest(books)
    all_distances = ((rows.reshape(-1, 2, 1, 3) - books) ** 2).sum(3)
    assert (best.T == all_distances.argmin(2)).all() and (distance.T == all_distances.min(2)).all()
    assert BLOCK_ROWS <= 1 << 16


def test_odd_tables(spark):
    df = spark.createDataFrame(made(1, 8), SCHEMA)
    for none in (df.limit(0), df.where("embedding is null")):
        codes, books = compress(none)
        assert with_label_error(codes).count() == 0 and books.entries.size == 0
        assert codes.dtypes == [("vec_id", "bigint"), ("label", "string"), ("code", "string"), ("error", "bigint")]
    empty = spark.createDataFrame([(1, [], 1), (2, [], 2)], "vec_id int, embedding array<float>, label int")
    assert [(r.code, r.error) for r in compress(empty)[0].collect()] == [("00000000", 0)] * 2
    for bad in ([(1, [1.0, 2.0], 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]):
        with pytest.raises(ValueError):
            compress(spark.createDataFrame(bad, "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ValueError):
        compress(df, entries=257)


def test_digest():
    assert Codebooks(np.array([[[1, -2]], [[3, 4]]])).sha256() == hashlib.sha256(b"1,-2,3,4").hexdigest()
