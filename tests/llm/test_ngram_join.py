"""Similar documents against comparison of all pairs."""

import random
import re

import pytest

from castsieve.llm.components import components
from castsieve.llm.ngram_join import similar_groups, without_similar

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(data)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def plain(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in members.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str), len(members)


def near_copies(seed):
    """Families of texts with a few words changed, a passage many share, short texts and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    texts = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([4, 12, 40, 90]))]
        if family % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own = own[: -rng.randint(1, 3)]
            text = rng.choice([" ", "\n", "  "]).join(own)
            texts.append(text.upper() if rng.random() < 0.2 else text)
    texts += ["a", "A", "a b", "A  B\n", "a b c", None, "", " \t", "É", "é", "x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=-5))
    return rows + [(3, rows[8][1]), (3, rows[8][1]), (None, rows[20][1]), (None, None)]


@pytest.mark.parametrize("seed, n, percent", [(1, 3, 90), (2, 5, 80), (4, 1, 70)])
def test_equals_all_pairs(spark, seed, n, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, sig string").repartition(3)
    found = similar_groups(df, n, percent).collect()
    expected, groups = plain(rows, n, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == expected
    assert sum(r.first for r in found) == groups
    assert any(r.component_id != r.doc_id for r in found if r.doc_id is not None)
    kept = without_similar(df, n, percent)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in found if r.first), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = similar_groups(docs, 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain(rows, 3, 90)[0]


def test_empty(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7), (2000, 1999), (1999, 2000)]
    random.Random(1).shuffle(links)
    found = components(spark.createDataFrame(links, "x long, y long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) == 301 + 200 + 2
    assert all(r == (0 if n < 500 else 1000 if n < 1500 else 1999) for n, r in roots.items())
