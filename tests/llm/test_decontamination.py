"""Benchmark passages against a plain search."""

import hashlib
import random
import re

from castsieve.llm import decontamination
from castsieve.llm.decontamination import find_passages, without_passages

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ours(df):
    rows = df.selectExpr("doc_id", "n_words", "n_hit", "size(items) as n", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def made(seed, n_docs=300, n_items=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "É", "zu", "Über", "x1", "42", "And", "no"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 14, 40]))) for i in range(n_items)]
    items += [(n_items, None), (n_items + 1, items[5][1]), (n_items + 2, "...")]
    docs = [(i, text(rng.choice([0, 1, 5, 10, 30, 400]))) for i in range(n_docs)]
    docs += [(n_docs + i, text(20) + items[i % n_items][1].upper() + text(9)) for i in range(60)]
    docs += [(7, None), (7, ""), (7, docs[-1][1]), (7, docs[-1][1]), (None, docs[-1][1]), (9000, text(5_000) + items[7][1])]
    return docs, items


def test_equals_plain_search(spark):
    docs, items = made(1)
    # Long items only, so that not every text is covered by a short one.
    for chosen in (items, [i for i in items if len(split(i[1])) >= 10], []):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        i = spark.createDataFrame(chosen, "item_id long, text string")
        assert ours(find_passages(d, i)) == plain(docs, chosen)


def test_many_patterns_are_searched_in_turns(spark, monkeypatch):
    docs, items = made(2)
    items = [i for i in items if len(split(i[1])) >= 9]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PATTERN_BYTES", 200)
    assert ours(find_passages(d, i)) == plain(docs, items)
    kept = sorted((r.doc_id for r in without_passages(d, i).collect()), key=str)
    assert kept == sorted((r[0] for r in plain(docs, items) if not r[5]), key=str)


def test_clashing_columns_and_empty_tables(spark):
    d = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten", 5, "x")],
        "doc_id long, text string, item_id long, _text string",
    )
    i = spark.createDataFrame([(3, "One two three four five six seven eight nine ten!", 1)], "item_id long, text string, doc_id long")
    row = find_passages(d, i).first()
    assert (row.n_hit, row["items"], row.spans) == (10, ["3"], [(0, 10)])
    assert without_passages(d, i).count() == 0
    assert without_passages(d, i.limit(0)).collect() == d.collect()
    assert find_passages(d.limit(0), i).count() == 0


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ours(find_passages(docs, items)) == expected
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)
