"""Rounds of the two-key rule on long dependencies, and folding of private-use characters."""

import random

import pandas as pd
import pytest

from castsieve.functions.text import fold
from castsieve.operators import dedupe


def sequential(rows):
    links, names, kept = set(), set(), []
    for i, link, name in rows:
        if link not in links and name not in names:
            kept.append(i)
            links.add(link)
            names.add(name)
    return kept


def chain(n):
    """Every row waits for the one before, and every link is listed a third time."""
    return [(i, f"L{i // 2}", f"N{(i + 1) // 2}") for i in range(n)] + [(n + k, f"L{k}", f"X{k}") for k in range(n // 2)]


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    plain = dedupe._mutual_first
    monkeypatch.setattr(dedupe, "_mutual_first", lambda rows: seen.append(1) or plain(rows))
    return seen


def test_chain_with_third_copies_takes_few_rounds(spark, rounds):
    rows = chain(600)
    df = spark.createDataFrame(rows, "id long, link_key string, name_key string")
    assert sorted(r.id for r in dedupe.kept_ids(df).collect()) == sequential(rows)
    assert len(rounds) <= 6


def test_thirds_and_ladders_equal_the_sequential_rule(spark):
    rng = random.Random(6)
    for n, keys in ((60, 12), (40, 25)):
        rows = [(i, f"L{rng.randrange(keys)}", f"N{rng.randrange(keys)}") for i in range(n)]
        df = spark.createDataFrame(rows, "id long, link_key string, name_key string")
        assert sorted(r.id for r in dedupe.kept_ids(df, plain_rounds=1).collect()) == sequential(rows)


def ladder(n):
    """Every row is second in both its keys: it waits for the row before and the one before that."""
    return [(i, f"L{(i + i % 2) // 2 if i % 4 < 2 else i // 2}", f"N{i // 3}") for i in range(n)]


def thirds(n):
    """Third and later rows of a key again and again."""
    return [(i, f"L{i // 3}", f"N{(i + 2) // 4}") for i in range(n)]


@pytest.mark.parametrize("shape", [chain, ladder, thirds])
def test_a_hundred_thousand_rows_take_few_rounds(spark, rounds, shape):
    rows = shape(100_000)
    frame = pd.DataFrame(rows, columns=["id", "link_key", "name_key"])
    df = spark.createDataFrame(frame).repartition(4)
    kept = dedupe.kept_ids(df).toPandas()["id"]
    assert sorted(kept.tolist()) == sequential(rows)
    assert len(rounds) <= dedupe.PLAIN_ROUNDS + 1


def test_rows_are_decided_a_prefix_at_a_time(spark, rounds, monkeypatch):
    """The bound: every further round decides the smallest open ids, whatever they wait for."""
    monkeypatch.setattr(dedupe, "PREFIX_ROWS", 300)
    monkeypatch.setattr(dedupe, "_kept_along_chains", lambda open_rows, free: open_rows.select("id").limit(0))
    rows = ladder(1000) + [(i, l + "x", n + "x") for i, l, n in thirds(600)]
    rows = [(i, l, n) for i, (_, l, n) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, link_key string, name_key string")
    assert sorted(r.id for r in dedupe.kept_ids(df, plain_rounds=1).collect()) == sequential(rows)
    assert len(rounds) <= 1 + -(-len(rows) // 300)


def test_private_use_characters_stay_apart(spark):
    values = ["\ue000ß", "ßß", "SS", "\ue000ab", "\ue000AB", "Abı", "aBı", "aBI"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    folds = [r[0] for r in df.select(fold(df.v)).collect()]
    assert folds[3] == folds[4] and folds[5] == folds[6]
    assert len(set(folds)) == 6
