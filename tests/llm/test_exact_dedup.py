"""Equal texts against a plain grouping; the plan of the merge."""

import hashlib
import random

import pytest

from castsieve.llm import exact_dedup
from castsieve.llm.exact_dedup import exact_duplicates, without_duplicates

SCHEMA = "doc_id long, text string, _sha string, _run string, kept int, keep_id string"


def made(seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "a", "A", "é", "é", "x" * 200_000, "line\nline", "0", "\x00"] + [f"text {k}" for k in range(40)]
    rows = [(i * 7 % 1009, rng.choice(texts)) for i in range(300)]
    # A third of all rows have one text.
    rows += [(2000 + i, "hot") for i in range(200)]
    return rows + [(None, "hot"), (None, "alone"), (None, None), (5000, "twice"), (5000, "twice"), rows[3]]


def plain(rows, keep):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    best = min if keep == "smallest" else max
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        stays = best((d for d in own if d is not None), default=None)
        out.append((doc_id, stays, len(own), doc_id is not None and doc_id == stays, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions, fan_in", [(1, 16), (9, 2), (40, 4)])
def test_equals_plain_grouping(spark, monkeypatch, keep, partitions, fan_in):
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    rows = made(partitions)
    df = spark.createDataFrame([(*r, "s", "r", 1, "k") for r in rows], SCHEMA).repartition(partitions)
    found = exact_duplicates(df, keep=keep)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(rows, keep)


def test_rows_that_stay(spark):
    rows = [(i, f"t{i % 7}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, text string, keep_id int")
    kept = without_duplicates(df, keep="largest")
    assert kept.schema == df.schema
    assert sorted(tuple(r) for r in kept.collect()) == rows[43:]
    with pytest.raises(ValueError):
        exact_duplicates(df, keep="any")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert exact_duplicates(empty).count() == 0 and without_duplicates(empty).count() == 0


def test_a_sort_feeds_the_merge(spark):
    runs = spark.createDataFrame([], "_run int, _sha binary, _size long, _hash long, _id long, _n long")
    plan = exact_dedup._merge(runs, 300, runs["_id"].asc_nulls_last())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [_node") == 3 and "Aggregate" not in plan
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
