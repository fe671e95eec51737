"""Keyword tables of any size against a plain search of every keyword in every text."""

import random

import pytest
from pyspark.sql import functions as F

from castsieve.functions.enrich import with_category
from castsieve.functions.fixed_values import CATEGORY_KEYWORDS
from castsieve.operators.enrichment import categorize_by_table

KEYWORDS = "category string, rank int, keyword string"


def plain(row, keywords):
    texts = [row.get(c) or "" for c in ("name", "tvg_name", "group_name")]
    for text in (texts[2].upper(), " ".join(texts).upper()):
        found = [(rank, category) for category, rank, keyword in keywords if keyword and keyword.strip() and keyword.strip().upper() in text]
        if found:
            return min(found)[1]
    return "Unknown"


def test_equals_plain_search(spark, channels):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    rows = [{"name": f"{word()} {word()}", "tvg_name": rng.choice([None, word()]), "group_name": rng.choice(["", word(), "Hot Group"])} for _ in range(400)]
    keywords = [(f"c{rng.randrange(9)}", rng.randrange(300), word()) for _ in range(500)]
    keywords += [("x", 0, None), ("x", 0, ""), ("x", 0, "  "), ("y", 5, "hot g"), ("z", 5, "hot g"), ("w", 9, "not there at all")]
    df = channels(rows)
    found = categorize_by_table(df, spark.createDataFrame(keywords, KEYWORDS).repartition(3))
    assert found.dtypes == df.dtypes
    assert {r.id: r.category for r in found.collect()} == {i: plain(r, keywords) for i, r in enumerate(rows)}


def test_equals_the_fixed_table(spark, channels):
    rows = channels([{"name": n, "group_name": g} for n in ("Sports 1", "CNN news", "Kids", "x", "") for g in ("", "Movie Zone", "MUSIC")])
    keywords = [(c, i, k) for i, (c, ks) in enumerate(CATEGORY_KEYWORDS.items()) for k in ks]
    by_table = categorize_by_table(rows, spark.createDataFrame(keywords, KEYWORDS))
    assert sorted(by_table.select("id", "category").collect()) == sorted(with_category(rows).select("id", "category").collect())


def test_whole_words_and_no_keywords(spark, channels):
    rows = channels([{"name": n} for n in ("art.", "party", "a+b\\E c", "a+bc")])
    keywords = spark.createDataFrame([("A", 1, "art"), ("B", 2, "a+b\\E")], KEYWORDS)
    found = categorize_by_table(rows, keywords, whole_words=True).orderBy("id")
    assert [r.category for r in found.collect()] == ["A", "Unknown", "B", "Unknown"]
    none = categorize_by_table(rows, keywords.limit(0))
    assert {r.category for r in none.collect()} == {"Unknown"}
    assert categorize_by_table(rows.limit(0), keywords).count() == 0


def test_a_hundred_thousand_keywords(spark, channels):
    rows = channels([{"name": f"Channel {i} of many"} for i in range(300)])
    many = spark.range(100_000).select(
        (F.col("id") % 50).cast("string").alias("category"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("nel "), F.col("id").cast("string"), F.lit(" of")).alias("keyword")
    )
    found = categorize_by_table(rows, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.category for r in found.collect()} == {i: str(i % 50) for i in range(300)}
