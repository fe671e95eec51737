"""Repeated lines against comparison of every line with all earlier ones."""

import random

import pytest

from castsieve.llm.line_dedup import repeated_lines, without_repeated_lines


def line_set(line):
    for c in "\t\r\f\v":
        line = line.replace(c, " ")
    return frozenset(w for w in line.lower().split(" ") if w)


def plain(rows, percent=80, least=1):
    """(id, number of lines, removed) per row; rows in order of id."""
    seen, out = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        removed, lines = [], (text or "").split("\n")
        for k, line in enumerate(lines):
            own = line_set(line)
            if len(own) < max(1, least):
                continue
            if any(100 * len(own & other) >= percent * len(own | other) for other in seen):
                removed.append(k)
            seen.append(own)
        out.append((doc_id, len(lines), removed))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéü") for _ in range(rng.randint(1, 3)))
    families = [[word() for _ in range(rng.choice([2, 3, 5, 12, 30]))] for _ in range(25)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(families)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 20))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = word()
            if rng.random() < 0.3:
                rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((doc * 3 % 61, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " \t"), (104, rows[4][1]), (105, "x " * 2000 + "\n" + "y z w " * 500)]
    return rows


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 60)])
def test_equals_all_comparisons(spark, seed, percent):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, k int, line string").repartition(3)
    found = sorted((r.doc_id, r.n_lines, r.removed) for r in repeated_lines(df, percent=percent).collect())
    expected = plain(rows, percent)
    assert found == sorted(expected)
    assert any(r[2] for r in expected)
    if seed > 1:
        return
    # The texts without these lines.
    texts = dict(rows)
    left = {}
    for doc_id, _, removed in expected:
        text = texts[doc_id]
        if removed:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in removed)
            if not text.strip():
                continue
        left[doc_id] = text
    kept = without_repeated_lines(df).collect()
    assert {r.doc_id: r.text for r in kept} == left
    assert without_repeated_lines(df).schema == df.schema


def test_repeated_rows_and_empty_tables(spark):
    text = "one two three four\nfive six seven"
    rows = [(1, text), (1, text), (None, text), (1, "five six seven\nnew words are here"), (2, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in without_repeated_lines(df).collect()), key=str)
    assert kept == sorted([(None, text), (1, "new words are here"), (2, "a b")], key=str)
    removed = sorted(len(r.removed) for r in repeated_lines(df).collect())
    assert removed == [0, 0, 1, 1, 2, 2]
    # A floor is an option.
    removed = sorted(len(r.removed) for r in repeated_lines(df, least=3).collect())
    assert removed == [0, 0, 0, 1, 2, 2]
    assert repeated_lines(df.limit(0)).count() == 0
    assert without_repeated_lines(df.limit(0)).count() == 0


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    plan = repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pairs_with_a_settled_later_line_are_not_joined(spark, monkeypatch):
    from castsieve.llm import line_dedup

    sharing, seen = line_dedup._sharing, []

    def watched(classes, settled, percent):
        pairs = sharing(classes, settled, percent)
        places = {r.c: tuple(r.place) for r in classes.collect()}
        gone = {r.c for r in settled.collect()}
        seen.extend((*sorted((places[r.x], places[r.y])), *(c in gone for c in sorted((r.x, r.y), key=places.get))) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(line_dedup, "_sharing", watched)
    rows = [r for r in made(7) if r[0] < 60]
    repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count()
    # With few ids most stretches hold one; documents two apart are never in the same.
    apart = [(gone_a, gone_b) for a, b, gone_a, gone_b in seen if b[0] - a[0] > 1]
    assert len(apart) > 20 and any(a for a, _ in apart)
    assert not any(b for _, b in apart)
