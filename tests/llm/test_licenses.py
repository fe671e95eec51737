"""Licences: variants of known texts match, others do not; both plans; comparison SQL."""

import re
import textwrap

import pytest
from oracle_check import connect, difference

from castsieve.llm import licenses, queries
from castsieve.llm.license_texts import TEXTS


def variants():
    mit = TEXTS["MIT"]
    lines = mit.split("\n")
    return [
        (1, mit, "MIT"),
        (2, "Copyright (c) 2024 A. Person\n(c) B\n© C 2020\nAll rights reserved.\n\n" + mit.upper() + "\n", "MIT"),
        (3, "\n".join("  * " + line.replace(",", " , ").replace('"', "``") for line in lines), "MIT"),
        (4, mit.replace("sublicense", "sub-licence"), "MIT"),
        (5, mit + "\nAnd more.", None),
        (6, mit.replace("free of charge", "for a charge"), None),
        (7, TEXTS["ISC"], "ISC"),
        (8, "Some text.\nReleased under the MIT Licence\nMore text.", None),
        (9, "it was released under the MIT License. As said", None),
        (10, "licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        (11, None, None),
        (12, "", None),
        (13, " \n--\n", None),
        (1, mit, "MIT"),
        (None, "x " * 20_000 + "\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", None),
    ]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_variants(spark, threshold):
    """The same by broadcast and by shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_variants(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_variants(spark):
    rows = variants()
    df = spark.createDataFrame([(a, b, "c", [1]) for a, b, _ in rows], "doc_id long, text string, digest string, notices array<int>")
    found = licenses.scan(df).collect()
    assert sorted(((r.doc_id, r.license_id) for r in found), key=str) == sorted(((a, c) for a, _, c in rows), key=str)
    by = {r.doc_id: r for r in found}
    assert by[8].notices == ["MIT"] and by[9].notices == [] and by[10].notices == ["CC-BY-NC-4.0"]
    assert by[None].notices == ["CC-BY-NC-4.0", "MIT"]
    assert by[11].digest == by[12].digest == by[13].digest != by[9].digest
    assert by[1].digest == by[2].digest == by[3].digest == by[4].digest
    assert licenses.scan(df.limit(0)).count() == 0


def wrapped(text, width):
    """All paragraphs wrapped anew; a paragraph is what lies between blank lines."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n[ \t]*\n", text))


def found_licences(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license_id for r in licenses.scan(df.repartition(8)).sort("doc_id").collect()]


def test_known_texts(spark):
    """Every known text at every width, with a title and a copyright paragraph before it."""
    assert len(TEXTS) >= 15
    asked = [(name, wrapped(text, width)) for name, text in TEXTS.items() for width in (*range(40, 121, 8), 73, 10_000)]
    asked += [(name, "Copyright (c) 2024 A. Person and others\n\n" + text) for name, text in TEXTS.items()]
    found = found_licences(spark, [text for _, text in asked])
    wrong = [(name, text[:60], max(map(len, text.split("\n")))) for (name, text), f in zip(asked, found) if name != f]
    assert not wrong


def test_titles_and_marks(spark):
    bsd = TEXTS["BSD-2-Clause"]
    asked = {
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + TEXTS["MIT"]: "MIT",
        "The MIT License (MIT)\nCopyright © 2020-2021, Some One <a@b.c>\nCopyright Another Corp.\n" + TEXTS["MIT"]: "MIT",
        "ISC License\n\nCopyright 2020 X\n\n" + wrapped(TEXTS["ISC"], 40): "ISC",
        "BSD 2-Clause License\n\nCopyright (c) 2013, D. T.\nAll rights reserved.\n\n" + bsd: "BSD-2-Clause",
        re.sub(r"(?m)^\d\. ", "* ", bsd): "BSD-2-Clause",
        re.sub(r"(?m)^(\d)\. ", r"\1) ", bsd): "BSD-2-Clause",
        re.sub(r"(?m)^(\d)\. ", r"  (\1) ", bsd): "BSD-2-Clause",
        "MIT License": None,
        "MIT License\n\n" + TEXTS["ISC"].replace("granted", "refused"): None,
    }
    assert found_licences(spark, list(asked)) == list(asked.values())


def test_sentences_about_copyright_stay(spark):
    texts = [
        "(c) you may copy\nand the rest",
        "(c) you may never copy\nand the rest",
        "COPYRIGHT HOLDERS BE LIABLE\nand the rest",
        "and the rest",
        "Copyright notice and\nand the rest",
        "Copyright (c) 2020 A\nand the rest",
        "copyright 1999-2020 by a, b and c. all rights reserved.\nand the rest",
        "Copyright 2020 A. You may do all that is said in the following long sentence, with its many words, of which there are more than a name has\nand the rest",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digests = [r.digest for r in licenses.scan(df).sort("doc_id").collect()]
    assert digests[3] == digests[5] == digests[6]
    assert len(set(digests)) == 6


def test_long_texts(spark):
    """Runs that patterns could search for ever or too deep, on both sides of a known notice."""
    notice = "\nReleased under the MIT License.\n"
    runs = [" ", ". ", "* ", "a) ", "(1) ", "Copyright ", "(c) ", "© ", "-", "\n", " \n", "A ", "_ ", "and ", ".\t"]
    texts = [run * 30_000 + notice + run * 30_000 for run in runs] + ["Copyright " + "A " * 30_000 + notice]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.notices for r in licenses.scan(df).collect()} == {k: ["MIT"] for k in range(len(texts))}


def test_own_licences(spark):
    known = licenses.known_licenses(spark, {"House-1": ["Use it   as you like!"], "House-2": ["", "© nobody"]})
    df = spark.createDataFrame([(1, "USE IT AS YOU LIKE"), (2, "© nobody")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(df, known).collect()} == {1: "House-1", 2: None}


def test_equals_comparison(spark):
    sf = "/root/testdata/sf0.001"
    name = "op1_license_scans"
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE[name], connect(sf)) is None
