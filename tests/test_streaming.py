"""Deliveries to a watched folder: one batch or many, repeated batches, compressed and large files, equal content."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from castsieve.plans.clean import CleanOptions, clean_playlists
from castsieve.schema import RESPONSE
from castsieve.streaming.incremental import Memory, clean_delivery, start_cleaning
from castsieve.workspace import shared_folder

PLAIN = CleanOptions(skip_validation=True, merge=True)


def playlist(rng, size):
    lines = ["#EXTM3U"]
    for _ in range(size):
        n = rng.randrange(30)
        lines += [f"#EXTINF:-1,Name {rng.randrange(25)}", rng.choice([f"http://a.tv/{n}", f"HTTP://WWW.a.tv:80/{n}/"])]
    return "\n".join(lines) + "\n"


def put(folder, number, text):
    """Plain, compressed or with wide characters, in turn; times in the order of numbers."""
    path = os.path.join(folder, f"list{number:02d}.m3u" + (".gz" if number % 3 == 1 else ""))
    data = text.encode("utf-16" if number % 3 == 2 else "utf-8")
    with open(path, "wb") as file:
        file.write(gzip.compress(data) if number % 3 == 1 else data)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return path


def rows(df):
    return sorted((r.id, r.name, r.link) for r in df.select("id", "name", "link").collect())


@pytest.mark.parametrize("limit", [1 << 24, 40])
def test_one_batch_or_many(spark, tmp_path, limit):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    rng = random.Random(4)
    paths = [put(folder, i, playlist(rng, 6)) for i in range(7)]
    expected = rows(clean_playlists(spark, paths, PLAIN).channels)
    found = {}
    for n in (None, 1, 3):
        out, mark = (str(tmp_path / f"{name}{n}") for name in ("out", "mark"))
        start_cleaning(spark, folder, out, mark, PLAIN, files_per_batch=n, whole_file_bytes=limit).awaitTermination()
        table = spark.read.parquet(out)
        found[n] = rows(table)
        assert table.select("batch").distinct().count() > 1 or n is None
    assert found[None] == found[1] == found[3] == expected and len(expected) > 5


def test_compressed_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    put(folder, 1, "#EXTINF:-1,One\nhttp://a.tv/1\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    start_cleaning(spark, folder, out, mark).awaitTermination()
    assert [r.name for r in spark.read.parquet(out).collect()] == ["One"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    rng = random.Random(5)
    paths = ["file:" + put(folder, i, playlist(rng, 8)) for i in range(4)]
    memory = f"{shared_folder(spark)}/memory"

    def run(batch, files):
        return rows(clean_delivery(spark, files, Memory(spark, memory, batch), PLAIN))

    def remembered():
        return {t: sorted(map(str, Memory(spark, memory, 9).before(t).collect())) for t in ("links", "kept")}

    first, second = run(0, paths[:2]), run(1, paths[2:])
    known = remembered()
    assert run(1, paths[2:]) == second and remembered() == known
    assert run(0, paths[:2]) == first and remembered() == known
    assert known["links"] and known["kept"]
    assert not {link for _, _, link in first} & {link for _, _, link in second}


def test_equal_content_is_found_across_deliveries(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    answers = spark.createDataFrame(
        [(f"http://a.tv/{i}", 0, 200, None, bytearray(b"ab"[i % 2 : i % 2 + 1] * 300)) for i in range(6)], RESPONSE
    )
    options = CleanOptions(content_duplicates=True, skip_validation=True)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for number in range(3):
        entries = "".join(f"#EXTINF:-1,n{i}\nhttp://a.tv/{i}\n" for i in (2 * number, 2 * number + 1))
        put(folder, number, entries)
        start_cleaning(spark, folder, out, mark, options, responses=lambda: answers).awaitTermination()
    flags = {r.name: r.extra_attributes.get("duplicate-of") for r in spark.read.parquet(out).collect()}
    assert flags == {"n0": None, "n1": None, "n2": "n0", "n3": "n1", "n4": "n0", "n5": "n1"}


def test_memory_is_short(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    put(folder, 0, "#EXTINF:-1," + "long " * 2000 + "\nhttp://a.tv/" + "x" * 5000 + "\n")
    mark = str(tmp_path / "mark")
    start_cleaning(spark, folder, str(tmp_path / "out"), mark).awaitTermination()
    kept = spark.read.parquet(f"{mark}/remembered/kept")
    assert [tuple(r) for r in kept.select(F.length("link_key"), F.length("name_key")).collect()] == [(16, 16)]
