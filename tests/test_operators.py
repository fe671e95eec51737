"""Operators against small sequential models, hot keys and long chains."""

import os
import random

import pytest
from pyspark.sql import functions as F

from castsieve.operators import dedupe, enrichment, filters, groups, ordering, parse, probe
from castsieve.operators import lookup as lookups
from castsieve.schema import RESPONSE


# --- parsing ----------------------------------------------------------------


def parse_sequentially(lines):
    """(link line number, name, group) per channel, by reading line after line."""
    found, i = [], 0
    while i < len(lines):
        if lines[i].strip().upper().startswith("#EXTINF"):
            group = None
            for j in range(i + 1, min(i + 5, len(lines))):
                text = lines[j].strip()
                if text.upper().startswith("#EXTGRP:"):
                    group = text[8:].strip()
                elif text.startswith("http://ok"):
                    found.append((j, lines[i].strip().split(",", 1)[1], group or ""))
                    i = j
                    break
        i += 1
    return found


def random_lines(rng, n):
    kinds = ["#EXTINF:-1,n{}", "#EXTINF:0,m{}", "http://ok.tv/{}", "", "# c", "#EXTGRP: g{}", "#EXTGRP:", "http://bad/x.png"]
    return [rng.choice(kinds).format(i) for i in range(n)]


def test_both_parsers_equal_the_sequential_rule(spark):
    rng = random.Random(7)
    files = {f"f{k:03}": random_lines(rng, rng.randrange(0, 60)) for k in range(150)}
    expected = [(f, *row) for f, lines in files.items() for row in parse_sequentially(lines)]
    lines = spark.createDataFrame(
        [(0, f, i, line) for f, ls in files.items() for i, line in enumerate(ls)],
        "src_ord int, file string, line_no long, line string",
    )
    texts = spark.createDataFrame(
        [(0, f, rng.choice(["\n", "\r\n", "\r"]).join(ls)) for f, ls in files.items()],
        "src_ord int, file string, text string",
    )
    # Blocks much shorter than files: every kind of block border occurs.
    for links in (parse.links_in_lines(lines, block_lines=7), parse.links_in_texts(texts)):
        got = parse.entries_of_links(links).select("file", "line_no", "name", "group_name").collect()
        assert sorted(tuple(r) for r in got) == sorted(expected)


@pytest.mark.parametrize(
    "text, names",
    [
        ("#EXTINF:-1,a\n\n\n\nhttp://ok.tv/1", ["a"]),
        ("#EXTINF:-1,a\n\n\n\n\nhttp://ok.tv/1", []),
        ("#EXTINF:-1,a\n#EXTINF:-1,b\nhttp://ok.tv/1", ["a"]),
        ("http://ok.tv/1\n#EXTINF:-1,a", []),
        ("#EXTINF:-1,a\nhttp://ok.tv/1\nhttp://ok.tv/2", ["a"]),
        ("", []),
    ],
)
def test_look_ahead(spark, text, names):
    texts = spark.createDataFrame([(0, "f", text)], "src_ord int, file string, text string")
    got = parse.entries_of_links(parse.links_in_texts(texts)).collect()
    assert [r.name for r in got] == names


def test_overrides_quotes_and_epg(spark):
    text = (
        '#EXTM3U url-tvg="head"\n#EXTINF:-1 group-title="X",a\n#EXTGRP:\nhttp://ok.tv/1"\n'
        '#EXTINF:-1 x-tvg-url="own" url-tvg="no",b\n#extgrp: G1\n#EXTGRP: G2 \nhttp://ok.tv/2\'"'
    )
    texts = spark.createDataFrame([(0, "f", text)], "src_ord int, file string, text string")
    got = parse.entries_of_links(parse.links_in_texts(texts)).orderBy("line_no").collect()
    assert [(r.group_name, r.link, r.epg_url, r.extra_attributes) for r in got] == [
        ("", "http://ok.tv/1", "head", {}),
        ("G2", "http://ok.tv/2", "own", {}),
    ]


def test_header_reaches_all_lines_of_a_file(spark):
    rows = [(0, "f", 0, '#EXTM3U x-tvg-url="e"')]
    for i in range(40):
        rows += [(0, "f", 2 * i + 1, f"#EXTINF:-1,n{i}"), (0, "f", 2 * i + 2, f"http://ok.tv/{i}")]
    rows += [(0, "g", 0, "#EXTM3U"), (0, "g", 1, "#EXTINF:-1,x"), (0, "g", 2, "http://ok.tv/x")]
    lines = spark.createDataFrame(rows, "src_ord int, file string, line_no long, line string")
    got = parse.entries_of_links(parse.links_in_lines(lines)).groupBy("file", "epg_url").count().collect()
    assert sorted(map(tuple, got)) == [("f", "e", 40), ("g", None, 1)]


# --- distinct ---------------------------------------------------------------


def keep_sequentially(rows):
    links, names, kept = set(), set(), []
    for i, (link, name) in enumerate(rows):
        if link in links or (name is not None and name in names):
            continue
        kept.append(i)
        links.add(link)
        if name is not None:
            names.add(name)
    return kept


def kept(spark, rows, plain_rounds=dedupe.PLAIN_ROUNDS):
    df = spark.createDataFrame(
        [(i, l, n) for i, (l, n) in enumerate(rows)], "id long, link_key string, name_key string"
    )
    return sorted(r.id for r in dedupe.kept_ids(df, plain_rounds).collect())


def test_dropped_row_frees_its_link(channels):
    rows = [{"link": "http://l/1", "name": "alpha one"}, {"link": "http://l/2", "name": "alpha one"},
            {"link": "http://l/2", "name": "beta two"}]
    assert sorted(r.id for r in dedupe.remove_duplicates(channels(rows)).collect()) == [0, 2]


def test_names_that_identify_nothing_never_clash(channels):
    rows = [{"link": f"http://l/{i}", "name": n} for i, n in enumerate(["news", "news", "abc", "abc"])]
    assert dedupe.remove_duplicates(channels(rows)).count() == 4


def test_two_key_rule_on_random_rows(spark):
    rng = random.Random(3)
    for size, keys, rounds in ((300, 60, 0), (300, 150, 3), (300, 25, 1)):
        rows = [
            (f"l{rng.randrange(keys)}", None if rng.random() < 0.2 else f"n{rng.randrange(keys)}")
            for _ in range(size)
        ]
        assert kept(spark, rows, rounds) == keep_sequentially(rows)


def test_long_chain_is_settled_in_few_rounds(spark, monkeypatch):
    # Every row shares its link with one neighbour and its name with the other.
    rows = [(f"l{(i + 1) // 2}", f"n{i // 2}") for i in range(400)]
    rounds = []
    plain = dedupe._mutual_first
    monkeypatch.setattr(dedupe, "_mutual_first", lambda df: rounds.append(1) or plain(df))
    assert kept(spark, rows, plain_rounds=1) == keep_sequentially(rows)
    assert len(rounds) <= 3


def test_hot_link_and_hot_name(spark):
    rng = random.Random(5)
    rows = [("hot", f"n{rng.randrange(200)}") for _ in range(400)]
    rows += [(f"l{rng.randrange(200)}", "hot") for _ in range(400)]
    rows += [(f"l{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(400)]
    rng.shuffle(rows)
    assert kept(spark, rows) == keep_sequentially(rows)


def test_removal_and_merge_are_idempotent(channels):
    rng = random.Random(11)
    df = channels(
        [{"link": f"http://a{rng.randrange(20)}.tv/x", "name": f"name {rng.randrange(30)}"} for _ in range(120)]
    )
    once = dedupe.remove_duplicates(df)
    assert sorted(dedupe.remove_duplicates(once).collect()) == sorted(once.collect())
    merged = dedupe.merge_channels(df)
    assert sorted(dedupe.merge_channels(merged).collect()) == sorted(merged.collect())
    assert sorted(r.id for r in merged.collect()) == list(range(merged.count()))


def test_distinct_groups(channels):
    df = channels([{"group_name": g} for g in ["b", "B", "", " ", "A", "a", "uncategorized"]])
    assert [r[0] for r in dedupe.distinct_groups(df).collect()] == ["A", "b", "Uncategorized"]


# --- order and groups -------------------------------------------------------


def test_renumber_is_dense_and_ordered(spark):
    df = spark.range(5000).select(F.col("id").alias("n"), (F.hash("id") % 7).alias("k"))
    got = ordering.renumber(df, F.asc("k"), F.asc("n")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5000))
    assert [(r.k, r.n) for r in got] == sorted((r.k, r.n) for r in got)
    assert ordering.renumber(df.where("false"), F.asc("n")).collect() == []


@pytest.mark.parametrize(
    "by, descending, order",
    [
        ("name", False, [3, 0, 1, 2]),
        ("name", True, [2, 0, 1, 3]),
        ("group", False, [1, 2, 0, 3]),
        ("group", True, [0, 3, 1, 2]),
        ("group-name", False, [1, 2, 3, 0]),
        ("group-name", True, [0, 3, 2, 1]),
    ],
)
def test_sorting_keeps_ties_in_order(channels, by, descending, order):
    rows = [("b", "y"), ("B", "X"), ("c", "x"), ("z", "Y")]
    df = channels([{"name": n, "group_name": g, "link": str(i)} for i, (n, g) in enumerate(rows)])
    df = df.withColumn("tvg_name", F.when(F.col("name") == "z", "A"))
    got = ordering.sort_channels(df, by, descending).orderBy("id").collect()
    assert [int(r.link) for r in got] == order
    assert [r.id for r in got] == [0, 1, 2, 3]


def test_no_sorting_keeps_numbers(channels):
    df = channels([{"id": 5}, {"id": 3}])
    assert ordering.sort_channels(df, "none").collect() == df.collect()


def test_first_epg(channels):
    df = channels([{"epg_url": None}, {"epg_url": ""}, {"epg_url": "b"}, {"epg_url": "a"}])
    assert ordering.first_epg(df).first().epg_url == "b"


def test_split_by_group(channels):
    df = channels([{"group_name": g, "link": str(i)} for i, g in enumerate(["b", "", "A", "B", "a"])])
    got = groups.split_by_group(df).orderBy("id").collect()
    assert [(r.id, r.group_label, r.link) for r in got] == [
        (0, "A", "2"), (1, "A", "4"), (2, "b", "0"), (3, "b", "3"), (4, "Uncategorized", "1"),
    ]


def test_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame(
        [(i, k) for i, k in enumerate(["a"] * 5 + ["b"] * 2 + ["c", None, None])], "id long, k string"
    )
    table = spark.createDataFrame([("a", 5, 1, None), ("b", 2, 2, "x"), ("z", 9, 3, "y")], "k string, n long, v int, w string")
    got = lookups.lookup(rows, table.drop("n"), "k", F.col("id")).orderBy("id").collect()
    assert [(r.k, r.v, r.w) for r in got] == [("a", 1, None)] * 5 + [("b", 2, "x")] * 2 + [
        ("c", None, None), (None, None, None), (None, None, None),
    ]


# --- filters ----------------------------------------------------------------


@pytest.mark.parametrize(
    "options, ids",
    [
        ({}, [0, 1, 2]),
        ({"group": " ", "name": "\t"}, [0, 1, 2]),
        ({"group": " СПОРТ "}, [0]),
        ({"name": "t["}, [1, 2]),
        ({"name": "t[", "use_regex": True}, [1]),
        ({"name": "^T.$", "use_regex": True}, [2]),
        ({"name": "ПЕРВЫЙ", "use_regex": True}, [0]),
        ({"group": "g", "name": "zz"}, []),
    ],
)
def test_filter(channels, options, ids):
    rows = [
        {"name": "первый", "group_name": "спорт"}, {"name": "aT[b", "group_name": "G"},
        {"name": "x", "tvg_name": "t[", "group_name": "g"},
    ]
    got = filters.filter_channels(channels(rows), **options).orderBy("id").collect()
    assert [r.id for r in got] == ids


# --- content and probing ----------------------------------------------------


def test_content_duplicates_are_flagged_not_dropped(channels):
    rows = [{"name": n, "content_hash": h, "extra_attributes": x} for n, h, x in [
        ("a", "H", {}), ("b", None, {}), ("c", "H", {"k": "v"}), ("d", None, {}),
        ("e", "H", {"duplicate-of": "old", "z": "1"}), ("f", "I", {}),
    ]]
    got = enrichment.flag_content_duplicates(channels(rows)).orderBy("id").collect()
    assert [r.extra_attributes for r in got] == [
        {}, {}, {"k": "v", "duplicate-of": "a"}, {}, {"duplicate-of": "a", "z": "1"}, {},
    ]


def test_retry_and_working_rows(spark, channels):
    from castsieve.functions.responses import with_verdict

    rows = [
        ("http://a.tv/1", 0, 500, None, b"x"), ("http://a.tv/1", 1, 200, "5", b"G00"), ("http://a.tv/1", 2, 200, None, b"x"),
        ("http://a.tv/2", 0, 500, None, b"x"), ("http://a.tv/2", 3, 200, None, b"x"),
        ("http://a.tv/3", 0, 200, None, b"x"), ("http://a.tv/3", 1, 200, None, b"G00"),
    ]
    answers = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], RESPONSE)
    results = probe.probe_results(with_verdict(answers))
    table = channels([{"link": f"http://a.tv/{n}"} for n in (3, 2, 1, 4, 1)])
    got = probe.filter_working(table, results).orderBy("id").collect()
    assert [(r.id, r.stream_info and r.stream_info.video_codec) for r in got] == [(0, None), (2, "MPEG-TS"), (4, "MPEG-TS")]
    counted = probe.link_counts(table, results).first()
    assert (counted.working, counted.failed, counted.success_rate) == (3, 2, 60.0)


def test_probing_with_a_recorded_fetcher(channels, tmp_path):
    folder = str(tmp_path)

    def fetch(link, timeout):
        import os
        import uuid

        key = link.rsplit("/", 1)[1]
        open(f"{folder}/{key}-{uuid.uuid4().hex}", "w").close()
        tries = sum(name.startswith(key + "-") for name in os.listdir(folder))
        if key == "broken":
            raise OSError("no route")
        if key == "late":
            return (200, None, b"data") if tries == 3 else (503, None, b"")
        return 200, "64", b"x" * 9000

    table = channels([{"link": f"{s}://a.tv/{k}"} for s, k in [
        ("http", "ok"), ("http", "broken"), ("https", "late"), ("rtmp", "other"), ("http", "ok")]])
    results = {r.link: r for r in probe.probe_links(table, fetch, concurrency=3).collect()}
    assert {k.rsplit("/", 1)[1]: r.is_alive for k, r in results.items()} == {"ok": True, "broken": False, "late": True}
    assert results["http://a.tv/ok"].stream_info.bitrate == 64000
    tries = [name.split("-")[0] for name in __import__("os").listdir(folder)]
    assert (tries.count("ok"), tries.count("broken"), tries.count("late")) == (1, 3, 3)


@pytest.mark.parametrize("concurrency, partitions", [(3, None), (7, 2), (1, 50), (100, 64)])
def test_one_limit_for_the_whole_job(spark, channels, tmp_path, concurrency, partitions):
    """Requests in flight, counted over all tasks by files in one folder."""
    folder = str(tmp_path)

    def fetch(link, timeout):
        import time
        import uuid

        mine = f"{folder}/now-{uuid.uuid4().hex}"
        open(mine, "w").close()
        seen = sum(name.startswith("now-") for name in os.listdir(folder))
        open(f"{folder}/seen-{seen:04d}", "w").close()
        time.sleep(0.01)
        os.remove(mine)
        return 200, None, b"x" * 600

    rows = channels([{"name": str(i), "link": f"http://a.tv/{i}"} for i in range(300)])
    found = probe.probe_links(rows, fetch, concurrency, partitions=partitions)
    assert found.count() == 300 and found.where("is_alive").count() == 300
    most = max(int(name[5:]) for name in os.listdir(folder) if name.startswith("seen-"))
    assert most <= min(concurrency, 50)
