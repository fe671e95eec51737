"""Reading, writing, whole runs and streaming over real files."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from castsieve import CleanOptions, clean_playlists, read_playlists
from castsieve.plans.clean import clean_channels
from castsieve.schema import RESPONSE
from castsieve.sources import playlists, writers
from castsieve.sources.writers import write_group_files, write_group_playlists
from castsieve.streaming.incremental import start_cleaning

SAMPLE = '#EXTM3U x-tvg-url="epg"\n#EXTINF:-1 group-title="Grüße",Ünï\nhttp://ok.tv/1\n'


def put(folder, name, content):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def facts(df):
    return [(r.id, r.name, r.link, r.group_name, r.epg_url) for r in df.orderBy("id").collect()]


ENCODED = [
    SAMPLE.encode(),
    b"\xef\xbb\xbf" + SAMPLE.encode(),
    SAMPLE.encode("utf-16"),
    b"\xfe\xff" + SAMPLE.encode("utf-16-be"),
    b"\xff\xfe\x00\x00" + SAMPLE.encode("utf-32-le"),
    b"\x00\x00\xfe\xff" + SAMPLE.encode("utf-32-be"),
    SAMPLE.replace("\n", "\r\n").encode(),
    SAMPLE.replace("\n", "\r").encode(),
    SAMPLE.rstrip("\n").encode(),
]


def test_encodings_and_line_ends(spark, tmp_path):
    for i, content in enumerate(ENCODED):
        put(tmp_path, f"{i}.m3u", content)
    got = facts(read_playlists(spark, [str(tmp_path)]))
    assert got == [(i, "Ünï", "http://ok.tv/1", "Grüße", "epg") for i in range(len(ENCODED))]


def test_broken_bytes_become_replacement_characters(spark, tmp_path):
    path = put(tmp_path, "a.m3u", b"#EXTINF:-1,a\xffb\nhttp://ok.tv/1\n")
    assert facts(read_playlists(spark, [path]))[0][1] == "a�b"


def test_empty_and_missing_sources(spark, tmp_path):
    assert facts(read_playlists(spark, [put(tmp_path, "a.m3u", b"")])) == []
    with pytest.raises(FileNotFoundError, match="none.m3u"):
        read_playlists(spark, [str(tmp_path / "none.m3u")])
    with pytest.raises(ValueError):
        read_playlists(spark, [])
    with pytest.raises(ValueError):
        read_playlists(spark, ["http://a.tv/list.m3u"])


def playlist(rng, entries, name):
    lines = [f'#EXTM3U x-tvg-url="{name}"'] if rng.random() < 0.5 else []
    for i in range(entries):
        lines.append(f'#EXTINF:-1 tvg-id="{name}{i}" group-title="g{i % 5}",{name} {i} {"pad" * rng.randrange(9)}')
        lines += rng.choice([[], [""], ["# c", ""], ["", "", ""], ["", "", "", ""], ["#EXTGRP:o"]])
        lines.append(f"http://ok{rng.randrange(50)}.tv/{rng.randrange(400)}")
    return "\n".join(lines)


def test_files_in_splits_equal_files_read_whole(spark, tmp_path):
    rng = random.Random(2)
    for k in range(4):
        put(tmp_path, f"in/{k}.m3u", playlist(rng, [900, 40, 700, 5][k], f"p{k}"))
    folder = str(tmp_path / "in")
    whole = facts(read_playlists(spark, [folder]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for limit in (0, 10_000):
            assert facts(read_playlists(spark, [folder], whole_file_bytes=limit)) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(whole) > 1000


WIDE = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\0\0", "utf-32-be": b"\0\0\xfe\xff"}


@pytest.mark.parametrize("breaks", ["\n", "\r\n", "\r"])
def test_the_size_of_a_file_never_changes_what_is_found(spark, tmp_path, breaks):
    rng = random.Random(4)
    text = playlist(rng, 120, "p").replace("pad", "\u0a05\u4e00\u0a00\u000b")
    text = "\n" + text.replace("\n", breaks) if breaks == "\r" else text.replace("\n", breaks)
    forms = {name: mark + text.encode(name) for name, mark in WIDE.items()}
    forms |= {"utf-8": text.encode(), "utf-8-sig": text.encode("utf-8-sig"), "gz.m3u": gzip.compress(text.encode())}
    forms["utf-16.m3u"] = gzip.compress(WIDE["utf-16-le"] + text.encode("utf-16-le"))
    expected = None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, content in forms.items():
            path = put(tmp_path, f"{name}.m3u" + (".gz" if "m3u" in name else ""), content)
            for limit in (0, 1 << 24):
                got = facts(read_playlists(spark, [path], whole_file_bytes=limit))
                expected = expected or got
                assert got == expected, (name, limit)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(expected) > 80


def test_names_of_sources_are_literal(spark, tmp_path):
    names = ["list [HD].m3u", "a{b}*.m3u", "x y%20.m3u", "Ü?.m3u"]
    paths = [put(tmp_path, n, f"#EXTINF:-1,n{i}\nhttp://ok.tv/{i}\n") for i, n in enumerate(names)]
    for limit in (0, 1 << 20):
        got = facts(read_playlists(spark, paths[::-1], merge=True, whole_file_bytes=limit))
        assert [n for _, n, *_ in got] == ["n3", "n2", "n1", "n0"]
    for hidden in ("_x.m3u", ".y.m3u"):
        with pytest.raises(FileNotFoundError):
            read_playlists(spark, [put(tmp_path, hidden, "#EXTINF:-1,a\nhttp://ok.tv/1\n")])
    # A file named twice, once by its folder, counts at both places; a glob still works.
    from castsieve.sources.playlists import parse_sources

    twice = parse_sources(spark, [paths[0], str(tmp_path), str(tmp_path / "x*.m3u")])
    assert sorted((r.src_ord, r.name) for r in twice.collect()) == sorted(
        [(0, "n0"), *[(1, f"n{i}") for i in range(4)], (2, "n2")]
    )


def test_many_sources_are_one_scan(spark, tmp_path):
    paths = [put(tmp_path, f"{i}.m3u", f"#EXTINF:-1,n{i}\nhttp://ok.tv/{i % 90}\n") for i in range(100)]
    merged = read_playlists(spark, paths[::-1], merge=True)
    assert [n for _, n, *_ in facts(merged)] == [f"n{i}" for i in range(99, 9, -1)]


def test_web_links_among_the_sources(spark, tmp_path):
    path = put(tmp_path, "a.m3u", "#EXTINF:-1,file\nhttp://ok.tv/1\n")

    def fetch(url):
        return f"#EXTINF:-1,{url[-1]}\nhttp://ok.tv/{url[-1]}\n".encode("utf-16")

    result = clean_playlists(
        spark, ["http://lists.tv/2", path, "https://lists.tv/1"], CleanOptions(merge=True, skip_validation=True),
        fetch_playlist=fetch,
    )
    assert [r.name for r in result.channels.orderBy("id").collect()] == ["2", "file"]


def test_merge_takes_sources_in_the_given_order(spark, tmp_path):
    a = put(tmp_path, "a.m3u", "#EXTINF:-1,a1\nhttp://ok.tv/1\n#EXTINF:-1,a2\nhttp://ok.tv/2\n")
    b = put(tmp_path, "b.m3u", "#EXTINF:-1,b1\nhttp://www.ok.tv:80/1/\n#EXTINF:-1,b3\nhttp://ok.tv/3?t=1\n")
    merged = read_playlists(spark, [b, a], merge=True)
    assert [(i, n) for i, n, *_ in facts(merged)] == [(0, "b1"), (1, "b3"), (2, "a2")]
    assert [n for _, n, *_ in facts(read_playlists(spark, [b, a]))] == ["b1", "b3"]
    assert len(facts(read_playlists(spark, [a], merge=True))) == 2


def test_fetched_texts(spark):
    urls = spark.createDataFrame([(0, "http://a.tv/l.m3u"), (1, "HTTPS://b.tv/l")], "src_ord int, url string")
    texts = playlists.fetched_texts(urls, lambda url: SAMPLE.replace("/1", url[-4:]).encode())
    parsed = playlists.entries_of_links(playlists.links_in_texts(texts))
    assert sorted(r.src_ord for r in parsed.collect()) == [0, 1]
    with pytest.raises(Exception, match="not a web link"):
        playlists.fetched_texts(spark.createDataFrame([(0, "ftp://a")], urls.schema), lambda url: b"").collect()


def read_parts(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(os.path.join(folder, f), encoding="utf-8").read() for f in parts)


def test_written_playlist_reads_back(spark, tmp_path):
    source = put(tmp_path, "a.m3u", playlist(random.Random(4), 300, "x"))
    loaded = read_playlists(spark, [source])
    writers.write_playlist(loaded, str(tmp_path / "out"))
    text = read_parts(str(tmp_path / "out"))
    back = read_playlists(spark, [put(tmp_path, "back.m3u", text)])
    assert facts(back) == facts(loaded)


def test_playlist_text(spark, channels, tmp_path):
    df = channels(
        [
            {"name": "n", "link": "http://ok.tv/1", "group_name": "G", "tvg_id": "i", "tvg_logo": "l",
             "language": ("en", "English", None)},
            {"name": '#EXTINF:-1 group-title="Q"', "link": "http://ok.tv/2", "group_name": "Q", "epg_url": "e"},
            {"name": "#extinf:-1", "tvg_name": "t", "link": "http://ok.tv/3", "group_name": "H"},
            {"name": "n", "tvg_name": "", "link": "http://ok.tv/4"},
        ]
    )
    extras = F.create_map(*map(F.lit, ["b", "2", "a", "1"]))  # in this order
    df = df.withColumn("extra_attributes", F.when(F.col("id") == 0, extras))
    writers.write_playlist(df, str(tmp_path / "out"))
    assert read_parts(str(tmp_path / "out")).split("\n") == [
        '#EXTM3U x-tvg-url="e"',
        '#EXTINF:-1 tvg-id="i" tvg-logo="l" tvg-language="English" group-title="G" b="2" a="1",n',
        "#EXTGRP:G", "http://ok.tv/1",
        '#EXTINF:-1 group-title="Q"', "http://ok.tv/2",
        "#extinf:-1", "#EXTGRP:H", "http://ok.tv/3",
        "#EXTINF:-1,", "http://ok.tv/4", "",
    ]


def test_one_playlist_per_group(channels, tmp_path):
    groups = ["a b", "c/d", "A B", "", "a_b", "c/d"]
    rows = [{"name": f"n{i}", "link": f"http://ok.tv/{i}", "group_name": g} for i, g in enumerate(groups)]
    rows[5]["epg_url"] = "e"
    writers.write_group_playlists(channels(rows), str(tmp_path / "out"), name="x.m3u")
    folders = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("playlist="))
    assert folders == ["playlist=x_Uncategorized.m3u", "playlist=x_a_b.m3u", "playlist=x_c_d.m3u"]
    links = {f: [l for l in read_parts(str(tmp_path / "out" / f)).split("\n") if l.startswith("http")] for f in folders}
    assert links["playlist=x_a_b.m3u"] == ["http://ok.tv/0", "http://ok.tv/2", "http://ok.tv/4"]
    assert read_parts(str(tmp_path / "out" / "playlist=x_c_d.m3u")).startswith('#EXTM3U x-tvg-url="e"\n')
    assert read_parts(str(tmp_path / "out" / "playlist=x_a_b.m3u")).startswith("#EXTM3U\n#EXTINF")


def test_table_keeps_all_columns(spark, channels, tmp_path):
    df = channels([{"content_hash": "H", "category": "News", "stream_info": (1, 2, 3, "v", "a")}])
    writers.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).collect() == df.collect()


RUN = """#EXTM3U
#EXTINF:-1 group-title="",US: CNN HD
http://a.tv/1
#EXTINF:-1,US: CNN
http://a.tv/2
#EXTINF:-1 group-title="Kids TV",Duck
http://a.tv/3
#EXTINF:-1,Bolt plain
http://a.tv/4
"""


def test_whole_run(spark, tmp_path):
    source = put(tmp_path, "a.m3u", RUN)
    fetched = lambda link, timeout: (404 if link.endswith("4") else 200, None, b"G000")
    out = str(tmp_path / "out")
    result = clean_playlists(
        spark, [source], CleanOptions(sort_by="name", descending=True, export_path=out), fetch=fetched
    )
    rows = result.channels.orderBy("id").collect()
    assert [(r.id, r.name, r.category, r.group_name, r.language and r.language.name) for r in rows] == [
        (0, "US: CNN HD", "News", "News", "English"), (1, "Duck", "Kids", "Kids TV", None),
    ]
    assert rows[0].stream_info.video_codec == "MPEG-TS"
    assert result.report.first().asDict() == {
        "working_count": 2, "total_count": 3, "doubles_removed_count": 1, "original_count": 4,
        "group_count": 2, "categorized_count": 2, "languages_count": 1,
    }
    assert read_parts(out).count("#EXTINF") == 2


def test_options_switch_steps_off(spark, tmp_path):
    source = put(tmp_path, "a.m3u", RUN)
    options = CleanOptions(
        remove_doubles=False, categorize=False, detect_language=False, skip_validation=True,
        name_filter="^us", use_regex=True, rename_pattern="^us: (.*)$", rename_replacement="$1!",
        split_by_group=True, export_path=str(tmp_path / "out"), export_name="o",
    )
    result = clean_playlists(spark, [source], options)
    assert [(r.id, r.name, r.category) for r in result.channels.orderBy("id").collect()] == [
        (0, "CNN HD!", "Unknown"), (1, "CNN!", "Unknown"),
    ]
    report = result.report.first()
    assert (report.total_count, report.doubles_removed_count, report.categorized_count) == (2, 0, 0)
    assert "playlist=o_Uncategorized" in os.listdir(tmp_path / "out")


def test_run_flags_equal_content(spark, channels):
    rows = channels([{"name": f"name {i}", "link": f"http://a.tv/{i}"} for i in range(3)])
    answers = spark.createDataFrame(
        [(f"http://a.tv/{i}", 0, 200, None, bytearray(b"ab"[i % 2 : i % 2 + 1] * 300)) for i in range(3)], RESPONSE
    )
    options = CleanOptions(content_duplicates=True, skip_validation=True)
    got = clean_channels(rows, options, responses=answers).channels.orderBy("id").collect()
    assert [r.extra_attributes for r in got] == [{}, {}, {"duplicate-of": "name 0"}]
    fetch = lambda link, timeout: (200, None, b"ab"[int(link[-1]) % 2 :][:1] * 9000)
    fetched = clean_channels(rows, options, fetch=fetch).channels.orderBy("id").collect()
    assert [r.extra_attributes for r in fetched] == [r.extra_attributes for r in got]
    with pytest.raises(ValueError):
        clean_channels(rows, options)
    with pytest.raises(ValueError):
        clean_channels(rows, CleanOptions())


def test_playlists_arriving_in_a_folder(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(tmp_path, "in/a.m3u", RUN)
    start_cleaning(spark, folder, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    put(tmp_path, "in/b.m3u", "#EXTINF:-1,New\nhttp://b.tv/9\n")
    start_cleaning(spark, folder, out, mark).awaitTermination()
    table = spark.read.parquet(out)
    assert sorted((r.batch, r.name) for r in table.collect())[-1] == (1, "New")
    assert table.count() == 4 and table.where(F.col("category") == "News").count() == 1


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_one_file_per_group(spark, channels, tmp_path, partitions):
    """Exact names, also odd ones; contents equal those written as folders; nothing else stays."""
    groups = ["News", "news", "a/b c", "x=y%", "Größe", "", "Big"]
    rows = channels([{"name": f"n{i}", "link": f"http://a.tv/{i}", "group_name": groups[min(i, 6)]} for i in range(900)])
    out, parts = str(tmp_path / "files"), str(tmp_path / "folders")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        write_group_files(rows, out, "list.v1.m3u")
        write_group_playlists(rows, parts, "list.v1.m3u")
        with pytest.raises(FileExistsError):
            write_group_files(rows, out, "list.v1.m3u")
        write_group_files(rows, out, "list.v1.m3u", mode="overwrite")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = sorted(f for f in os.listdir(out) if not f.endswith(".crc"))
    assert files == sorted(f"list.v1_{g}.m3u" for g in ("News", "a_b_c", "x=y%", "Größe", "Uncategorized", "Big"))
    for file in files:
        expected = spark.read.text(parts).where(F.col("playlist") == file).collect()
        text = open(f"{out}/{file}", encoding="utf-8").read()
        assert text.endswith("\n") and sorted(text.split("\n")[:-1]) == sorted(r.value for r in expected)
    big = open(f"{out}/list.v1_Big.m3u").read().split("\n")
    links = [int(x.rsplit("/", 1)[1]) for x in big if x.startswith("http")]
    assert big[0] == "#EXTM3U" and links == list(range(6, 900))


def test_a_failed_attempt_leaves_nothing(spark, channels, tmp_path, monkeypatch):
    rows = channels([{"name": "a", "link": "http://a.tv/1", "group_name": "G"}])
    monkeypatch.setattr(writers, "_part_files", lambda fs, folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write_group_files(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-32-le"])
def test_line_feeds_inside_characters_in_many_splits(spark, tmp_path, monkeypatch, encoding):
    """Characters whose bytes look like a line end: no line, however it is cut, differs from the whole file's."""
    entries = "".join(f"#EXTINF:-1,{'\u0a0a' * (i % 9)}n{i}\u0a00\u000a\u0a0ahttp\nhttp://a.tv/{i}\n" for i in range(400))
    text = "#EXTM3U\n" + "#EXTINF:-1," + "\u0a0a" * 3000 + "\nhttp://a.tv/long\n" + entries
    path = tmp_path / "wide.m3u"
    path.write_bytes(WIDE[encoding] + text.encode(encoding))
    monkeypatch.setattr(playlists, "BLOCK_ROWS", 50)
    columns = ["line_no", "name", "link", "group_name"]
    whole = playlists.parse_sources(spark, [str(path)]).select(columns).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(path.read_bytes()) // 20))
    try:
        cut = playlists.parse_sources(spark, [str(path)], 10).select(columns).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, cut)) == sorted(map(str, whole)) and len(whole) > 300


def test_a_glob_of_all_files_of_a_folder_lists_the_folder_once(spark, tmp_path):
    from castsieve.sources.playlists import _gathered, find_files, parse_sources

    for k in range(40):
        put(tmp_path / "lists", f"list {k}.m3u", f"#EXTM3U\n#EXTINF:-1,n{k}\nhttp://a.tv/{k}\n".encode())
    folder = str(tmp_path / "lists")
    names = [f"file:{folder}/list {k}.m3u" for k in range(40)]
    links = [f"http://a.tv/{k}" for k in sorted(range(40), key=lambda k: f"list {k}.m3u")]
    source = [(0, f"{folder}/list*")]
    put(tmp_path / "lists", "_SUCCESS", b"")
    assert find_files(spark, source)[0] == [f"file:{folder}"] == _gathered(spark, names)
    read = lambda df: [r.link for r in df.orderBy("src_ord", "file", "line_no").collect()]
    assert read(parse_sources(spark, [f"{folder}/list*"])) == links
    # A file more: the others are named.
    put(tmp_path / "lists", "other.m3u", b"#EXTINF:-1,o\nhttp://a.tv/o\n")
    assert len(find_files(spark, source)[0]) == 40 == len(_gathered(spark, names))
    assert read(parse_sources(spark, [f"{folder}/list*"])) == links
    assert find_files(spark, [(0, f"{folder}/*")])[0] == [f"file:{folder}"]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-32-be"])
def test_wide_files_are_read_once(spark, tmp_path, monkeypatch, encoding):
    """Their encoding is known before their lines are read; marks inside a text are text, as in whole files."""
    for k in range(3):
        text = f"#EXTM3U\r\r\n#EXTINF:-1,\u0a0a{k}\rhttp://a.tv/{k}\n\ufeff#EXTINF:-1,no entry\nhttp://b.tv/{k}\n#EXTINF:-1,b\n\nhttp://c.tv/{k}"
        (tmp_path / f"{k}.m3u").write_bytes(WIDE[encoding] + text.encode(encoding))
    columns = ["file", "line_no", "name", "link", "group_name"]
    read = lambda limit: sorted(map(str, playlists.parse_sources(spark, [str(tmp_path)], limit).select(columns).collect()))
    whole, scans, scan = read(1 << 20), [], playlists._marked_lines
    monkeypatch.setattr(playlists, "_marked_lines", lambda *a, **options: scans.append(options) or scan(*a, **options))
    assert read(10) == whole and len(whole) == 6
    assert [len(options) for options in scans] == [2]
    # Longer files, whose pieces are brought together by blocks.
    monkeypatch.setattr(playlists, "BLOCK_ROWS", 2)
    assert read(10) == whole
