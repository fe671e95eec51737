"""One row per rule that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from castsieve.functions import enrich, entries, names, responses, urls
from castsieve.functions.text import fold, sort_key, trim


def values(spark, inputs, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    out = column(df) if not hasattr(column, "alias") else df.withColumn("out", column)
    return [r["out"] for r in out.orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "http://www.a.tv:80/x?utm_s=1&b=2&a=1": "http://a.tv/x?a=1&b=2",
        "http://a.tv/b/?utm_s=1": "http://a.tv/b/",
        "http://a.tv/b": "http://a.tv/b",
        "  HTTPS://A.tv:443/B//  ": "https://a.tv/b",
        "http://a.tv:80": "http://a.tv:80",
        "?a=1": "?a=1",
        "http://a.tv/x?": "http://a.tv/x",
        "http://a.tv/x?t=1&&token=2": "http://a.tv/x",
        "http://a.tv/x?b=1?c=2&a": "http://a.tv/x?a&b=1?c=2",
        "http://a.tv/x?ab=1&a_c=2": "http://a.tv/x?ab=1&a_c=2",
        " \t ": "",
        None: "",
    }
    got = values(spark, list(cases), lambda df: urls.with_normalized_url(df, "x", "out"))
    assert got == list(cases.values())


def test_link_key_ignores_case_of_every_script(spark):
    got = values(spark, ["http://a/ΑΣ", "http://a/ας"], lambda df: urls.with_link_key(df, "x", "out"))
    assert got[0] == got[1]


STREAM_URLS = [
    ("http://a.tv/x", True),
    ("RTMP://ok.com/z1", True),
    ("mmsh://ab.c/1", True),
    ("http://a.tv", True),
    ("http://user:pw@a.tv:8080/x?y#z", True),
    ("http://my_host/x|y z", True),
    ("http://[::1]:80/x", True),
    ("http://пример.рф/x", True),
    ("http://a.tv:65535/x", True),
    ("http://a.tv:/x", True),
    ("http://a.tv/x.png?y", False),
    ("http://a.tv/x.PNG", False),
    ("http://a.tv/x.png/", True),
    ('http://a.tv/x.png"', True),
    ("http://a.tv/x?y=.png", True),
    ("http://archive.gz", True),
    ("http://a.tv/p.m3u8", True),
    ("http://a.tv:65536/x", False),
    ("http://a.tv:x/x", False),
    ("http://ab/x", False),
    ("http:///x", False),
    ("http://a tv/x", False),
    ("http://LOCALHOST:80/x", False),
    ("http://127.0.0.1", False),
    ("http://0.0.0.0/x", False),
    ("http://localhost.tv/x", True),
    ("udp://a.tv/x", False),
    ("ftp://a.tv/x", False),
    ("a.tv/x", False),
    ("", False),
    (None, False),
]


def test_stream_url(spark):
    got = values(spark, [url for url, _ in STREAM_URLS], urls.is_stream_url(F.col("x")))
    assert list(zip([url for url, _ in STREAM_URLS], got)) == STREAM_URLS


def test_only_web_links_are_probed(spark):
    cases = ["rtmp://a.tv/x", " https://a.tv/x ", "http://localhost/x.png", "http:///x", None]
    assert values(spark, cases, urls.is_probeable(F.col("x"))) == [False, True, True, False, False]


def test_normalize_name(spark):
    cases = {
        "Первый канал! HD": "первый канал",
        "foohd": "foo",
        "One HD 4K": "one hd",
        "Name [HD]": "name hd",
        "#EXTINF:-1,Two  Words": "two words",
        "#EXTINF:-1,": "extinf 1",
        "a_b-c": "a_b c",
        "\U0001d407\U0001d401\U0001d40e tv": "tv",
        "  \t": "",
        None: "",
    }
    got = values(spark, list(cases), lambda df: names.with_normalized_name(df, "x", "out"))
    assert got == list(cases.values())


def test_eligible_name(spark):
    cases = ["News", "abc", "abcd", "Sports HD", "sports tv"]
    got = values(spark, cases, lambda df: names.with_eligible_name(df, "x", "out"))
    assert got == [None, None, "abcd", None, "sports tv"]


def test_fold_keeps_letters_without_a_single_upper_case(spark):
    cases = ["straße", "STRASSE", "ſı", "ΑΣΑΣ", "ασας", "Ünïcode", "abc"]
    assert values(spark, cases, fold(F.col("x"))) == [
        "STRAßE", "STRASSE", "ſı", "ΑΣΑΣ", "ΑΣΑΣ", "ÜNÏCODE", "ABC",
    ]


def test_sort_key_orders_by_utf16_unit(spark):
    df = spark.createDataFrame([("\U0001f4fa",), ("️",), ("z",), ("A",), ("_",)], "x string")
    assert [r.x for r in df.orderBy(sort_key(F.col("x"))).collect()] == ["A", "z", "_", "\U0001f4fa", "️"]


def test_trim_knows_unicode_blanks(spark):
    assert values(spark, ["　\t a b  "], trim(F.col("x"))) == ["a b"]


def test_entry_name(spark):
    cases = {
        '#EXTINF:-1 tvg-name="A, B",C': 'B",C',
        "#EXTINF:-1": "#EXTINF:-1",
        '#EXTINF:-1 tvg-name=" T "': "T",
        "#extinf : 12 x=1,  lower, case ": "lower, case",
        "#EXTINF:-1, ": "#EXTINF:-1, ",
        "#EXTINF:-1,a\u0085b": "a\u0085b",
    }
    column = entries.entry_name(F.col("x"), entries.named_attribute(F.col("x"), "tvg-name"))
    assert values(spark, list(cases), column) == list(cases.values())


def test_extra_attributes(spark):
    cases = {
        '#EXTINF:-1 a-b="1" A-B="2" c = "3" x="" y=" ",n': [("a-b", "2"), ("c", "3")],
        '#EXTINF:-1 TVG-ID="1" url-tvg="u" tvg-language="English",n': [("tvg-language", "English")],
        '#EXTINF:-1 ключ="да" --k="v",n': [("ключ", "да"), ("k", "v")],
        "#EXTINF:-1,n": [],
    }
    got = values(spark, list(cases), lambda df: entries.with_extra_attributes(df, "x", "out"))
    assert [list(m.items()) for m in got] == list(cases.values())


def test_header_epg(spark):
    cases = [
        '#EXTM3U x-tvg-url=" a "', '#extm3u URL-TVG="b"', '#EXTM3U x-tvg-url="" url-tvg="c"',
        ' #EXTM3U x-tvg-url="a"', "#EXTM3U", "",
    ]
    assert values(spark, cases, entries.header_epg(F.col("x"))) == ["a", "b", "c", None, None, None]


CATEGORIES = [
    ("x", None, "Sports", ("News", "Sports")),
    ("ESPN", None, "uncategorized", ("Sports", "Sports")),
    ("ESPN", None, " ", ("Sports", " ")),
    ("Comedy", "Central", "", ("Series", "Series")),
    ("plain", None, "", ("Unknown", "")),
    ("ACTUALITÉS", None, "g", ("News", "g")),
    ("news", None, "Kids", ("Kids", "Kids")),
]


def test_auto_categorize(channels):
    from castsieve.operators.enrichment import auto_categorize

    rows = channels([{"name": n, "tvg_name": t, "group_name": g} for n, t, g, _ in CATEGORIES])
    got = auto_categorize(rows).orderBy("id").collect()
    assert [(r.category, r.group_name) for r in got] == [expected for *_, expected in CATEGORIES]


def test_whole_word_keywords(channels):
    from castsieve.operators.enrichment import auto_categorize

    rows = auto_categorize(channels([{"name": "Cartoon"}, {"name": "RT live"}]), whole_words=True)
    assert [r.category for r in rows.orderBy("id").collect()] == ["Kids", "News"]


def test_own_keyword_table(channels):
    from castsieve.operators.enrichment import auto_categorize

    rows = auto_categorize(channels([{"name": "Chess Open"}]), {"Games": ["chess"]})
    assert rows.first().category == "Games"


MARKED = [
    ("In Touch", "", "Hindi"),
    ("(HD) [IT] x", "", None),
    ("(it) x", "", "Italian"),
    ("Jerusalem", "", "English"),
    ("xx: x", "Persian", "Persian"),
    ("US", "", None),
    ("us|x", "", "English"),
    ("a", "b", None),
    ("Farsi Greek", "", "Persian"),
]


def test_language(channels):
    rows = channels([{"name": n, "group_name": g} for n, g, _ in MARKED])
    got = enrich.with_language(rows).orderBy("id").collect()
    assert [r.language and r.language.name for r in got] == [language for *_, language in MARKED]


def test_rename(channels):
    from castsieve.operators.enrichment import rename_channels

    rows = channels([{"name": "N", "tvg_name": "T"}, {"name": " a.b A.B "}])
    got = rename_channels(rows, "a.b", "$1").orderBy("id").collect()
    assert [(r.name, r.tvg_name) for r in got] == [("T", "T"), ("$1 $1", None)]
    assert rename_channels(rows, "(", "x", use_regex=True).orderBy("id").collect() == rows.orderBy("id").collect()
    assert rename_channels(rows, "").collect() == rows.collect()


@pytest.mark.parametrize(
    "pattern, replacement, java",
    [
        (r"(a)(b)", "$2$1", "$2$1"),
        (r"(a)", "$2", "\\$2"),
        (r"(a)", "${1}0", "$1\\0"),
        (r"(a)", "$10", "\\$10"),
        (r"(?<n>a)(b)", "$1-${n}", "$2-$1"),
        (r"\((a)[(]", "$$ $& \\", "\\$ $0 \\\\"),
        (r"(?:a)(b)(?=c)", "$+", "$1"),
    ],
)
def test_replacement_spelling(pattern, replacement, java):
    assert enrich.java_replacement(pattern, replacement) == java


def test_unsupported_replacement():
    with pytest.raises(ValueError):
        enrich.java_replacement("a", "$`")


def response(link="http://a.tv/x", status=200, icy=None, body=b"data"):
    return (link, 0, status, icy, bytes(body))


VERDICTS = [
    (response(), True, None),
    (response(status=404), False, None),
    (response(status=None), False, None),
    (response(link="rtmp://a.tv/x"), False, None),
    (response(body=b""), False, None),
    (response(body=b" \r\n<!doctype html>"), False, None),
    (response(body=b"<?xml v?>\n<HTML>"), False, None),
    (response(body=b"<?xml v?>\n<a>"), True, None),
    (response(body=b"... Access Denied ..."), False, None),
    (response(body=b"x" * 1995 + b"not found"), True, None),
    (response(body=b"\x85<html"), True, None),
    (response(icy="128"), True, (None, None, 128000, None, None)),
    (response(icy=" -5 "), True, (None, None, -5000, None, None)),
    (response(icy="1.5"), True, None),
    (response(icy="2147484"), True, (None, None, -2147483296, None, None)),
    (response(body=b"\xff\xf1\x50\x80"), True, (None, None, None, None, "MP3")),
    (response(body=b"\xff\xe1"), True, None),
    (response(body=b"G\x00\x00"), True, (None, None, None, "MPEG-TS", None)),
    (response(body=b"FLV1"), True, (None, None, None, "FLV", None)),
    (response(body=b"ID3x"), True, (None, None, None, None, "MP3/AAC")),
    (response(body=b"#EXTM3U BANDWIDTH=9999999999"), False, None),
    (response(body=b"BANDWIDTH=9999999999"), True, None),
    (
        response(icy="64", body=b'#extm3u AVERAGE-BANDWIDTH=5,BANDWIDTH=7,RESOLUTION=1x2,CODECS="hev1.1, ac-3,vp9"'),
        True,
        (1, 2, 64000, "VP9", "AC3"),
    ),
]


def test_verdict(spark):
    from castsieve.schema import RESPONSE

    # The attempt column carries the place of the case.
    rows = [(row[0], i, *row[2:4], bytearray(row[4])) for i, (row, *_) in enumerate(VERDICTS)]
    got = responses.with_verdict(spark.createDataFrame(rows, RESPONSE)).orderBy("attempt").collect()
    assert [(r.is_alive, r.stream_info and tuple(r.stream_info)) for r in got] == [
        (alive, info) for _, alive, info in VERDICTS
    ]


def test_content_signature(spark):
    rows = [(200, b"a" * 255), (200, b"a" * 256), (404, b"a" * 256), (200, b"a" * 2048), (206, b"a" * 4000)]
    df = spark.createDataFrame([(i, s, bytearray(b)) for i, (s, b) in enumerate(rows)], "i int, s int, b binary")
    got = [r[0] for r in df.orderBy("i").select(responses.content_signature(F.col("s"), F.col("b"))).collect()]
    assert got[0] is None and got[2] is None and len(got[1]) == 16
    assert len({got[1], got[3], got[4]}) == 3
    # All bytes count, also those behind a long common beginning.
    pages = spark.createDataFrame([(bytearray(b"a" * 2048 + b"x"),), (bytearray(b"a" * 2048 + b"y"),)], "b binary")
    assert len({r[0] for r in pages.select(responses.content_signature(F.lit(200), F.col("b"))).collect()}) == 2


def test_success_rate(spark):
    df = spark.createDataFrame([(0, 0), (3, 4)], "w long, t long")
    assert [r[0] for r in df.select(responses.success_rate(F.col("w"), F.col("t"))).collect()] == [0.0, 75.0]


def test_spellings_of_this_machine(spark):
    local = ["127.0.0.1", "0x7f.1", "0x7F.0.0.1", "127.1", "127.0.1", "0177.0.0.01", "2130706433", "0x7f000001", "017700000001"]
    local += ["0.0.0.0", "0", "0x0", "0.0", "00.0x0.0.0", "LOCALHOST"]
    other = ["127.0.0.2", "0x7f.2", "126.1", "2130706434", "0x7f.1.example", "127.0.0.1.example", "0x7g.1", "9", "12", "07", "1.1"]
    short = ["08", "a", "ab", "0a"]
    rows = [(f"{scheme}://{user}{host}{tail}", good) for hosts, good in ((local, False), (other, True), (short, False)) for host in hosts
            for scheme in ("http", "RTMP") for user in ("", "me@") for tail in ("", "/live", ":8080/x", "?q")]
    df = spark.createDataFrame(rows, "url string, good boolean")
    wrong = df.where(urls.is_stream_url(F.col("url")) != F.col("good")).collect()
    assert not wrong
