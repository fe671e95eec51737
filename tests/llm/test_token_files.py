"""Token files: exact round trip and reading in part."""

import io
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from castsieve.llm import encoding, token_files
from castsieve.llm.encoding import WordEncoder
from castsieve.llm.token_files import Reader, Writer, read_documents, read_tokens, write_tokens

ENCODERS = {name: WordEncoder(name, remembered=50) for name in WordEncoder.PATTERNS}
BYTE = ENCODERS["byte_bpe_50k.json"]


def library(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b'S", " ", "\n", "\t", "\r", ".", ",!", "1", "É", "ß", "İ", "'re", "  ", "\0", "Σ", "é", "字", "\xa0", "<|endoftext|>", "wOrd"]), max_size=25).map("".join))
def test_encoding_equals_the_library(text):
    for encoder in ENCODERS.values():
        assert encoder.encode([text, text]) == [library(encoder, text)] * 2


def test_usual_characters():
    for c in map(chr, range(0x300)):
        assert encoding._unusual(f"a{c}") == (encoding._UNUSUAL.search(c) is not None)


def expected(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = library(BYTE, text or "") + b"\2\0\0\0"
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_round_trip(spark):
    rows = [(5, "Hello  there\n"), (-3, None), (2, ""), (900, "x y " * 3000), (7, "É" * 50), (8, "same"), (8, "same")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start long, _text string")
    manifest = write_tokens(df, files=3)
    found = read_tokens(manifest, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(expected(rows))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in found)
    wanted = spark.createDataFrame([(8,), (2,), (2,), (77,), (900,)], "doc_id long")
    part = read_documents(manifest, wanted).drop("ids").collect()
    assert sorted(map(tuple, part)) == sorted(r for r in expected(rows) if r[0] in (8, 2, 900))
    assert read_tokens(write_tokens(df.limit(0))).count() == 0
    nameless = [(None, "x"), (None, "y y"), (-(1 << 63), "z"), (4, "w")]
    manifest = write_tokens(spark.createDataFrame(nameless, "doc_id long, text string"), files=1)
    found = read_tokens(manifest).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None, None, -(1 << 63), 4]
    asked = spark.createDataFrame([(4,), (-(1 << 63),), (None,)], "doc_id long")
    assert sorted(r.doc_id for r in read_documents(manifest, asked).collect()) == [-(1 << 63), 4]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = read_tokens(write_tokens(docs)).collect()
    assert sorted(map(tuple, found)) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]))


def test_format(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 4)
    documents = {1: b"", 4: np.arange(11, dtype="<u4").tobytes(), 9: b"\7\0\0\0"}
    stream = io.BytesIO()
    writer = Writer(stream)
    for doc_id, ids in documents.items():
        writer.add(doc_id, ids)
    writer.finish()
    data = stream.getvalue()
    assert writer.bytes == len(data)
    # Any reader of the format sees the ids of all documents one after another.
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(documents.values())
    reader = Reader(io.BytesIO(data), len(data))
    for doc_id, ids in documents.items():
        assert [reader.ids(p) for p in reader.places(doc_id)] == [ids]
    assert not reader.places(5)
    frame = int(reader.offsets[2])
    damaged = data[:frame] + bytes([data[frame] ^ 1]) + data[frame + 1 :]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Reader(io.BytesIO(damaged), len(damaged)).ids(1)
    with pytest.raises(ValueError):
        Reader(io.BytesIO(data[:-1]), len(data) - 1)
