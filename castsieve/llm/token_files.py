"""Token ids in files of independent zstandard frames that can be read in part.

A file holds documents in ascending order of their ids:

* one frame per document (very long ones: a frame for every ``FRAME_IDS`` ids),
  its content the ids as little-endian unsigned 32-bit integers;
* a skippable frame with the document table: per document its id, its number of
  ids and its number of frames;
* a trailing skippable frame with the seek table of the public seekable
  zstandard format: per frame its compressed size, its size and the lower half of
  its XXH64, so any zstandard reader reads the whole and a seeking reader opens
  only the frames of the documents it wants.

Tasks write under names of their own; the manifest, a table written by Spark,
names the files of the attempts that counted, so a lost executor leaves at most a
file that nothing refers to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize, shared_folder
from .common import importable_on_executors, slices
from .encoding import encoder

FRAME_IDS = 1 << 18

# Magic numbers of the seekable zstandard format.
_SKIPPABLE_DOCUMENTS = 0x184D2A50
_SKIPPABLE_SEEK = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_HAS_CHECKSUMS = 0x80

_FRAME = struct.Struct("<III")
_DOCUMENT = np.dtype([("id", "<i8"), ("ids", "<u8"), ("frames", "<u4")])
_FOOTER = struct.Struct("<IBI")
# In a document's number of frames: it has no id.  Such documents come first.
_NO_ID = 1 << 31
_LEAST_ID = -(1 << 63)


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Write documents one after another to a binary stream."""

    def __init__(self, stream):
        self.stream, self.frames, self.documents = stream, [], []
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.bytes = 0

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        pieces = [ids[k : k + 4 * FRAME_IDS] for k in range(0, len(ids), 4 * FRAME_IDS)] or [b""]
        for piece in pieces:
            packed = self.compress(piece)
            self._write(packed)
            self.frames.append(_FRAME.pack(len(packed), len(piece), _checksum(piece)))
        named = (doc_id, 0) if doc_id is not None else (_LEAST_ID, _NO_ID)
        self.documents.append((named[0], len(ids) // 4, len(pieces) | named[1]))

    def finish(self) -> None:
        table = np.array(self.documents, dtype=_DOCUMENT).tobytes()
        self._write(struct.pack("<II", _SKIPPABLE_DOCUMENTS, len(table)) + table)
        self.frames.append(_FRAME.pack(len(table) + 8, 0, _checksum(b"")))
        entries = b"".join(self.frames)
        self._write(struct.pack("<II", _SKIPPABLE_SEEK, len(entries) + _FOOTER.size))
        self._write(entries + _FOOTER.pack(len(self.frames), _HAS_CHECKSUMS, _SEEKABLE))


class Reader:
    """Read chosen documents of a seekable binary stream of a given size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEKABLE or flags != _HAS_CHECKSUMS:
            raise ValueError("not a token file")
        entries = self._at(size - _FOOTER.size - n * _FRAME.size, n * _FRAME.size)
        self.frames = np.frombuffer(entries, dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        table = self._at(int(self.offsets[n - 1]), int(self.frames[n - 1, 0]))
        self.documents = np.frombuffer(table[8:], dtype=_DOCUMENT)
        self.nameless = int((self.documents["frames"] >= _NO_ID).sum())
        self.first = np.concatenate([[0], np.cumsum(self.documents["frames"] & (_NO_ID - 1), dtype=np.int64)])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        data = self.stream.read(length)
        if len(data) != length:
            raise ValueError("the token file is cut off")
        return data

    def ids(self, document: int) -> bytes:
        """The ids of the document at a place in the file; reads its frames only."""
        out = []
        for k in range(int(self.first[document]), int(self.first[document + 1])):
            packed, size, checksum = (int(v) for v in self.frames[k])
            data = self.decompress(self._at(int(self.offsets[k]), packed), max_output_size=size or 1)
            if len(data) != size or _checksum(data) != checksum:
                raise ValueError(f"frame {k} is damaged")
            out.append(data)
        return b"".join(out)

    def places(self, doc_id: int) -> range:
        """The places of a document id."""
        known = self.documents["id"][self.nameless :]
        low, high = np.searchsorted(known, doc_id), np.searchsorted(known, doc_id, side="right")
        return range(self.nameless + int(low), self.nameless + int(high))

    def names(self) -> list[int | None]:
        """The ids of all documents, None for those without one."""
        return [None] * self.nameless + self.documents["id"][self.nameless :].tolist()


def write_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    id_column: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    files: int | None = None,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Encode every text, write the token files and return their manifest.

    Documents are in ascending order of id within and across files; rows of equal
    id are ordered by a hash of their text; rows without an id come first and can be
    read with all others, not by id.  Null and empty texts hold the end id only.  The
    manifest has one row per file: ``part`` (order of files), ``file``,
    ``first_id``, ``last_id``, ``documents``, ``ids``, ``bytes``, ``start`` (ids in
    all files before).  ``files`` defaults to the session's shuffle partitions.
    Other columns are ignored.  An empty table writes no file.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    folder = folder or f"{shared_folder(spark)}/castsieve/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("_id"),
        F.col(f"`{text}`").alias("_text"),
        F.xxhash64(f"`{text}`").alias("_tie"),
    )
    ordered = rows.repartitionByRange(files, "_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")

    def write(batches):
        encode = encoder(tokenizer, tokenizer_path).encode
        end = struct.pack("<I", end_id)
        part, writer, first, last, n_ids = TaskContext.get().partitionId(), None, None, None, 0
        for values in slices(batches):
            if writer is None:
                fs, base = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(stream)
            for doc_id, ids in zip(values["_id"], encode(values["_text"])):
                writer.add(doc_id, ids + end)
                n_ids += len(ids) // 4 + 1
                first, last = doc_id if first is None else first, doc_id
        if writer is not None:
            writer.finish()
            stream.close()
            row = [part, f"{folder}/{name}", first, last, len(writer.documents), n_ids, writer.bytes]
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(_MANIFEST, row)})

    schema = "part long, file string, first_id long, last_id long, documents long, ids long, bytes long"
    manifest = materialize(ordered.mapInArrow(write, schema), "manifest")
    # One row per file: small enough for one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


_MANIFEST = ("part", "file", "first_id", "last_id", "documents", "ids", "bytes")


def _open(file: str, size: int) -> Reader:
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    return Reader(fs.open_input_file(path), size)


def _emit(rows: Iterator[tuple[int, int, bytes]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for doc_id, start, ids in rows:
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
        held += len(ids) if with_ids else 0
        if len(out) >= 10_000 or held > 8 << 20:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(rows[0])]
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """All documents of the files: ``doc_id``, ``start`` (ids of all documents before),
    ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` as bytes.  Checksums are verified."""
    importable_on_executors(manifest.sparkSession)

    def read(batches):
        def rows():
            for values in slices(batches):
                for file, size, start in zip(values["file"], values["bytes"], values["start"]):
                    reader = _open(file, size)
                    starts = accumulate(reader.documents["ids"].tolist(), initial=start)
                    for place, (doc_id, begin) in enumerate(zip(reader.names(), starts)):
                        yield doc_id, begin, reader.ids(place)

        yield from _emit(rows(), with_ids)

    files = manifest.select("file", "bytes", "start", "part")
    spread = files.repartitionByRange(max(1, manifest.count()), "part").drop("part")
    return spread.mapInArrow(read, _DIGEST + (", ids binary" if with_ids else ""))


def read_documents(manifest: DataFrame, wanted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Chosen documents with their ids; only their frames are read.

    ``wanted`` holds ids, each read once however often it stands there; unknown ids
    give no row.  The manifest, one row per file, is broadcast.
    """
    importable_on_executors(manifest.sparkSession)
    files = F.broadcast(manifest.select("file", "bytes", "start", "first_id", "last_id"))
    asked = wanted.select(F.col(id_column).cast("long").alias("_id")).distinct()
    placed = asked.join(files, F.col("_id").between(F.col("first_id"), F.col("last_id")))
    placed = placed.repartition("file", F.floor(F.col("_id") / 4096)).sortWithinPartitions("file", "_id")

    def read(batches):
        def rows():
            at = reader = None
            for values in slices(batches):
                for doc_id, file, size, start in zip(*(values[c] for c in ("_id", "file", "bytes", "start"))):
                    if file != at:
                        at, reader = file, _open(file, size)
                        starts = np.concatenate([[0], np.cumsum(reader.documents["ids"], dtype=np.int64)]) + start
                    for place in reader.places(doc_id):
                        yield doc_id, int(starts[place]), reader.ids(place)

        yield from _emit(rows(), True)

    return placed.select("_id", "file", "bytes", "start").mapInArrow(read, _DIGEST + ", ids binary")
