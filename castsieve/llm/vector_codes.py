"""Short codes for vectors: product quantisation on integers by value dictionaries.

A vector's components become integers, and the vector is cut into equal parts; every
part is replaced by the number of the nearest entry in the codebook of its position.

Vectors are stored once in blocks of ``BLOCK_ROWS`` rows.  A block keeps, for every
dimension, the dictionary of its distinct integers and one short number per row.  A
round tabulates, per dimension, the squared differences of all dictionary values to
all entries; the distance of a part to every entry is then a sum of looked-up table
rows, without a multiplication per vector.  Dictionaries belong to blocks, so their
size has a bound whatever the values are.

Every round is one pass over the blocks: tasks add up their parts per entry, Spark
adds up the tasks, and only the new entries reach the driver (parts x entries rows).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize, release
from .common import importable_on_executors

# Rows whose dictionaries are kept together; numbers of values fit into 16 bits.
BLOCK_ROWS = 8192
# Rows whose distances are added up at a time.
_STEP_ROWS = 1024


def is_finite(vector: str) -> Column:
    """Whether a vector is there and has only finite components."""
    good = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.col(vector).isNotNull() & good


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """A column of equally long vectors as integers floor(scale * x), as floats."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values.astype(np.float64) * scale).reshape(len(column), len(values) // max(1, len(column)))


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all decimal integers in that order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        return [int(x) for part, k in enumerate(bytes.fromhex(code)) for x in self.entries[part, k]]


class Block:
    """Rows by dictionary: the values of every dimension and one number per row and dimension."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, rows: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in rows.T]
        codes = np.array([c for _, c in found], dtype=np.uint16).reshape(len(found), len(rows))
        return cls([v.astype(np.int64) for v, _ in found], codes)

    @classmethod
    def read(cls, n: int, values: bytes, ends: bytes, codes: bytes) -> Block:
        ends = np.frombuffer(ends, np.int64)
        split = np.split(np.frombuffer(values, np.int64), ends[:-1]) if len(ends) else []
        return cls(split, np.frombuffer(codes, np.uint16).reshape(len(ends), n))

    def written(self) -> tuple[bytes, bytes, bytes]:
        values = np.concatenate([*self.values, np.zeros(0, np.int64)])
        ends = np.cumsum([len(v) for v in self.values], dtype=np.int64)
        return values.tobytes(), ends.tobytes(), self.codes.tobytes()

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and row: the nearest entry, the lower number among equals, and its squared distance."""
        parts, entries, width = books.shape
        n = self.codes.shape[1]
        best, distance = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
        if not width:
            return best, distance
        largest = max(int(np.abs(books).max()), *(int(np.abs(v).max()) for v in self.values if len(v)), 0)
        kind = np.int32 if width * (2 * largest) ** 2 < 1 << 31 else np.int64
        picked = np.empty((_STEP_ROWS, entries), kind)
        for part in range(parts):
            tables = [
                ((self.values[d][:, None] - books[part, :, d - part * width]) ** 2).astype(kind)
                for d in range(part * width, (part + 1) * width)
            ]
            for start in range(0, n, _STEP_ROWS):
                codes = self.codes[part * width : (part + 1) * width, start : start + _STEP_ROWS]
                total = tables[0][codes[0]]
                some = picked[: len(total)]
                for table, code in zip(tables[1:], codes[1:]):
                    np.take(table, code, axis=0, out=some, mode="clip")
                    total += some
                least = total.argmin(axis=1)
                best[part, start : start + len(total)] = least
                distance[part, start : start + len(total)] = total[np.arange(len(total)), least]
        return best, distance

    def sums(self, best: np.ndarray, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows per part and entry, and the sums of their components."""
        parts = len(best)
        counts = np.array([np.bincount(b, minlength=entries) for b in best])
        sums = np.zeros((parts, entries, width), np.int64)
        for part in range(parts):
            for k in range(width):
                # Exact in floats: a block's sums stay far below 2^53.
                x = self.values[part * width + k][self.codes[part * width + k]]
                sums[part, :, k] = np.bincount(best[part], x, entries).astype(np.int64)
        return counts, sums


class StoredVectors:
    """The kept vectors of a table in blocks, written to the shared folder."""

    def __init__(self, vectors: DataFrame, id_column: str, vector: str, label: str, parts: int, scale: int):
        importable_on_executors(vectors.sparkSession)
        rows = vectors.where(is_finite(f"`{vector}`")).select(
            F.col(f"`{id_column}`").alias("id"),
            F.col(f"`{label}`").alias("label"),
            F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        )
        sizes = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        size = sizes[0] or 0
        if sizes[0] != sizes[1] or size % parts:
            raise ValueError(f"vectors need one length that is a multiple of {parts}: found {sizes[0]} to {sizes[1]}")
        self.parts, self.width, self.scale = parts, size // parts, scale
        self.id_type, self.label_type = (rows.schema[c].dataType for c in ("id", "label"))
        # Distances and sums fit into 64 bits below this.
        limit = min(1 << 28, math.isqrt((1 << 62) // max(1, self.width)) // 2)
        self.first = rows

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, column in _gathered(batches):
                values = matrix(column, scale)
                if values.size and np.abs(values).max() > limit:
                    raise ValueError(f"components beyond {limit / scale:g} are not supported")
                made = Block.of(values).written()
                whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
                fields = [pa.array([len(ids)], pa.int32()), *whole, *(pa.array([m], pa.binary()) for m in made)]
                yield pa.RecordBatch.from_arrays(fields, names=["n", "ids", "labels", "values", "ends", "codes"])

        kinds = [f"array<{t.simpleString()}>" for t in (self.id_type, self.label_type)]
        schema = f"n int, ids {kinds[0]}, labels {kinds[1]}, values binary, ends binary, codes binary"
        self.blocks = materialize(rows.mapInArrow(blocks, schema), "blocks")

    def smallest(self, entries: int) -> Codebooks:
        """The parts of the vectors with the smallest ids, null ids last, equal ids by vector."""
        taken = self.first.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
        values = np.floor(np.array([r.vector for r in taken], dtype=np.float64).reshape(len(taken), self.parts * self.width) * self.scale)
        parts = values.astype(np.int64).reshape(len(taken), self.parts, self.width)
        return Codebooks(np.ascontiguousarray(parts.transpose(1, 0, 2)))

    def improved(self, books: Codebooks) -> Codebooks:
        """Every entry as the floored mean of the parts nearest to it; unused entries stay."""
        entries = books.entries
        parts, size, width = entries.shape

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
            for block in _read(batches):
                best, _ = block.nearest(entries)
                n, s = block.sums(best, size, width)
                counts += n
                sums += s
            part, entry = np.nonzero(counts)
            found = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
            arrays = [pa.array(x) for x in found] + [pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

        rows = self.blocks.select("n", "values", "ends", "codes")
        found = rows.mapInArrow(partial, "part int, entry int, n long, sums array<long>")
        total = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")
        )
        after = entries.copy()
        for row in total.collect():
            after[row.part, row.entry] = [s // row.n for s in row.sums]
        return Codebooks(after)

    def encoded(self, books: Codebooks) -> DataFrame:
        """``id``, ``label``, ``code`` and ``error`` of every stored vector."""
        entries = books.entries
        kinds = [t.simpleString() for t in (self.id_type, self.label_type)]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns))
                for k, block in enumerate(_read([batch])):
                    best, distance = block.nearest(entries)
                    text, step = np.ascontiguousarray(best.T.astype(np.uint8)).tobytes().hex(), 2 * len(best)
                    codes = [text[i : i + step] for i in range(0, len(text), step)]
                    own = [columns[c].slice(k, 1).flatten() for c in ("ids", "labels")]
                    made = [*own, pa.array(codes, pa.string()), pa.array(distance.sum(axis=0))]
                    yield pa.RecordBatch.from_arrays(made, names=["id", "label", "code", "error"])

        return self.blocks.mapInArrow(encode, f"id {kinds[0]}, label {kinds[1]}, code string, error long")

    def release(self) -> None:
        release(self.blocks)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of a partition's rows, ``BLOCK_ROWS`` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK_ROWS - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == BLOCK_ROWS:
                yield [pa.concat_arrays([b.column(c) for b in held]) for c in range(3)]
                held, n = [], 0
    if n:
        yield [pa.concat_arrays([b.column(c) for b in held]) for c in range(3)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for k in range(batch.num_rows):
            yield Block.read(*(columns[c][k].as_py() for c in ("n", "values", "ends", "codes")))


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors and the codebooks they refer to.

    The rows have the id and label columns, ``code`` (two hex digits per part) and
    ``error`` (squared distances of all parts to their entries).  Rows whose vector
    is null or has a null or non-finite component are left out; null ids and labels
    are kept.  Codebooks start as the parts of the ``entries`` smallest ids (all, if
    there are fewer); null ids come last, rows of equal id in the order of their
    vectors.  Repeated rows count each.  All vectors need one length, a multiple of
    ``parts``, and components within about 2^28 / ``scale``, else it is a ValueError.
    Other columns are ignored, whatever their names.  An empty table gives an empty
    result and codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    stored = StoredVectors(vectors, id_column, vector, label, parts, scale)
    books = stored.smallest(entries)
    if books.entries.size:
        for _ in range(rounds):
            books = stored.improved(books)
    codes = materialize(stored.encoded(books), "codes")
    stored.release()
    return codes.select(F.col("id").alias(id_column), F.col("label").alias(label), "code", "error"), books


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the error of all rows of the same label, null labels together."""
    totals = codes.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(totals, F.col(label).eqNullSafe(F.col("_label")))
    return joined.drop("_label")


def comparison_sql() -> str:
    """The same on whole tables of vectors with different ids, with all distances worked out."""
    steps = [
        """v as materialized (
    select vec_id, label, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as q
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
        """p as materialized (
    select vec_id, part, pos, q[part * (len(q) // 4) + pos + 1] as x
    from v, range(4) as r(part), range(1 << 16) as s(pos) where pos < len(q) // 4)""",
        """b0 as materialized (
    select part, entry, pos, x
    from p join (select vec_id, row_number() over (order by vec_id) - 1 as entry from v) using (vec_id)
    where entry < 256)""",
    ]
    for k in range(5):
        steps.append(f"""a{k} as materialized (
    select vec_id, part, min(d * 256 + entry) as best
    from (select vec_id, p.part, entry, cast(sum((p.x - b.x) * (p.x - b.x)) as bigint) as d
          from p join b{k} as b on p.part = b.part and p.pos = b.pos group by all)
    group by all)""")
        if k < 4:
            steps.append(f"""b{k + 1} as materialized (
    select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x
    from b{k} as b left join (
        select part, best % 256 as entry, pos, cast(floor(sum(x) / count(*)) as bigint) as x
        from a{k} join p using (vec_id, part) group by all) as m
    on b.part = m.part and b.entry = m.entry and b.pos = m.pos)""")
    return f"""
with {', '.join(steps)},
e as (
    select vec_id, label, string_agg(printf('%02x', best % 256), '' order by part) as code,
           cast(sum(best // 256) as bigint) as error
    from a4 join v using (vec_id) group by all)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) from b4) as codebooks_sha256
from e
"""
