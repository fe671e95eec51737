"""Pieces of documents packed into sequences by a configuration linear program.

A document's tokens are cut into pieces of the sequence length at most.  Packing
depends only on how many pieces have each length, a histogram of at most
``length`` numbers whatever the input.  On it:

1. the linear program over configurations (multisets of lengths that fit one
   sequence) is solved by multiplicative weights: every length has a price that
   falls as the length gets covered; a knapsack by dynamic programming finds the
   configuration of the highest price and, for every length, the best one holding
   it; those near the highest price get a share each;
2. shares are rounded down to whole numbers of sequences;
3. what is left of the histogram is filled best-fit: the longest piece opens a
   sequence, and a subset-sum over the lengths left fills it.

Each configuration then owns ranges of ranks of each of its lengths.  Pieces are
numbered by length with one range shuffle, which splits a length that a third of
all pieces share, and look up sequence and offset by length and rank.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ordering import renumber
from ..workspace import materialize
from .common import importable_on_executors, slices
from .encoding import encoder

LENGTH = 2048
# Price updates of the linear program; its size does not depend on the input.
ROUNDS = 60

Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


def cut(
    docs: DataFrame,
    length: int = LENGTH,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 0,
    id_column: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """The pieces of all documents: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``.

    A document is its ids and then ``end_id``; null and empty texts are the end id
    alone.  ``_row`` tells repeated rows apart.  Written once.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_column].dataType)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text).alias("_text")
    )
    names = ["_row", "_id", "piece", "start", "length", "ids_crc32", "ids"]
    types = [pa.int64(), id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def pieces(batches):
        encode = encoder(tokenizer, tokenizer_path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for values in slices(batches):
            out = []
            for row, doc_id, ids in zip(values["_row"], values["_id"], encode(values["_text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((row, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"_row long, _id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return materialize(rows.mapInArrow(pieces, schema), "pieces")


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best price for every capacity and the length taken last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            worth = best[c - lengths[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[c]:
                best[c], last[c] = worth[k], k
    return best, last


def _filled(last: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """The lengths (by place) of the best filling of a capacity."""
    out = []
    while capacity > 0:
        k = last[capacity]
        if k < 0:
            capacity -= 1
        else:
            out.append(int(k))
            capacity -= int(lengths[k])
    return out


def fractional(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Configurations and how many sequences of each, not yet whole, to cover the counts."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(n)] for n in lengths], dtype=float)
    covered = np.zeros(len(lengths))
    shares: dict[Configuration, float] = {}
    for _ in range(rounds):
        # A covered length costs little; its need sets how much one piece matters.
        prices = np.exp(-8 * (covered - covered.min())) * lengths
        best, last = _knapsack(prices, lengths, capacity)
        found: dict[tuple[int, ...], None] = {}
        for k in np.argsort(covered - lengths / capacity, kind="stable"):
            rest = capacity - int(lengths[k])
            if prices[k] + best[rest] >= 0.95 * best[capacity]:
                found[tuple(sorted([int(k), *_filled(last, lengths, rest)], reverse=True))] = None
        step = np.zeros(len(lengths))
        for places in found:
            used, often = np.unique(places, return_counts=True)
            # At most one round's share of any length goes to one round.
            room = ((1.5 / rounds - step[used]).clip(0) * need[used] / often).min()
            if room <= 0:
                continue
            step[used] += often * room / need[used]
            key = tuple((int(lengths[k]), int(n)) for k, n in sorted(zip(used, often), reverse=True))
            shares[key] = shares.get(key, 0.0) + room
        covered += step
        if covered.min() >= 1:
            break
    return shares


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[Configuration, int]]:
    """Whole numbers of sequences per configuration that hold exactly the given pieces."""
    left = {int(n): int(c) for n, c in counts.items() if c}
    out: list[tuple[Configuration, int]] = []

    def use(key: Configuration, times: int) -> None:
        out.append((key, times))
        for n, often in key:
            left[n] -= often * times
            if not left[n]:
                del left[n]

    if capacity in left:
        use(((capacity, 1),), left[capacity])
    # Rounding leaves a part of the pieces; the program is solved for these again
    # as long as it places a good part of them.
    placed = 1.0
    while left and rounds and placed > 0.1:
        before = sum(left.values())
        shares = fractional(left, capacity, rounds)
        # Fullest configurations first, so that over-covered lengths go where they fit best.
        for key, share in sorted(shares.items(), key=lambda x: (-sum(n * k for n, k in x[0]), x)):
            times = min([int(share), *(left.get(n, 0) // often for n, often in key)])
            if times:
                use(key, times)
        placed = 1 - sum(left.values()) / before
    while left:
        key = _best_fit(left, capacity)
        use(key, min(left[n] // often for n, often in key))
    return out


def _best_fit(left: dict[int, int], capacity: int) -> Configuration:
    """The longest piece with the pieces left that fill its sequence best.

    Few long pieces come before many short ones, which stay for later gaps.
    """
    longest = max(left)
    rest = capacity - longest
    lengths = [n for n in sorted(left, reverse=True) if n <= rest]
    chosen = {longest: 1}

    def free(n: int) -> int:
        return left[n] - chosen.get(n, 0)

    # One piece or two that fill the rest exactly; otherwise the longest that fits, again and again.
    known = set(lengths)
    while rest > 0:
        lengths = [n for n in lengths if n <= rest and free(n) > 0]
        if not lengths:
            break
        pick = [rest] if rest in known and free(rest) > 0 else None
        if pick is None:
            for n in lengths:
                m = rest - n
                if m in known and free(m) > (m == n):
                    pick = [n, m]
                    break
        for n in pick or [lengths[0]]:
            chosen[n] = chosen.get(n, 0) + 1
            rest -= n
    return tuple(sorted(chosen.items(), reverse=True))


def pack(pieces: DataFrame, length: int = LENGTH, keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece of ``cut``.

    Every sequence holds at most ``length`` tokens from offset 0 without gaps, and
    every piece is in one.  Pieces of equal length are interchangeable.  ``keep``
    are the columns to carry, by default all but the ids.  An empty table gives an
    empty result.
    """
    spark = pieces.sparkSession
    keep = keep or [c for c in pieces.columns if c != "ids"]
    counts = dict(pieces.groupBy("length").count().collect())
    starts = dict(zip(sorted(counts), accumulate((counts[n] for n in sorted(counts)), initial=0)))
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for key, times in configurations(counts, length, rounds):
        offset = 0
        for n, often in key:
            low = starts[n] + taken[n]
            rows.append((n, low, low + often * times, sequence, often, offset))
            taken[n] += often * times
            offset += n * often
        sequence += times
    lookup = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 1, 0)], "_length long, _low long, _high long, _first long, _often long, _offset long"
    )
    narrow = [*dict.fromkeys([*keep, "length", "_row", "piece"])]
    ranked = renumber(
        pieces.select(*narrow), F.asc("length"), F.asc("_row"), F.asc("piece"), id_column="_rank"
    )
    own = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    within = F.col("_rank") - F.col("_low")
    return ranked.join(F.broadcast(lookup), own).select(
        *keep,
        (F.col("_first") + F.floor(within / F.col("_often"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + within % F.col("_often") * F.col("length")).alias("offset"),
    )


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` (bytes), ``parts`` in order of offset."""
    both = packed.select("_row", "piece", "sequence_id", "offset").join(pieces, ["_row", "piece"])
    part = F.struct("offset", "length", F.col("_id").alias("id"), "piece", "ids")
    return (
        both.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(part)).alias("_parts"))
        .select(
            "sequence_id",
            F.expr("aggregate(_parts, X'', (all, p) -> concat(all, p.ids))").alias("ids"),
            F.transform("_parts", lambda p: p.dropFields("ids")).alias("parts"),
        )
    )
