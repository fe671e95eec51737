"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells.  Every shard owns ``VIRTUAL_NODES`` of them as its
points; a row lies at the hash of its text, so equal texts lie together, and
belongs to the next point clockwise.  Loads are bounded: shards hold
``rows / shards`` rows, the first ones one more where this leaves a rest.  Rows
that find a shard full go on clockwise to the next point whose shard has room.

The course of a row depends only on how many rows each arc between two points
holds.  So the flow is worked out once on the counts of the cells (at most 65,536
numbers, whatever the input): each arc gets a few intervals of ranks, each with a
shard and a first slot.  Rows are then numbered along the ring by one range
shuffle, which splits a place that holds a third of all rows by id, and look up
their interval by cell.  All work on rows is column work.
"""

from __future__ import annotations

import bisect
import zlib
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import renumber
from ..workspace import materialize
from .common import crc32, whole_text

VIRTUAL_NODES = 64
CELLS = 1 << 16


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all points, in ring order; no two in one cell."""
    if not 1 <= shards * virtual_nodes <= CELLS // 2:
        raise ValueError(f"shards * virtual_nodes must be from 1 to {CELLS // 2}")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            cell = zlib.crc32(f"shard {shard} node {node}".encode()) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def flow(counts: list[int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, end rank, shard, first slot).

    Round by round, rows at a point enter its shard as far as it has room, rows
    that have come less far first, and the rest moves one point on.
    """
    n = len(points)
    room, slots = list(capacity), [0] * len(capacity)
    # At each point: the (arc, first rank, end rank) that wait there.
    waiting: list[list[tuple[int, int, int]]] = [[(arc, 0, counts[arc])] if counts[arc] else [] for arc in range(n)]
    intervals = []
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for point in range(n):
            shard = points[point][1]
            for arc, low, high in waiting[point]:
                take = min(room[shard], high - low)
                if take:
                    intervals.append((arc, low, low + take, shard, slots[shard]))
                    room[shard] -= take
                    slots[shard] += take
                if low + take < high:
                    onward[(point + 1) % n].append((arc, low + take, high))
        waiting = onward
    return intervals


def shard_rows(
    docs: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    The numbers of rows of any two shards differ by one at most; slots run from 0
    without gaps.  Equal texts share a shard as far as it has room.  ``size`` is
    the bytes of the text plus 1.  Null and empty texts lie on one place of the
    ring, null counted as empty.  Rows with equal text and id are interchangeable.
    Null ids come first on their place.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    value = whole_text(text)
    place = F.xxhash64(value)
    rows = materialize(
        docs.select(
            F.col(id_column).alias("_id"),
            (F.octet_length(value).cast("long") + 1).alias("size"),
            crc32(value).alias("text_crc32"),
            place.alias("_place"),
            F.shiftrightunsigned(place, 48).cast("int").alias("_cell"),
        ),
        "ring",
    )
    cells = dict(rows.groupBy("_cell").count().collect())
    lookup = spark.createDataFrame(
        _placement(cells, points, shards) or [(0, 0, 0, 0, 0)],
        "_cell int, _low long, _high long, shard int, _slot long",
    )
    order = [F.asc(c) for c in ("_cell", "_place", "_id", "size", "text_crc32")]
    ranked = renumber(rows, *order, id_column="_rank").withColumnRenamed("_cell", "_at")
    within = (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    return ranked.join(F.broadcast(lookup), (F.col("_at") == F.col("_cell")) & within).select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_low")).alias("slot"),
    )


def _placement(
    cells: dict[int, int], points: list[tuple[int, int]], shards: int
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot), ranks counted around the whole ring."""
    total = sum(cells.values())
    capacity = [total // shards + (shard < total % shards) for shard in range(shards)]
    ordered = sorted(cells)
    starts = dict(zip(ordered, accumulate((cells[c] for c in ordered), initial=0)))
    places = [cell for cell, _ in points]
    # Pieces of an arc in ring order; cells beyond the last point come first in
    # the first arc, which wraps around.
    arcs: list[list[int]] = [[] for _ in points]
    for cell in sorted(cells, key=lambda c: (c <= places[-1], c)):
        arcs[bisect.bisect_left(places, cell) % len(points)].append(cell)
    flows: list[list[tuple[int, int, int, int]]] = [[] for _ in points]
    for arc, low, high, shard, slot in flow([sum(cells[c] for c in arc) for arc in arcs], points, capacity):
        flows[arc].append((low, high, shard, slot))
    rows = []
    for own, intervals in zip(arcs, flows):
        before = 0
        for cell in own:
            after = before + cells[cell]
            for low, high, shard, slot in intervals:
                first, end = max(low, before), min(high, after)
                if first < end:
                    base = starts[cell] - before
                    rows.append((cell, base + first, base + end, shard, slot + first - low))
            before = after
    return rows
