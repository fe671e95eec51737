"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Patterns are windows of 10 consecutive words of a benchmark item (an item of
fewer words is one window).  The search runs over words: a table gives for the
last block of two words how far the next possible match can be, so most
positions are never looked at.  Where the shift is 0, a bucket chosen by the hash
of the window's last and first block holds the windows that may end there; their
words are compared by hash, and what remains byte by byte.

The search goes over many documents at a time: positions are dealt to lanes that
move on independently, in array operations.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import materialize
from .common import importable_on_executors, parts, slices, whole_text
from .hashing import LETTERS_DIGITS, Words, mix, words

WINDOW = 10
# Texts of benchmark items searched for at once; more are searched in turns.
PATTERN_BYTES = 16 << 20
# The largest shift table, as a power of two; beyond it fewer positions are skipped, none is missed.
MOST_BITS = 25
_LANES = 1024


class _Patterns:
    """Search tables for windows of one length, given by the item word that each begins with.

    Windows of the same words are one class.  Tables hold numbers only: the words
    themselves stay where they are in the items.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, length: int):
        self.item_hashes, self.length = hashes, length
        self.block = min(2, length)
        whole = np.full(len(starts), length, dtype=np.uint64)
        for k in range(length):
            whole = mix(whole * np.uint64(3) + hashes[starts + k])
        order = np.argsort(whole, kind="stable")
        self.members, whole = starts[order].astype(np.int32), whole[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        for k in range(length):
            own = hashes[self.members + k]
            new[1:] |= own[1:] != own[:-1]
        del whole, order
        first = np.flatnonzero(new)
        reps = self.members[first]
        self.bits = min(MOST_BITS, max(12, math.ceil(math.log2(8 * len(reps) * (length - self.block + 1)))))
        self.shift = np.full(1 << self.bits, min(length - self.block + 1, 255), dtype=np.uint8)
        for after in range(length - self.block + 1):
            value = self._block(hashes, reps + (length - 1 - after))
            np.minimum.at(self.shift, self._slot(value), np.uint8(min(after, 255)))
        keys = self._key(self._block(hashes, reps + length - 1), self._block(hashes, reps + self.block - 1))
        order = np.argsort(keys, kind="stable")
        self.keys, self.reps = keys[order], reps[order]
        # Members of class c: self.members[low[c]:high[c]].
        self.low, self.high = first[order].astype(np.int32), np.append(first[1:], len(starts))[order].astype(np.int32)

    def _block(self, hashes: np.ndarray, end) -> np.ndarray:
        if self.block == 1:
            return mix(hashes[end])
        return mix(hashes[end - 1] * np.uint64(3) + hashes[end])

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return mix(last + np.uint64(5) * first)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of all places where a window's hashes stand."""
        none = np.empty(0, dtype=np.int64)
        n = len(hashes) - self.length + 1
        if n <= 0:
            return none, none
        lanes = min(_LANES, n)
        bounds = self.length - 1 + np.arange(lanes + 1) * n // lanes
        at, stop = bounds[:-1].copy(), bounds[1:]
        ends = []
        while len(at):
            step = self.shift[self._slot(self._block(hashes, at))]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        end = np.concatenate(ends)
        start = end - self.length + 1
        key = self._key(self._block(hashes, end), self._block(hashes, start + self.block - 1))
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        size = high - low
        end = np.repeat(end, size)
        within = np.arange(len(end)) - np.repeat(np.cumsum(size) - size, size)
        window = np.repeat(low, size) + within
        for k in range(self.length):
            same = hashes[end - self.length + 1 + k] == self.item_hashes[self.reps[window] + k]
            end, window = end[same], window[same]
        return end, window


class Matcher:
    """All windows of a set of items.

    Only the items are sent to workers; each builds the tables when it first scans.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.ids, self.texts, self.window = [i for i, _ in items], [t for _, t in items], window
        self._tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    @property
    def tables(self) -> tuple[Words, list[_Patterns]]:
        if self._tables is None:
            found = words(self.texts, LETTERS_DIGITS)
            n = np.diff(found.first)
            lengths = np.minimum(n, self.window)
            searches = []
            for length in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == length)
                count = n[own] - length + 1
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                searches.append(_Patterns(found.hashes, np.repeat(found.first[own], count) + within, length))
            self._tables = found, searches
        return self._tables

    def _owners(self, patterns: _Patterns, window: int) -> list[int]:
        found, _ = self.tables
        starts = patterns.members[patterns.low[window] : patterns.high[window]]
        return np.unique(np.searchsorted(found.first, starts, side="right") - 1).tolist()

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
        """Per text: its number of words, the covered spans of words, the ids of the items found."""
        found = words(texts, LETTERS_DIGITS)
        own, searches = self.tables
        total = len(found.hashes)
        text_of = np.repeat(np.arange(len(texts)), np.diff(found.first))
        edges = np.zeros(total + 1, dtype=np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for patterns in searches:
            owners: dict[int, list[int]] = {}
            ends, windows = patterns.find(found.hashes)
            for end, window in zip(ends.tolist(), windows.tolist()):
                start = end - patterns.length + 1
                if text_of[start] != text_of[end]:
                    continue
                first = int(patterns.reps[window])
                if any(found.text(start + k) != own.text(first + k) for k in range(patterns.length)):
                    continue
                edges[start] += 1
                edges[end + 1] -= 1
                if window not in owners:
                    owners[window] = self._owners(patterns, window)
                items[int(text_of[start])].update(owners[window])
        covered = np.cumsum(edges[:-1]) > 0
        for i in range(len(texts)):
            low, high = int(found.first[i]), int(found.first[i + 1])
            spans = []
            if i in items:
                turns = np.flatnonzero(np.diff(covered[low:high].astype(np.int8), prepend=0, append=0))
                spans = list(zip(turns[0::2].tolist(), turns[1::2].tolist()))
            yield high - low, spans, [self.ids[k] for k in items.get(i, ())]


def _matchers(items: DataFrame, id_column: str, text: str, window: int) -> Iterator[Matcher]:
    """One matcher for every ``PATTERN_BYTES`` of items; without items one that finds nothing."""
    rows = items.select(F.col(id_column).alias("_id"), whole_text(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    turns = size // PATTERN_BYTES + 1
    for turn in range(turns):
        part = rows if turns == 1 else rows.where(F.pmod(F.xxhash64("_id"), F.lit(turns)) == turn)
        yield Matcher([tuple(r) for r in part.toLocalIterator()], window)


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``spans``, ``items``, ``items_sha256``, ``contaminated``.

    ``spans`` are the covered runs of words (from 0, end exclusive), ``items`` the
    ids of the items with an occurring window, sorted as strings.  Null and empty
    texts have no words and are clean, null and empty items are never found, equal
    items are found together.  Repeated rows each get their own result.  Other
    columns are ignored, whatever their names.  An empty table gives an empty
    result; without items every document is clean.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    narrow = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    matchers = _matchers(items, item_id, item_text, window)
    matcher, more = next(matchers), next(matchers, None)
    if more is not None:
        # The same rows meet every matcher; number them for the merge.
        narrow = materialize(narrow.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    else:
        narrow = narrow.withColumn("_row", F.lit(0).cast("long"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"_row long, _id {kind}, n_words long, n_hit long, "
        "spans array<struct<first:long,end:long>>, items array<string>"
    )

    def scanned(matcher: Matcher) -> DataFrame:
        shared = spark.sparkContext.broadcast(matcher)

        def scan(batches):
            for rows in slices(batches):
                out = {"_row": rows["_row"], "_id": rows["_id"], "n_words": [], "n_hit": [], "spans": [], "items": []}
                for n, spans, found in shared.value.scan(rows["_text"]):
                    out["n_words"].append(n)
                    out["n_hit"].append(sum(b - a for a, b in spans))
                    out["spans"].append([{"first": a, "end": b} for a, b in spans])
                    out["items"].append(sorted(str(i) for i in found))
                yield pa.RecordBatch.from_pydict(out, schema=_arrow_schema(batch_id))

        batch_id = to_arrow_type(docs.schema[id_column].dataType)
        return narrow.mapInArrow(scan, schema)

    result = scanned(matcher)
    if more is not None:
        turns = result.unionByName(scanned(more))
        for other in matchers:
            turns = turns.unionByName(scanned(other))
        result = _merged(turns)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return result.select(
        F.col("_id").alias(id_column),
        "n_words",
        "n_hit",
        "spans",
        "items",
        digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _arrow_schema(id_type: pa.DataType) -> pa.Schema:
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.schema(
        [("_row", pa.int64()), ("_id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()),
         ("spans", spans), ("items", pa.list_(pa.string()))]
    )


def _merged(turns: DataFrame) -> DataFrame:
    """Results of several turns over the same rows as one: spans united, items joined."""
    both = turns.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def united(done, span):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < span["first"])
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(apart, F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        )

    empty = F.array().cast("array<struct<first:bigint,end:bigint>>")
    spans = F.aggregate("_spans", empty, united)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return both.withColumn("spans", spans).withColumn("n_hit", hit)


def without_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    spark = docs.sparkSession
    importable_on_executors(spark)
    place = docs.columns.index(text)

    def dropping(shared):
        def keep(batches):
            for batch in batches:
                for part in parts(batch):
                    clean = [not spans for _, spans, _ in shared.value.scan(part.column(place).to_pylist())]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return keep

    kept = docs
    for matcher in _matchers(items, item_id, item_text, window):
        kept = kept.mapInArrow(dropping(spark.sparkContext.broadcast(matcher)), docs.schema)
    return kept
