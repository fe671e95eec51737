"""Log-likelihood of whole texts by a gated recurrent model and by word counts.

Tokens are the words of a text, A-Z lower-cased, and one end.  All words of all
texts that are learned from are counted; the counts stay a table as large as the
vocabulary.  The ``LISTED`` most frequent words go to every worker, the counts of
the others are joined by word.

The recurrent model (``gated_model``) knows the ``WORDS`` most frequent words; all
others are one word to it, whose probability is shared among them by their counts:
one share more than its count for each, and one for all words never seen.  So the
probabilities of all words add up to one.

Training is spread over the cluster: in every round each task trains on its own
texts, starting from the same parameters, and the mean of all tasks' parameters,
by words seen, starts the next round.  A round takes one of ``ROUNDS`` parts of the
texts, dealt by a hash, so every text is learned from once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize, release
from .common import importable_on_executors, kept_columns, parts, slices
from .gated_model import GatedModel
from .hashing import SPACED, words

# Words the recurrent model knows, two of them "any other" and "end".
WORDS = 4096
OTHER, END = 0, 1
# Words whose counts every worker holds, 16 bytes each.
LISTED = 1 << 16
# Rounds of training, each on its part of all texts.
ROUNDS = 4
RATE = 0.2
# Words worked on at a time, and parts in which parameters are added up.
CHUNK_WORDS = 1 << 20
PIECES = 16
# Stands for the end of a text among the hashes of words.
_END_KEY = np.int64(0)
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 7, is 2; never those without id."""
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % 7
    return F.coalesce(rest == 2, F.lit(False))


@dataclass
class Vocabulary:
    """The listed words in the order of their hashes, and sums over all words."""

    keys: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @classmethod
    def of(cls, listed: list[tuple[int, int]], tokens: int, distinct: int, ends: int) -> Vocabulary:
        """``listed``: hash and count, the most frequent first, without the end."""
        found = sorted((key, n, OTHER if k >= WORDS - 2 else k + 2) for k, (key, n) in enumerate(listed))
        arrays = [np.array(x, dtype=t) for x, t in zip(zip(*found), (np.int64, np.int64, np.int32))] if found else [
            np.zeros(0, t) for t in (np.int64, np.int64, np.int32)
        ]
        return cls(*arrays, tokens, distinct, ends)

    @property
    def total(self) -> int:
        """What the shares of all words, one for every count and one more each, add up to."""
        return self.tokens + self.distinct + 1

    @property
    def others(self) -> int:
        """The part of ``total`` that words unknown to the model have."""
        known = self.numbers != OTHER
        return self.total - int((self.counts[known] + 1).sum()) - (self.ends + 1 if self.ends else 0)

    def known_counts(self) -> np.ndarray:
        """Counts by number of the words that the model knows, and of all others."""
        out = np.zeros(WORDS)
        out[self.numbers] = self.counts
        out[END] = self.ends
        out[OTHER] = 0
        # One for the words never seen.
        out[OTHER] = self.tokens - out.sum() + 1
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in the model and count of every word; -1 for words that are not listed."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.numbers[at], OTHER).astype(np.int32), np.where(there, self.counts[at], -1)


@dataclass
class Fitted:
    """The counts of all words (``key``, ``n``), the listed ones, and the recurrent model."""

    counts: DataFrame
    vocabulary: Vocabulary
    model: GatedModel


def _hashed(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's begin."""
    found = words(values, SPACED)
    return found.hashes.view(np.int64), found.first


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Fitted:
    """Count all words of ``docs`` and train on its texts; null texts are empty ones.

    Without rows, nothing is known and every word is a new one.  Ids only help to
    deal texts to rounds.  Training adds up numbers in the order in which tasks end,
    so two runs may differ in the last digits of a score.
    """
    importable_on_executors(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text}`")).alias("_hash"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for values in slices(batches):
            keys, _ = _hashed(values["_text"])
            held.append(np.unique(keys, return_counts=True))
            size, ends = size + len(held[-1][0]), ends + len(values["_text"])
            if size > CHUNK_WORDS:
                merged = _merged(held)
                # What a chunk cannot make smaller goes on, so memory stays bounded.
                if len(merged[0]) > CHUNK_WORDS // 2:
                    yield _counts(*merged)
                    merged = (merged[0][:0], merged[1][:0])
                held, size = [merged], len(merged[0])
        keys, n = _merged(held)
        yield _counts(np.append(keys, _END_KEY), np.append(n, ends))

    counts = texts.select("_text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 0"), "words")
    tokens, distinct, ends = counts.agg(F.sum("n"), F.count("n"), F.sum(F.when(F.col("key") == int(_END_KEY), F.col("n")))).first()
    top = counts.where(F.col("key") != int(_END_KEY)).orderBy(F.col("n").desc(), "key").limit(LISTED).collect()
    vocabulary = Vocabulary.of([(r.key, r.n) for r in top], tokens or 0, distinct or 0, ends or 0)
    model = GatedModel(WORDS, vocabulary.known_counts(), END)
    for number in range(ROUNDS):
        part = texts.where(F.pmod("_hash", F.lit(ROUNDS)) == number).select("_text")
        model = _round(part, model, vocabulary)
    return Fitted(counts, vocabulary, model)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def _round(texts: DataFrame, model: GatedModel, vocabulary: Vocabulary) -> GatedModel:
    """Every task trains on its texts; the mean of their parameters by words seen."""
    shared = texts.sparkSession.sparkContext.broadcast((model, vocabulary))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known = shared.value
        own, squares, seen = start.with_weights(start.weights), start.squares(), 0
        held, size = [], 0
        for values in slices(batches):
            keys, first = _hashed(values["_text"])
            held += [np.append(x, END).astype(np.int32) for x in np.split(known.find(keys)[0], first[1:-1])]
            size += len(keys)
            if size > CHUNK_WORDS:
                seen, held, size = seen + own.train(held, squares, RATE), [], 0
        if held:
            seen += own.train(held, squares, RATE)
        if seen:
            parts = np.array_split(own.weights, PIECES)
            fields = [pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES), pa.array([p.tobytes() for p in parts])]
            yield pa.RecordBatch.from_arrays(fields, names=["piece", "seen", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, seen, weights in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(piece, [0, 0.0])
                held[0] += seen
                held[1] = held[1] + seen * np.frombuffer(weights, np.float32).astype(np.float64)
        if sums:
            fields = [pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()])]
            fields.append(pa.array([(w / s).astype(np.float32).tobytes() for s, w in sums.values()]))
            yield pa.RecordBatch.from_arrays(fields, names=["piece", "seen", "weights"])

    schema = "piece int, seen long, weights binary"
    # PIECES rows of parameters, whatever the input.
    means = texts.mapInArrow(train, schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect()
    shared.unpersist()
    if not means:
        return model
    parts = [np.frombuffer(bytes(r.weights), np.float32) for r in sorted(means, key=lambda r: r.piece)]
    return model.with_weights(np.concatenate(parts))


def score(docs: DataFrame, fitted: Fitted, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Log10 probabilities of every whole text, with the columns in ``keep``.

    ``n_tokens`` (words and the end), ``n_known`` (those that were learned from),
    ``train_tokens`` (all that were), ``base_score`` (every token by its count plus
    one) and ``score`` (by the recurrent model).  A null or empty text is its end.
    Equal texts get equal scores up to rounding; repeated rows get one each.
    Without ``keep`` all columns of ``docs`` are carried but those named like a
    result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    shared = spark.sparkContext.broadcast((fitted.model, fitted.vocabulary))
    kept = F.struct(*kept_columns(docs, keep, RESULTS))
    rows = docs.select(kept.alias("_kept"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_kept"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        held, texts, sums = [], [], []
        size = 0
        for batch in batches:
            for part in parts(batch):
                keys, first = _hashed(part.column(2).to_pylist())
                numbers, counts = known.find(keys)
                held.append(part.select([0, 1]))
                texts += [np.append(x, END).astype(np.int32) for x in np.split(numbers, first[1:-1])]
                sums.append(_summed(keys, numbers, counts, first, known))
                size += len(keys)
                if size > CHUNK_WORDS:
                    yield _scored(held, texts, sums, model)
                    held, texts, sums, size = [], [], [], 0
        if held:
            yield _scored(held, texts, sums, model)

    schema = f"_kept {kind}, _row long, n long, known long, base double, model double, keys array<long>, times array<int>"
    found = materialize(rows.mapInArrow(look, schema), "scored")
    v = fitted.vocabulary
    # Words that are not listed, met with their counts.
    rare = found.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("_row", "w.keys", "w.times")
    rare = rare.join(fitted.counts.withColumnRenamed("key", "keys"), "keys", "left").groupBy("_row").agg(
        F.sum(F.col("times").cast("long")).alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times").cast("long")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("shares"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    return found.join(rare, "_row", "left").select(
        "_kept.*",
        F.col("n").alias("n_tokens"),
        (F.col("known") + none("rare_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("shares") - none("rare") * float(np.log10(v.total))).alias("base_score"),
        (F.col("model") + none("shares") - none("rare") * float(np.log10(max(1, v.others)))).alias("score"),
    )


def _summed(keys, numbers, counts, first, known: Vocabulary) -> dict[str, list]:
    """Per text: what the listed words add to the scores, and the words that are not listed."""
    there = counts >= 0
    share = np.log10(np.maximum(counts, 0) + 1.0)
    base = np.where(there, share - np.log10(known.total), 0.0)
    extra = np.where(there & (numbers == OTHER), share - np.log10(max(1, known.others)), 0.0)
    end = np.log10((known.ends + 1) / known.total)
    add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    found = {"n": np.diff(first) + 1, "known": add(there.astype(np.int64)) + (known.ends > 0)}
    found |= {"base": add(base) + end, "extra": add(extra), "keys": [], "times": []}
    for a, b in zip(first[:-1], first[1:]):
        rare, times = np.unique(keys[a:b][~there[a:b]], return_counts=True)
        found["keys"].append(rare)
        found["times"].append(times.astype(np.int32))
    return found


def _scored(held: list[pa.RecordBatch], texts: list[np.ndarray], sums: list[dict], model: GatedModel) -> pa.RecordBatch:
    columns = {c: np.concatenate([s[c] for s in sums]) for c in ("n", "known", "base", "extra")}
    total = model.score(texts) / np.log(10) + columns["extra"]
    lists = [[x for s in sums for x in s[c]] for c in ("keys", "times")]
    arrays = [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]
    arrays += [pa.array(columns[c]) for c in ("n", "known", "base")] + [pa.array(total)]
    arrays += [pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["_kept", "_row", "n", "known", "base", "model", "keys", "times"])


def forget(fitted: Fitted) -> None:
    """Remove the table of counts when all scores are saved."""
    release(fitted.counts)
