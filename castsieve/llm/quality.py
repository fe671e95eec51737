"""Text quality by a weak-label model.

Heuristic labellers each say of a text "poor" or nothing.  None is right always
and they overlap.  How often every combination of labels occurs is counted over
all texts (at most 2^9 numbers); expectation-maximisation on these counts
estimates how likely each labeller speaks on poor and on sound texts, and with it
the probability of "poor" for every combination.  These posterior labels train a
linear scorer on hashed features of the text, on a sample of about ``SAMPLE``
texts spread over sure and unsure combinations; the scorer decides on every text.
No given label is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable_on_executors, kept_columns, parts, slices
from .hashing import SPACED, gram_bins, words
from .linear import fit_logistic, probability

# Texts that the scorer is fitted on.
SAMPLE = 4000
BITS = 11
ROUNDS = 200

# Fixed values of this module: what counts as a symbol, and the labellers' limits.
SYMBOLS = b"!#$%&*<=>@[\\]^_`{|}~+"
LABELLERS = {
    "many symbols": ("symbols", 0.015),
    "words with symbols": ("symbol_words", 0.08),
    "few letters": ("other", 0.35),
    "capitals": ("capitals", 0.3),
    "bars": ("bars", 0.05),
    "word repeated at once": ("adjacent", 0.08),
    "few different words": ("sameness", 0.6),
    "lines repeated": ("lines", 0.6),
    "no sentence ends": ("unended", 0.985),
}
# Labellers on ratios stay silent on texts of fewer words.
LEAST_WORDS = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])


def _classes() -> np.ndarray:
    """A small code per byte: kinds of letters together, marks apart."""
    out = np.full(256, 1, dtype=np.uint32)
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 5
    for k, c in enumerate(b" \n.,;:'\"-()?" + SYMBOLS):
        out[c] = 6 + k
    return out


_CLASS = _classes()


@dataclass
class Signals:
    """Per text: number of words, fired labellers as bits, and the measures that are features as well."""

    words: np.ndarray
    fired: np.ndarray
    measures: np.ndarray


def signals(texts: list[str | None]) -> Signals:
    """What the labellers look at, without the hashed features."""
    found = words(texts, SPACED)
    n = np.diff(found.first)
    has_symbol = np.concatenate([[0], np.cumsum(_SYMBOL[found.data], dtype=np.int64)])
    symbol_word = has_symbol[found.ends] > has_symbol[found.starts]
    ends = np.isin(found.data[found.ends - 1], list(b".!?:;|")) if len(found.ends) else np.zeros(0, bool)
    same = np.concatenate([found.hashes[1:] == found.hashes[:-1], [False]]) if len(found.hashes) else np.zeros(0, bool)
    measures = np.zeros((len(texts), 4), dtype=np.float32)
    fired = np.zeros(len(texts), dtype=np.int32)
    for i, text in enumerate(texts):
        low, high = found.first[i], found.first[i + 1]
        if low == high:
            continue
        count = int(n[i])
        seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
        letters = max(1, int(seen[_LETTER].sum()))
        black = max(1, int(seen.sum() - seen[32] - seen[9:14].sum()))
        lines = [line for line in text.split("\n") if line.strip()]
        enough = count >= LEAST_WORDS
        adjacent = float(same[low : high - 1].sum()) / count
        sameness = 1 - len(np.unique(found.hashes[low:high])) / count if enough else 0.0
        value = {
            "symbols": int(seen[_SYMBOL].sum()) / black,
            "symbol_words": symbol_word[low:high].mean(),
            "other": 1 - letters / black if enough else 0.0,
            "capitals": int(seen[65:91].sum()) / letters if enough else 0.0,
            "bars": int(seen[124]) / count,
            "adjacent": adjacent if enough else 0.0,
            "sameness": sameness,
            "lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 5 else 0.0,
            "unended": 1 - ends[low:high].mean() if count >= 3 * LEAST_WORDS else 0.0,
        }
        for bit, (signal, limit) in enumerate(LABELLERS.values()):
            fired[i] |= int(value[signal] > limit) << bit
        measures[i] = (adjacent, sameness, value["lines"], value["symbols"])
    return Signals(n, fired, measures)


def describe(texts: list[str | None]) -> tuple[Signals, np.ndarray]:
    """The signals and the hashed features of texts; no features without words."""
    found = signals(texts)
    features = np.zeros((len(texts), (1 << BITS) + 4), dtype=np.float32)
    for i, text in enumerate(texts):
        if not found.words[i]:
            continue
        codes = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        for k in (2, 3, 4):
            bins = gram_bins(codes, k, BITS)
            if len(bins):
                features[i, : 1 << BITS] += np.bincount(bins, minlength=1 << BITS)
        features[i] = np.sqrt(features[i] / max(1.0, features[i].sum()))
        features[i, 1 << BITS :] = found.measures[i]
    return found, features


@dataclass
class WeakLabels:
    """What expectation-maximisation finds: rates per labeller and the share of poor texts."""

    speaks_on_poor: np.ndarray
    speaks_on_sound: np.ndarray
    share: float

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Probability of "poor" for combinations of labels given as bits."""
        bits = (np.asarray(fired)[:, None] >> np.arange(len(self.speaks_on_poor))) & 1
        poor = np.log(self.share) + np.log(np.where(bits, self.speaks_on_poor, 1 - self.speaks_on_poor)).sum(1)
        sound = np.log(1 - self.share) + np.log(np.where(bits, self.speaks_on_sound, 1 - self.speaks_on_sound)).sum(1)
        return 1 / (1 + np.exp(np.clip(sound - poor, -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller is right when it speaks."""
        poor, sound = self.share * self.speaks_on_poor, (1 - self.share) * self.speaks_on_sound
        return dict(zip(LABELLERS, (poor / (poor + sound)).tolist()))


def estimate(counts: dict[int, int]) -> WeakLabels:
    """Expectation-maximisation on the numbers of texts per combination of labels.

    Starts from "two labellers agree".  Rates are kept within bounds that say what
    a labeller is: it speaks on a sound text in one case of ten at most.
    """
    fired = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(f)] for f in fired], dtype=float)
    bits = ((fired[:, None] >> np.arange(len(LABELLERS))) & 1).astype(float)
    poor = np.clip(bits.sum(1) / 2, 0.01, 0.99)
    for _ in range(ROUNDS):
        weight = n * poor
        rest = n - weight
        model = WeakLabels(
            np.clip((bits.T @ weight + 1) / (weight.sum() + 4), 0.02, 0.98),
            np.clip((bits.T @ rest + 0.01) / (rest.sum() + 1), 1e-5, 0.1),
            float(np.clip(weight.sum() / max(n.sum(), 1), 1e-5, 0.9)),
        )
        after = model.posterior(fired)
        if len(n) and np.abs(after - poor).max() < 1e-9:
            break
        poor = after
    return model


@dataclass
class Scorer:
    labels: WeakLabels
    model: tuple[np.ndarray, np.ndarray]

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Probability of a sound text; 0 without words."""
        found, features = describe(texts)
        return np.where(found.words > 0, 1 - probability(features, self.model)[:, 0], 0.0)


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer:
    """Labellers on all texts, estimation, and the scorer on a sample of texts.

    The sample is chosen by a hash of id and text: half of it from combinations
    more likely poor, half from the others; a half with few texts gives all.
    Should one row be repeated so often that the sample grows beyond twice its
    size, any rows of that number are used.  Texts without words take no part.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    rows = docs.select(F.xxhash64(id_column, text).alias("_hash"), F.col(text).alias("_text"))

    def label(batches):
        for values in slices(batches):
            seen = signals(values["_text"])
            found, times = np.unique(seen.fired[seen.words > 0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"fired": found.astype(np.int32), "n": times.astype(np.int64)})

    counted = rows.select("_text").mapInArrow(label, "fired int, n long").groupBy("fired").agg(F.sum("n"))
    counts = {r[0]: r[1] for r in counted.collect()}
    labels = estimate(counts)
    fired = np.array(sorted(counts), dtype=np.int64)
    poor = dict(zip(fired.tolist(), labels.posterior(fired).tolist())) if counts else {}
    sizes = [sum(n for f, n in counts.items() if (poor[f] > 0.5) == side) for side in (False, True)]
    every = [max(1, 2 * size // sample) for size in sizes]

    def choose(batches):
        for values in slices(batches):
            found, features = describe(values["_text"])
            out = {"_hash": [], "poor": [], "row": []}
            for key, words_, f, row in zip(values["_hash"], found.words, found.fired.tolist(), features):
                if words_ and key % every[poor.get(f, 0.0) > 0.5] == 0:
                    out["_hash"].append(key)
                    out["poor"].append(poor.get(f, 0.0))
                    out["row"].append(row.tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_SAMPLE_SCHEMA)

    # Only texts that one of the halves may take are described.
    may_be_taken = (F.col("_hash") % every[0] == 0) | (F.col("_hash") % every[1] == 0)
    taken = rows.where(may_be_taken).mapInArrow(choose, "_hash long, poor double, row binary").limit(2 * sample).collect()
    taken = sorted((r._hash, r.poor, bytes(r.row)) for r in taken)
    width = (1 << BITS) + 4
    matrix = np.frombuffer(b"".join(row for _, _, row in taken), dtype=np.float32).reshape(len(taken), width)
    if not taken:
        return Scorer(labels, (np.zeros((width, 1), np.float32), np.zeros(1, np.float32)))
    target = np.array([p for _, p, _ in taken], dtype=np.float32)
    # Back to the shares that the two halves have among all texts.
    weight = np.array([every[int(p > 0.5)] for p in target], dtype=float)
    weight[target > 0.5] = np.maximum(weight[target > 0.5], weight.mean() / 4)
    return Scorer(labels, fit_logistic(matrix, target[:, None], weight, steps=300))


_SAMPLE_SCHEMA = pa.schema([("_hash", pa.int64()), ("poor", pa.float64()), ("row", pa.binary())])


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``quality`` (0 to 1) and ``accepted`` (0.5 or more) for every row, with the columns in ``keep``.

    Null texts and texts without words have quality 0 and are rejected.  Equal
    texts get equal results.  Without ``keep`` all columns of ``docs`` are carried but
    those named like a result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    shared = spark.sparkContext.broadcast(scorer)
    kept = F.struct(*kept_columns(docs, keep, ["quality", "accepted"]))
    rows = docs.select(kept.alias("_kept"), F.col(text).alias("_text"))
    kind = rows.schema["_kept"].dataType.simpleString()

    def decide(batches):
        for batch in batches:
            for part in parts(batch):
                quality = pa.array(shared.value.quality(part.column(1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), quality], names=["_kept", "_quality"])

    scored = rows.mapInArrow(decide, f"_kept {kind}, _quality double")
    return scored.select("_kept.*", F.col("_quality").alias("quality"), (F.col("_quality") >= 0.5).alias("accepted"))


def accepted(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, with all their columns."""
    spark = docs.sparkSession
    importable_on_executors(spark)
    shared = spark.sparkContext.broadcast(scorer)
    place = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(shared.value.quality(part.column(place).to_pylist()) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
