"""Language of whole texts by error-correcting output codes.

Every language has a codeword; for every bit a linear classifier on hashed byte
n-grams predicts it.  Decoding takes the codeword with the least loss, bits
weighted by how well their classifiers do, and flags texts whose best two
codewords are close.

The classifiers are fitted on the driver on a sample of labelled texts of at most
about ``SAMPLE`` rows, spread evenly over the languages; the languages and their
numbers are counted over all labelled rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable_on_executors, kept_columns, parts, slices
from .hashing import gram_bins
from .linear import fit_logistic, probability

# Rows that the classifiers are fitted on, and what a language gets at least.
SAMPLE = 4000
LEAST = 50
BITS = 11
UNKNOWN = "und"


def codewords(classes: int) -> np.ndarray:
    """One row of bits per class, far apart from each other; no bit equal for all."""
    if classes <= 5:
        # All ways to part the classes in two.
        columns = [c for c in itertools.product((0, 1), repeat=classes) if c[0] == 1 and 0 in c]
        return np.array(columns or [[1] * classes], dtype=np.int8).T
    rng = np.random.default_rng(7)
    length = int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (classes, length), dtype=np.int8)
        code[rng.integers(0, classes, length), np.arange(length)] = 1 - code[0]
        signed = 2 * code.astype(np.int32) - 1
        products = signed @ signed.T
        np.fill_diagonal(products, -length)
        nearest = (length - products.max()) // 2
        if nearest > apart:
            best, apart = code, nearest
    return best


def features(texts: list[str | None]) -> np.ndarray:
    """Roots of the shares of hashed 1- to 3-grams of bytes of the lower-cased letters."""
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
        letters = (data >= 0x80) | ((data >= 97) & (data <= 122))
        data = np.where(letters, data, 32).astype(np.uint32)
        for n in (1, 2, 3):
            bins = gram_bins(data, n, BITS)
            if len(bins):
                # Runs of blanks say nothing.
                out[i] += np.bincount(bins[letters[: len(bins)] | letters[n - 1 :]], minlength=1 << BITS)
        total = out[i].sum()
        if total:
            out[i] = np.sqrt(out[i] / total)
    return out


class Codes:
    """The fitted classifiers and how to decode them."""

    def __init__(self, languages: list[str], rows: np.ndarray, labels: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        counts = np.maximum(np.bincount(labels, minlength=len(languages)), 1)
        target = self.code[labels].astype(np.float32)
        self.model = fit_logistic(rows, target, 1 / counts[labels])
        right = ((probability(rows, self.model) > 0.5) == (target > 0.5)).mean(0)
        self.weight = np.clip(2 * right - 1, 0.05, 1)

    def losses(self, rows: np.ndarray) -> np.ndarray:
        """The weighted loss of every codeword for every row."""
        p = np.clip(probability(rows, self.model), 1e-9, 1 - 1e-9)
        return -(np.log(p) * self.weight) @ self.code.T - (np.log(1 - p) * self.weight) @ (1 - self.code.T)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        losses = self.losses(features(texts)) / self.weight.sum()
        likely = np.exp(-4 * (losses - losses.min(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        best, score = likely.argmax(1), likely.max(1)
        second = np.sort(likely, axis=1)[:, -2] if likely.shape[1] > 1 else np.zeros(len(texts))
        out = []
        for text, k, s, t in zip(texts, best, score, second):
            if any(map(str.isalpha, text or "")):
                out.append((self.languages[k], float(s), bool(t > 0.5 * s)))
            else:
                out.append((UNKNOWN, 0.0, False))
        return out


def fit(
    labelled: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE
) -> Codes:
    """Fit on rows with a text and a language; rows without either are left out.

    The rows of the sample are chosen by a hash of id and text, so they do not
    depend on order or partitions; a language with few rows gives all of them.
    Should one row be repeated so often that the sample grows beyond twice its
    size, any rows of it of that number are used.
    """
    spark = labelled.sparkSession
    importable_on_executors(spark)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.xxhash64(id_column, text).alias("_hash"), F.col(text).alias("_text"), F.col(lang).alias("_lang")
    )
    counts = rows.groupBy("_lang").count()
    sizes = sorted(counts.where("_lang != ''").collect())
    languages = [r._lang for r in sizes]
    each = max(LEAST, sample // max(1, len(sizes)))
    every = spark.createDataFrame(
        [(r._lang, max(1, r["count"] // each)) for r in sizes] or [("", 1)], "_lang string, _every long"
    )
    chosen = rows.join(F.broadcast(every), "_lang").where(F.pmod("_hash", "_every") == 0).limit(2 * max(sample, each * len(sizes)))

    def described(batches):
        for values in slices(batches):
            made = [row.tobytes() for row in features(values["_text"])]
            yield pa.RecordBatch.from_pydict({"_lang": values["_lang"], "_row": made}, schema=_SAMPLE_SCHEMA)

    taken = chosen.select("_lang", "_text").mapInArrow(described, "_lang string, _row binary").collect()
    place = {language: k for k, language in enumerate(languages)}
    taken = sorted((place[r._lang], bytes(r._row)) for r in taken)
    used = sorted({k for k, _ in taken})
    matrix = np.frombuffer(b"".join(row for _, row in taken), dtype=np.float32).reshape(len(taken), 1 << BITS)
    again = {k: n for n, k in enumerate(used)}
    labels = np.array([again[k] for k, _ in taken], dtype=np.int64)
    if not used:
        codes = Codes.__new__(Codes)
        codes.languages = []
        return codes
    return Codes([languages[k] for k in used], matrix, labels)


_SAMPLE_SCHEMA = pa.schema([("_lang", pa.string()), ("_row", pa.binary())])


def predict(docs: DataFrame, codes: Codes, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for every row, with the columns in ``keep``.

    Only the text is looked at.  Null texts and texts without a letter are
    ``und`` with score 0; so is everything when nothing could be learned.  Equal
    texts get equal results.  Without ``keep`` all columns of ``docs`` are carried but
    those named like a result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    importable_on_executors(spark)
    shared = spark.sparkContext.broadcast(codes)
    result = "struct<lang_pred:string,score:double,ambiguous:boolean>"
    kept = F.struct(*kept_columns(docs, keep, ["lang_pred", "score", "ambiguous"]))
    rows = docs.select(kept.alias("_kept"), F.col(text).alias("_text"))
    kind = rows.schema["_kept"].dataType.simpleString()

    def decode(batches):
        for batch in batches:
            for part in parts(batch):
                found = shared.value.predict(part.column(1).to_pylist())
                made = pa.array(
                    [dict(zip(("lang_pred", "score", "ambiguous"), f)) for f in found],
                    pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["_kept", "_found"])

    return rows.mapInArrow(decode, f"_kept {kind}, _found {result}").select("_kept.*", "_found.*")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))
