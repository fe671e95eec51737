"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import pathlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a batch are turned into Python objects this many at a time, fewer of long rows.
SLICE_ROWS = 128
SLICE_BYTES = 1 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def crc32(value: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(value.cast("binary"))


def text_key(text: str = "text") -> Column:
    """A short stand-in for a text, from two 64-bit hashes; null counts as empty."""
    value = whole_text(text)
    return F.concat(F.hex(F.xxhash64(value)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), value)))


def importable_on_executors(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, and send them short batches.

    On a cluster the package is installed or sent with ``--py-files``; there the
    added folder does not exist and changes nothing.  Rows are long here: with
    Spark's default of 10,000 rows a batch of texts would fill a worker's memory.
    Another value that the session has set is left alone.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, SLICE_ROWS * 2)
    root = str(pathlib.Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes, one row at least."""
    start = 0
    while start < batch.num_rows:
        size = SLICE_ROWS
        while size > 1 and batch.slice(start, size).nbytes > SLICE_BYTES:
            size //= 2
        yield batch.slice(start, size)
        start += size


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Batches as short lists of Python values, so that few texts are held at once."""
    for batch in batches:
        for part in parts(batch):
            yield part.to_pydict()


def kept_columns(docs: DataFrame, keep: list[str | Column] | None, made: list[str]) -> list[str | Column]:
    """The columns to carry: ``keep``, or all of ``docs`` but those named like a result."""
    return [F.col(f"`{c}`") for c in docs.columns if c not in made] if keep is None else keep
