"""Intermediate tables in the shared folder of the cluster.

Iterative operators write each step as Parquet instead of keeping it on
executors: the step survives lost executors, later readers fetch only the
columns they need, and its exact size lets Spark choose broadcast or shuffle.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only for local runs."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="castsieve-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write the rows once and continue from the written table.

    A ``lasting`` table stays when the ``scratch`` around it ends.
    """
    spark = df.sparkSession
    run = f"{shared_folder(spark)}/castsieve/{spark.sparkContext.applicationId}"
    path = f"{run}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stack = getattr(_written, "scratch", [])
    for paths in stack[:-1] if lasting else stack:
        paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table._written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that are written inside, when their results are saved."""
    stack = _written.__dict__.setdefault("scratch", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
