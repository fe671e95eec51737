"""Compare registered queries with their comparison SQL, value by value.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _sorted(rows) -> list:
    return sorted(rows, key=lambda row: [(v is not None, str(type(v)), v) for v in row])


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """What differs between a query and its comparison, None if nothing."""
    columns = sorted(df.columns)
    theirs = con.sql(sql)
    if sorted(theirs.columns) != columns:
        return f"columns {columns} != {sorted(theirs.columns)}"
    expected_types = dict(zip(theirs.columns, map(str, theirs.types)))
    for name, kind in df.dtypes:
        if TYPES.get(kind) != expected_types[name]:
            return f"type of {name}: {kind} != {expected_types[name]}"
    mine = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    order = [theirs.columns.index(c) for c in columns]
    expected = _sorted(tuple(r[i] for i in order) for r in theirs.fetchall())
    if mine == expected:
        return None
    only = [r for r in mine if r not in set(expected)][:3]
    other = [r for r in expected if r not in set(mine)][:3]
    return f"{columns}: rows {len(mine)} != {len(expected)}; ours {only}; theirs {other}"


def main(sf_dir: str, wanted: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in oracle or wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), oracle[name], con)
        except Exception as error:  # keep going, report all
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("bad:", bad, "missing:", sorted(set(entry.queries()) - set(oracle)), sorted(set(oracle) - set(entry.queries())))
    return bad


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(directory, sys.argv[2:]) else 0)
