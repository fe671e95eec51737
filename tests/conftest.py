from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def channels(spark):
    """Build channel rows from dicts; missing columns get their defaults."""
    from castsieve.schema import CHANNEL

    def build(rows: list[dict]):
        defaults = {"name": "", "link": "", "group_name": "", "category": "Unknown", "extra_attributes": {}}
        full = [
            tuple({**defaults, "id": i, **row}.get(f.name) for f in CHANNEL.fields) for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(full, CHANNEL)

    return build
