"""The entry points, and every query against its comparison SQL."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from castsieve.catalog.oracle import ORACLE
from castsieve.catalog.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_query_has_a_comparison():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "name", "link", "epg_url"]
    ids = sorted(r.id for r in df.collect())
    assert ids == list(range(len(ids))) and len(ids) > 100


@pytest.fixture(scope="module")
def differences(spark):
    """What differs, by query; several queries run at a time."""

    def check(name):
        # Duplicate removal only shows its rules on the larger tables.
        sf = MIDDLE if name.startswith("remove_duplicate") else SMALL
        return difference(QUERIES[name](spark, sf), ORACLE[name], connect(sf))

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(QUERIES, pool.map(check, QUERIES)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_comparison(differences, name):
    assert differences[name] is None


def test_known_counts(spark):
    counts = entry.queries()["remove_duplicates_counts"](spark, MIDDLE).first()
    assert (counts.total, counts.kept, counts.removed) == (2000, 1796, 204)
    assert entry.queries()["merge_playlists"](spark, MIDDLE).count() == 1881
    valid = entry.queries()["valid_stream_url"](spark, MIDDLE).where("src = 'page' and not valid").count()
    assert valid == 35


