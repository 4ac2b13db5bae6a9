"""Registered queries against their SQL on the smallest tables.

By default every ninth query runs; SIGHTLINE_ALL_QUERIES=1 runs all of them (tools/check.py does so at any scale).
"""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.queries())
CHOSEN = NAMES if os.environ.get("SIGHTLINE_ALL_QUERIES") else NAMES[::9]


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.oracles()) == set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
@pytest.mark.parametrize("name", CHOSEN)
def test_every_ninth_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())
    assert got == want
