"""Every registered query against its SQL equivalent on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from platen.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    return str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    assert got, "no rows"
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(normal(row[i]) for i in at) for row in result.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["trap_id", "severity", "weight", "basis", "n_hits"]
    assert df.count() >= 15
