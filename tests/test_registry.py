import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


# Hours with every lag back to 24 are too few in the smallest tables.
LARGER = {"persistence_scores", "daily_persistence_scores", "comparison"}


def connect(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def ducks():
    return {sf: connect(sf) for sf in (SF, "/root/testdata/sf0.01")}


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, ducks, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    cur = ducks[sf].execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in rows) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
