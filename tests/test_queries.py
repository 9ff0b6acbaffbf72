"""Each registered query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        out.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return out


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([value(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, con, name):
    found = registry.QUERIES[name](spark, str(FOLDER))
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, str(FOLDER)).limit(1).count() == 1


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
