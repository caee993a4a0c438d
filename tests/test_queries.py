"""Every registered query that SQL can express, against DuckDB on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from terraloom import catalog

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    told = db.sql(catalog.ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in told.fetchall())


def test_registry_needs_no_session():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
