"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxfabric.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v if v is None or isinstance(v, (bool, str)) else float(v) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in ("overlapping_sources",)
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        assert canonical(rows, df.columns) == canonical(want.fetchall(), [c[0] for c in want.description])


def test_entry(spark):
    assert entry.entry(spark).count() == 64 * 48
    assert set(entry.oracle_sql()) <= set(entry.queries())
