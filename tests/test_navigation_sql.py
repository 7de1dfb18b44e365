"""Navigation against its SQL on logs whose results lie on the edge between two whole numbers."""

import datetime

import duckdb
import pytest

from voxfabric.queries import ORACLES, QUERIES

START = datetime.datetime(2024, 1, 1)
KINDS = ("click", "purchase", "signup")
#: Kinds (zoom, unzoom, drag) and values of single sessions.
LOGS = (
    [(1, 7), (2, 2), (2, 2), (1, 1), (1, 8), (2, 3), (2, 2), (0, 5), (0, 2), (0, 2), (0, 7), (2, 4), (0, 3), (2, 6)],
    [(1, 3), (2, 2), (1, 3), (2, 3), (1, 7), (2, 5), (2, 0), (0, 3), (0, 0), (0, 7), (0, 3), (2, 5), (1, 8), (0, 6)],
)


def compared(spark, con, name, folder):
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select([c[0] for c in want.description])
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


def test_zooms_take_the_shift_off_and_put_it_back(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(100 * s + i, START + datetime.timedelta(seconds=i), s, KINDS[k], float(v), "") for s, log in enumerate(LOGS) for i, (k, v) in enumerate(log)]
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY e TO '{tmp_path}/events.parquet'")
    got, want = compared(spark, con, "navigation", tmp_path)
    assert got == want


@pytest.mark.parametrize("name", ["navigation", "navigation_events"])
def test_maps_are_multiplied_up_in_order(spark, tmp_path, name):
    """Two sessions of the table sf0.1 whose maps differ if they are multiplied up by ranges."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (59, 1000)) TO '{tmp_path}/events.parquet'")
    got, want = compared(spark, con, name, tmp_path)
    assert got == want
