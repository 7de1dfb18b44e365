"""The volume's queries where chunks are missing."""

import duckdb

from voxfabric.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_tiles_of_a_volume_with_holes(spark, tmp_path):
    """A last slab that is cut short, and a hole in the middle: no blocks where there are no chunks, and nothing added by them."""
    con = duckdb.connect()
    file = tmp_path / "embeddings.parquet"
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 137 AND vec_id NOT IN (0, 55)) TO '{file}'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{file}'")
    want = con.execute(ORACLES["tile_scan"])
    got = QUERIES["tile_scan"](spark, str(tmp_path)).select([c[0] for c in want.description])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
