import random

from voxfabric.operators import tiling


def test_sources_of_every_tile_are_dealt_out(spark, monkeypatch):
    """The same rows however few a task makes: frames with and without sources that opt out of culling."""
    r = random.Random(2)
    rows = [(f, 100 * f + i, f == 1 or i > 2, *(v + r.randint(0, 30) for v in (0, 0, 31, 31))) for f in range(3) for i in range(12)]
    rects = spark.createDataFrame(rows, "frame int, source_id int, culled boolean, x0 int, y0 int, x1 int, y1 int")
    made = {}
    for most in (3, 10**9):
        monkeypatch.setattr(tiling, "ROWS", most)
        made[most] = tiling.adaptive_tiles(rects, ["frame"], 100, 80)
    few, many = (sorted(map(repr, made[m].collect())) for m in (3, 10**9))
    assert few == many and made[3].rdd.getNumPartitions() > 20
    tiles = {(x.frame, x.tile_id) for x in made[3].collect()}
    for f, i, culled, *_ in rows:
        if not culled:
            assert {(x.frame, x.tile_id) for x in made[3].collect() if x.source_id == i} == {t for t in tiles if t[0] == f}
            break
