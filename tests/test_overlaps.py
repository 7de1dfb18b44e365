import random

import pytest

from voxfabric.operators import screen


@pytest.mark.parametrize("pairs", [50, 10**9])
def test_full_bins_are_dealt_out(spark, monkeypatch, pairs):
    """Most rectangles in one bin, some over many, one twice: the same pairs however many tasks share a bin."""
    monkeypatch.setattr(screen, "PAIRS", pairs)
    r = random.Random(3)
    rects = [(i, *(v + r.randint(0, 9) for v in (0, 0, 9, 9))) for i in range(40)] + [(40 + i, x, y, x + r.randint(0, 60), y + r.randint(0, 60)) for i in range(20) for x, y in [(r.randint(0, 200), r.randint(0, 200))]]
    rects += [(60, *rects[0][1:])]
    left = spark.createDataFrame(rects, "i int, x0 long, y0 long, x1 long, y1 long")
    right = left.toDF("j", "r_x0", "r_y0", "r_x1", "r_y1")
    found = screen.overlapping(left, right, 16)
    want = sorted((a[0], b[0]) for a in rects for b in rects if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted((x.i, x.j) for x in found.collect()) == want
    assert found.rdd.getNumPartitions() == 4 if pairs > 50 else found.rdd.getNumPartitions() > 20
    assert found.columns == [*left.columns, *right.columns]
