import numpy as np
import pytest
from pyspark.errors import PySparkException

from voxfabric.operators import boxes


def mean(v, factors):
    """Of z, y, x: blocks that reach past the image take its edge again."""
    f, m = factors[::-1], [max(1, n // k) for n, k in zip(v.shape, factors[::-1])]
    out = np.zeros(m, np.int64)
    for at in np.ndindex(*m):
        i = np.ix_(*[np.minimum(np.arange(a * k, a * k + k), n - 1) for a, k, n in zip(at, f, v.shape)])
        out[at] = v[i].sum() // np.prod(f)
    return out


def stored(spark, v, cell, whole=False):
    """Chunks, those at the edge cut or, whole, filled up with other values."""
    rows = []
    for gz in range(-(-v.shape[0] // cell[2])):
        for gy in range(-(-v.shape[1] // cell[1])):
            for gx in range(-(-v.shape[2] // cell[0])):
                part = v[gz * cell[2] : (gz + 1) * cell[2], gy * cell[1] : (gy + 1) * cell[1], gx * cell[0] : (gx + 1) * cell[0]]
                if whole:
                    part = np.pad(part, [(0, c - n) for c, n in zip(cell[::-1], part.shape)], constant_values=-7)
                rows.append((5, gx, gy, gz, part.reshape(-1).tolist()))
    return spark.createDataFrame(rows, "k int, gx int, gy int, gz int, data array<int>").repartition(3)


def voxels(image):
    out = np.full(image.size[::-1], -1, np.int64)
    for r in image.as_voxels().collect():
        assert out[r.z, r.y, r.x] == -1
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_downsampling_over_borders(spark, whole):
    v = np.random.default_rng(1).integers(0, 1000, (7, 13, 22))
    image = boxes.image_of(stored(spark, v, (5, 4, 3), whole), (5, 4, 3), (22, 13, 7), ["k"])
    assert (voxels(image) == v).all()
    for factors in ((2, 2, 2), (3, 5, 1), (1, 1, 1), (5, 4, 3), (10, 2, 9), (30, 20, 10)):
        assert (voxels(boxes.downsample(image, factors)) == mean(v, factors)).all(), factors


def test_cascades_and_new_chunks(spark):
    """Boxes and voxels between them go on to the next level and into chunks."""
    v = np.random.default_rng(2).integers(0, 1000, (9, 17, 25))
    image = boxes.image_of(stored(spark, v, (6, 5, 4)), (6, 5, 4), (25, 17, 9), ["k"])
    levels = boxes.pyramid(image, [(1, 1, 1), (3, 2, 2), (6, 6, 4)])
    one = mean(v, (3, 2, 2))
    two = mean(one, (2, 3, 2))
    assert (voxels(levels[1]) == one).all() and (voxels(levels[2]) == two).all()
    for level, want in ((levels[0], v), (levels[1], one)):
        got = boxes.chunks(level, (4, 3, 5)).collect()
        assert len(got) == int(np.prod([-(-n // c) for n, c in zip(want.shape, (5, 3, 4))]))
        for r in got:
            part = want[5 * r.gz : 5 * r.gz + 5, 3 * r.gy : 3 * r.gy + 3, 4 * r.gx : 4 * r.gx + 4]
            assert r.k == 5 and r["size"] == list(part.shape[::-1]) and r.data == part.reshape(-1).tolist()


def test_only_borders_are_shuffled(spark):
    """Factors that divide the chunks leave nothing between boxes; others leave the blocks on borders alone."""
    v = np.random.default_rng(3).integers(0, 1000, (8, 8, 16))
    image = boxes.image_of(stored(spark, v, (8, 8, 8)), (8, 8, 8), (16, 8, 8), ["k"])
    assert boxes.downsample(image, (2, 2, 2)).voxels.count() == 0
    assert boxes.downsample(image, (3, 2, 2)).voxels.select("x").distinct().collect() == [(2,)]


def test_wrong_and_missing_chunks(spark):
    df = spark.createDataFrame([(5, 0, 0, 0, [1, 2, 3])], "k int, gx int, gy int, gz int, data array<int>")
    with pytest.raises(PySparkException, match="another number of values"):
        boxes.image_of(df, (2, 2, 2), (4, 4, 4)).boxes.collect()
    image = boxes.image_of(stored(spark, np.ones((2, 2, 4), int), (2, 2, 2)).where("gx = 1"), (2, 2, 2), (4, 2, 2), ["k"])
    assert [tuple(r) for r in boxes.downsample(image, (2, 2, 2)).as_voxels().collect()] == [(5, 1, 0, 0, 1)]
    assert [(r.gx, r.data) for r in boxes.chunks(image, (3, 2, 2)).orderBy("gx").collect()] == [(0, [0, 0, 1] * 4), (1, [1] * 4)]
