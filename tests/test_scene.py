"""Viewer transforms and tiles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import camera, tiling

R = np.random.default_rng(3)


def matrix(seed):
    """A map that rotates, scales each axis, shears a little and shifts."""
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    return np.hstack([q @ np.diag([1.0, 2.0, 5.0]) @ (np.eye(3) + 0.1 * r.random((3, 3))), r.standard_normal((3, 1)) * 50])


def similarity(seed, scale):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    return np.hstack([scale * q, r.standard_normal((3, 1)) * 50])


def whole(m):
    return np.vstack([m, [0, 0, 0, 1]])


def col(m):
    return affine.affine([float(v) for v in np.asarray(m).reshape(-1)])


def value(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return [np.array(v).reshape(3, 4) for v in row]


def straight(m, axis):
    u = m[:, :3] / np.linalg.norm(m[:, :3], axis=0)
    k, last = (axis + 1) % 3, (axis + 2) % 3
    out = np.zeros((3, 3))
    z = np.cross(u[:, k], u[:, last])
    out[:, axis], out[:, k] = z / np.linalg.norm(z), u[:, k]
    out[:, last] = np.cross(out[:, axis], out[:, k])
    return out


def test_rotations(spark):
    for seed in range(3):
        m = matrix(seed)
        got = value(spark, *[camera.rotation(col(m), axis) for axis in range(3)])
        for axis, g in enumerate(got):
            assert np.allclose(g[:, :3], straight(m, axis)) and np.allclose(g[:, :3] @ g[:, :3].T, np.eye(3))


def test_initial_view(spark):
    m, low, high = matrix(7), np.array([2.0, -3.0, 1.0]), np.array([41.0, 30.0, 9.0])
    box = lambda v: [F.lit(float(x)) for x in v]
    (view,) = value(spark, camera.initial_view(col(m), box(low), box(high), 800, 600))
    middle = np.append((low + high) / 2, 1)
    middle[2] = np.floor((low[2] + high[2]) / 2 + 0.5)
    at = view @ whole(m) @ middle
    assert np.allclose(at[:2], [399.5, 299.5]) and np.isclose(at[2], 0)
    corner = view @ whole(m) @ np.array([high[0] + 0.5, high[1] + 0.5, middle[2], 1])
    assert np.isclose(corner[0], 799.5) or np.isclose(corner[1], 599.5)
    assert np.allclose(np.cross(view[:, :3] @ m[:, 0], [1, 0, 0]), 0, atol=1e-9)  # the source's x runs along the screen


@pytest.mark.parametrize("plane, flat", [("XY", (0, 1)), ("ZY", (2, 1)), ("XZ", (0, 2))])
def test_align(spark, plane, flat):
    m, viewer = matrix(5), similarity(6, 3.0)
    (got,) = value(spark, camera.aligned(col(viewer), col(m), plane, 100.0, 80.0))
    seen = got[:, :3] @ m[:, :3]
    assert np.allclose(seen[2, list(flat)], 0, atol=1e-9)  # both axes of the plane lie in the screen
    fixed = np.linalg.solve(viewer[:, :3], np.array([100, 80, 0]) - viewer[:, 3])
    assert np.allclose(got[:, :3] @ fixed + got[:, 3], [100, 80, 0])


def test_animations_begin_and_end(spark):
    a, b = similarity(1, 2.0), similarity(2, 5.0)
    start, middle, end = value(spark, *[camera.similar(col(a), col(b), F.lit(t)) for t in (0.0, 0.5, 1.0)])
    assert np.allclose(start, a) and np.allclose(end, b)
    assert np.isclose(np.linalg.norm(middle[0, :3]), np.sqrt(10))
    turn = similarity(3, 1.0)
    turn[:, 3] = 0
    half, full = value(spark, *[camera.rotation_power(col(turn), F.lit(t)) for t in (0.5, 1.0)])
    assert np.allclose(half[:, :3] @ half[:, :3], turn[:, :3]) and np.allclose(full, turn)


def test_navigation_keeps_the_point(spark):
    m = similarity(4, 2.0)
    zoom, turn = value(spark, camera.zoomed(col(m), 1.05, 30.0, 40.0), camera.turned(col(m), 2, F.lit(0.3), 30.0, 40.0))
    p = np.linalg.solve(m[:, :3], np.array([30, 40, 0]) - m[:, 3])
    for g in (zoom, turn):
        assert np.allclose(g[:, :3] @ p + g[:, 3], [30, 40, 0])
    assert np.allclose(zoom[:, :3], 1.05 * m[:, :3])


def test_tiles(spark):
    rects = np.array([[x, y, min(x + w, 199), min(y + h, 149)] for x, y, w, h in zip(R.integers(0, 190, 12), R.integers(0, 140, 12), R.integers(1, 60, 12), R.integers(1, 60, 12))])
    tiles = tiling.split_tiles(rects, (0, 0, 199, 149))
    cover = np.zeros((150, 200), int)
    for (x0, y0, x1, y1), own in tiles:
        cover[y0 : y1 + 1, x0 : x1 + 1] += 1
        over = [i for i, (a, b, c, d) in enumerate(rects) if a <= x1 and c >= x0 and b <= y1 and d >= y0]
        assert sorted(own.tolist()) == over
        if (x1 - x0 + 1) * (y1 - y0 + 1) > tiling.LEAST:  # a large tile lies in each of its sources or their edges don't cross it
            assert all(a <= x0 and c >= x1 and b <= y0 and d >= y1 for a, b, c, d in rects[own])
    assert (cover == 1).all()
    strips = tiling.strips_of((0, 0, 199, 149))
    assert sum((y1 - y0 + 1) for _, y0, _, y1 in strips) == 150 and all(200 * (y1 - y0 + 1) <= 1200 for _, y0, _, y1 in strips)

    df = spark.createDataFrame([(7, i, i != 0, *map(int, r)) for i, r in enumerate(rects)], "frame int, source_id long, culled boolean, x0 long, y0 long, x1 long, y1 long")
    got = tiling.adaptive_tiles(df, ["frame"], 200, 150).collect()
    assert {r.frame for r in got} == {7} and all(0 in {r.source_id for r in got if r.tile_id == t} for t in {r.tile_id for r in got})


@pytest.mark.parametrize("crowd", [10_000, 6, 0])
def test_tiles_by_levels_equal_tiles_by_one_task(spark, crowd):
    """Frames of many, few and no bounded sources, split level by level as far as they are crowded."""
    r = np.random.default_rng(9)
    rows = []
    for frame, n in ((1, 40), (2, 3), (None, 12)):
        for i in range(n):
            x, y = int(r.integers(0, 180)), int(r.integers(0, 130))
            rows.append((frame, i, i % 9 != 8, x, y, min(199, x + int(r.integers(0, 60))), min(149, y + int(r.integers(0, 60)))))
    rows += [(1, 100 + k, True, 50, 40, 60, 50) for k in range(9)] + [(4, 5, False, 0, 0, 199, 149)]
    df = spark.createDataFrame(rows, "frame int, source_id long, culled boolean, x0 int, y0 int, x1 int, y1 int")
    frames = {f for f, *_ in rows if f is not None}
    got = tiling.adaptive_tiles(df.where("frame is not null"), ["frame"], 200, 150, crowd=crowd).collect()
    for f in frames:
        own = [x for x in rows if x[0] == f]
        rects, always = np.array([x[3:] for x in own if x[2]]).reshape(-1, 4), [x[1] for x in own if not x[2]]
        ids, want, number = [x[1] for x in own if x[2]], set(), 0
        for tile, inside in tiling.split_tiles(rects, (0, 0, 199, 149)):
            for strip in tiling.strips_of(tile):
                want |= {(number, *strip, s) for s in [*[ids[i] for i in inside], *always] or [None]}
                number += 1
        found = [tuple(x)[1:] for x in got if x.frame == f]
        assert len(found) == len(set(found)) and set(found) == want, f


def test_two_converters_are_an_error(spark):
    from voxfabric.operators import fusing

    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (2, 5.0)], "source_id int, cmin double")
    assert fusing.one_each(df.where("cmin < 5")).count() == 2
    with pytest.raises(Exception, match="two converters"):
        fusing.one_each(df).collect()
