import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxfabric.functions import affine, scalars
from voxfabric.operators import visibility
from voxfabric.plans import ids, pyramids


def ranged(spark, *steps):
    lit = lambda t: scalars.BoundedRange(*[F.lit(float(v)) for v in t])
    out = []
    for start, step, value in steps:
        r = lit(start)
        r = r.join(lit(value)) if step == "join" else getattr(r, step)(F.lit(float(value)))
        out.append(F.array(r.min_bound, r.max_bound, r.low, r.high))
    return [tuple(v) for v in spark.range(1).select(F.array(*out)).first()[0]]


def test_bounded_range(spark):
    """Fixed expected values."""
    cases = [
        ((0, 1, 0, 1), "with_min", -1, (-1, 1, -1, 1)),
        ((0, 1, 0, 1), "with_min", 0.5, (0, 1, 0.5, 1)),
        ((0, 1, 0, 1), "with_min", 2, (0, 2, 2, 2)),
        ((0, 1, 0, 1), "with_max", 2, (0, 2, 0, 2)),
        ((0, 1, 0, 1), "with_max", 0.5, (0, 1, 0, 0.5)),
        ((0, 1, 0, 1), "with_max", -1, (-1, 1, -1, -1)),
        ((0, 3, 1, 2), "with_min_bound", -1, (-1, 3, 1, 2)),
        ((0, 3, 1, 2), "with_min_bound", 0.5, (0.5, 3, 1, 2)),
        ((0, 3, 1, 2), "with_min_bound", 1.5, (1.5, 3, 1.5, 2)),
        ((0, 3, 1, 2), "with_min_bound", 4, (4, 4, 4, 4)),
        ((0, 3, 1, 2), "with_max_bound", 4, (0, 4, 1, 2)),
        ((0, 3, 1, 2), "with_max_bound", 2.5, (0, 2.5, 1, 2)),
        ((0, 3, 1, 2), "with_max_bound", 1.5, (0, 1.5, 1, 1.5)),
        ((0, 3, 1, 2), "with_max_bound", -1, (-1, -1, -1, -1)),
        ((0, 3, 1, 2), "join", (5, 8, 6, 7), (0, 8, 1, 7)),
    ]
    assert ranged(spark, *[c[:3] for c in cases]) == [c[3] for c in cases]
    bad = [(0, 1, -1, 1), (0, -1, 0, 0), (0, 11, 1, 0)]
    rows = spark.createDataFrame(bad, "a int, b int, c int, d int")
    assert not any(r[0] for r in rows.select(scalars.BoundedRange(*[F.col(c) for c in "abcd"]).valid()).collect())


def test_affine_against_numpy(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=12).tolist(), r.normal(size=12).tolist()) for i in range(20)] + [(20, [0.0] * 12, [1.0] * 12)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    at = affine.apply("a", F.lit(1.0), F.lit(2.0), F.lit(3.0))
    lo, hi = [F.lit(-1.0), F.lit(2.0), F.lit(0.0)], [F.lit(1.0), F.lit(5.0), F.lit(3.0)]
    bounds = affine.box_bounds("a", lo, hi)
    got = df.select("i", affine.compose("a", "b").alias("c"), affine.inverse("a").alias("inv"), F.array(*at).alias("p"), F.array(*[x for b in bounds for x in b]).alias("box"), *[affine.column_length("a", d).alias(f"l{d}") for d in range(3)]).collect()
    full = lambda m: np.vstack([np.reshape(m, (3, 4)), [0, 0, 0, 1]])
    corners = np.array([[x, y, z, 1] for x in (-1, 1) for y in (2, 5) for z in (0, 3)])
    for (_, a, b), g in zip(rows, sorted(got, key=lambda g: g.i)):
        assert np.allclose(full(g.c), full(a) @ full(b))
        assert np.allclose(g.p, (full(a) @ [1, 2, 3, 1])[:3])
        image = corners @ full(a).T
        assert np.allclose(np.reshape(g.box, (3, 2)), np.stack([image.min(0), image.max(0)], 1)[:3])
        assert np.allclose([g.l0, g.l1, g.l2], np.linalg.norm(full(a)[:3, :3], axis=0))
        assert g.inv is None if not any(a) else np.allclose(full(g.inv) @ full(a), np.eye(4))


@given(st.lists(st.integers(0, 30), unique=True), st.sets(st.integers(0, 30)))
@settings(max_examples=50, deadline=None)
def test_free_ids(old, used):
    got = ids.free_ids(old, used)
    assert list(got) == old and len(set(got.values())) == len(old) and not set(got.values()) & used
    assert all(new >= o for o, new in got.items())


def test_attribute_ids_and_offsets():
    assert ids.free_attribute_ids({"angle": [0, 1, 0]}, {"angle": [0]}) == {"angle": {0: 1, 1: 2}}
    assert ids.timepoint_offsets([(0, 4), (2, 3), (20, 21)]) == [0, 5, 20]


def test_block_sizes():
    assert pyramids.block_size([1, 1, 1]) == [16, 16, 16]
    assert pyramids.block_size([1, 1, 4]) == [32, 32, 4]
    assert math.prod(pyramids.block_size([1, 1, 1], 1000)) == 512
    assert pyramids.block_size([1, 1, 1], image=[400, 400, 3])[2] == 4


def test_proposed_levels():
    levels = pyramids.propose([1000, 900, 40], [1, 1, 3])
    assert [x["resolution"] for x in levels] == [[1, 1, 1], [2, 2, 1], [4, 4, 2]]
    assert [x["resolution"] for x in pyramids.propose([100, 100, 100], [1, 1, 1])] == [[1, 1, 1]]


def test_source_level():
    assert [pyramids.source_level([[1, 1, 1], [2, 2, 2], [4, 4, 4], [6, 6, 6]], k) for k in range(4)] == [None, None, 1, 1]
    assert pyramids.source_level([[1, 1, 1], [2, 2, 1], [4, 4, 2]], 2) is None
    assert [pyramids.tile_levels(w, h, 256, 256) for w, h in ((2000, 1000), (2000, 1100), (514, 514), (513, 513), (100, 5000))] == [2, 3, 2, 1, 1]
    assert pyramids.tile_level(2000, 1000, 90, 16 / 3, 3)["resolution"] == [8, 8, 2]
    assert pyramids.tile_level(2000, 1000, 90, 4.0, 3) == {"resolution": [8, 8, 2], "size": [250, 125, 45]}


def test_modes():
    for mode in visibility.MODES:
        for what in ("fused", "grouping"):
            assert visibility.toggle_mode(visibility.toggle_mode(mode, what), what) == mode
    with pytest.raises(ValueError):
        visibility.visible(None, None, None, "OTHER")
