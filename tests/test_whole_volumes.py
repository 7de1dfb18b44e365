"""Queries of the volume at a size where it is deeper than 20 slices."""

import os

import duckdb
import numpy as np
import pytest

from voxfabric.queries import ORACLES, QUERIES
from voxfabric.sources import blocks, derived

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def found(spark, name, columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_volume_size(spark):
    assert derived.volume_size(spark, SF) == (40, 40, 80)
    assert blocks.extent(derived.blocks(spark, SF).limit(0), (4, 4, 4)) == (0, 0, 0)


def test_downsample(spark, duck):
    want = duck.execute(ORACLES["downsample"])
    assert found(spark, "downsample", [c[0] for c in want.description]) == sorted(want.fetchall())


def voxels(duck):
    """(z, y, x) of the whole volume, from the table."""
    out = np.zeros((80, 40, 40), np.int64)
    for k, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall():
        x, y, z = k % 10 * 4, k // 10 % 10 * 4, k // 100 * 4
        out[z : z + 4, y : y + 4, x : x + 4] = np.floor((np.array(e, float) + 1) * 32767).reshape(4, 4, 4)
    return out


def halved(v):
    z, y, x = (n // 2 for n in v.shape)
    return v.reshape(z, 2, y, 2, x, 2).sum((1, 3, 5)) // 8


def test_downsample_cascade(spark, duck):
    one = halved(voxels(duck))
    two = halved(one)
    three = two[:18, :9, :9].reshape(6, 3, 3, 3, 3, 3).sum((1, 3, 5)) // 27
    want = [(k, x, y, z, int(v)) for k, level in ((1, one), (2, two), (3, three)) for (z, y, x), v in np.ndenumerate(level)]
    assert found(spark, "downsample_cascade", ["level", "x", "y", "z", "v"]) == sorted(want)


def test_middle_slice_contrast(spark, duck):
    bins = np.minimum(6534, voxels(duck)[40] * 6535 // 65535).ravel()
    n = np.bincount(bins)
    assert found(spark, "histogram", ["bin", "n"]) == [(i, int(c)) for i, c in enumerate(n) if c]
    low, high = ((int(np.argmax(n.cumsum() >= n.sum() * share)) + 1) * 65535 // 6535 for share in (0.001, 0.999))
    assert found(spark, "contrast_bounds", ["cmin", "cmax"]) == [(low, high)]
