"""Resolution pyramids: downsampling voxels level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.plans.pyramids import source_level


def downsample(voxels: DataFrame, factors: Sequence[int], size: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """The mean, rounded down, of each block of factors; size is that of the image.

    The result has max(1, size div factor) voxels a side; rows beyond belong
    to the last block, and where a block reaches past the image its edge
    counts again. Each task sums its own part of a block before the shuffle.
    """
    out, weight = {}, F.lit(1)
    for a, f, n in zip("xyz", factors, size):
        m = max(1, n // f)
        out[a] = F.floor(F.col(a) / f).cast("long")
        # The image's last voxel stands for those that its block lacks.
        reach = (F.floor(F.col(a) / f) + 1) * f - (n - 1)
        weight = weight * F.when(F.col(a) == n - 1, F.greatest(reach, F.lit(1))).otherwise(1)
        out[f"in_{a}"] = out[a] < m
    placed = voxels.select(*keys, *[out[a].alias(a) for a in "xyz"], "v", weight.alias("w"), (out["in_x"] & out["in_y"] & out["in_z"]).alias("inside")).where("inside")
    return placed.groupBy(*keys, "x", "y", "z").agg(F.floor(F.sum(F.col("v") * F.col("w")) / F.sum("w")).cast("long").alias("v"))


def downsample_blocks(blocks: DataFrame, cell: Sequence[int], factors: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, z, v: the same from whole chunks whose sides the factors divide; each chunk is averaged where it lies, nothing is shuffled."""
    if any(n % f for n, f in zip(cell, factors)):
        raise ValueError("the factors must divide the chunk's sides")
    out = [n // f for n, f in zip(cell, factors)]
    (cx, cy, _), (fx, fy, fz) = cell, factors
    place = lambda j: [(j % out[0]) * fx, (F.floor(j / out[0]) % out[1]) * fy, F.floor(j / (out[0] * out[1])) * fz]
    offsets = [x + cx * (y + cy * z) for z in range(fz) for y in range(fy) for x in range(fx)]

    def mean(j: Column) -> Column:
        x, y, z = place(j)
        first = x + cx * (y + cy * z)
        return F.floor(sum((F.get("data", (first + o).cast("int")) for o in offsets), F.lit(0).cast("long")) / len(offsets)).cast("long")

    cells = F.transform(F.sequence(F.lit(0), F.lit(out[0] * out[1] * out[2] - 1)), mean)
    found = blocks.select(*keys, "gx", "gy", "gz", F.posexplode(cells).alias("j", "v"))
    at = [F.col("j") % out[0], F.floor(F.col("j") / out[0]) % out[1], F.floor(F.col("j") / (out[0] * out[1]))]
    return found.select(*keys, *[(F.col(f"g{a}") * n + p).cast("long").alias(a) for a, n, p in zip("xyz", out, at)], "v")


def pyramid(voxels: DataFrame, resolutions: Sequence[Sequence[int]], size: Sequence[int], keys: Sequence[str] = (), least_saving: int = 8) -> list[DataFrame]:
    """All levels, each from the finer level that the plan names or from the original."""
    levels: list[DataFrame] = []
    for k, r in enumerate(resolutions):
        if k == 0 and all(f == 1 for f in r):
            levels.append(voxels)
            continue
        finer = source_level(resolutions, k, least_saving)
        base = resolutions[finer] if finer is not None else [1] * len(size)
        source = levels[finer] if finer is not None else voxels
        levels.append(downsample(source, [a // b for a, b in zip(r, base)], [max(1, n // b) for n, b in zip(size, base)], keys))
    return levels


def slab_mean(slices: DataFrame, count: int, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """Tiles of a coarser z level: the whole-number mean of `count` slices per channel (r, g, b), opaque; slices that failed count as black."""
    z = F.floor(F.col("z") / count).cast("long").alias("z")
    return slices.groupBy(*keys, z).agg(*[F.floor(F.sum(c) / count).cast("long").alias(c) for c in "rgb"]).withColumn("a", F.lit(255).cast("long"))
