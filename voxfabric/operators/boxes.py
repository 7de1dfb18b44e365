"""Arrays as boxes: downsampled and cut anew without becoming voxels.

A box is a row: keys, x0, y0, z0, size, data (x fastest), a part of an image.
An image is boxes, and voxels (keys, x, y, z, v) of what lies between them:
where a block of voxels to be averaged reaches over a border of boxes, each
box gives its part of the sum, and these parts alone are shuffled. All else is
averaged where it lies. Boxes and voxels of an image don't overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.plans.pyramids import source_level
from voxfabric.sources.scratch import settled

_BOX = "x0 long, y0 long, z0 long, size array<int>, data array<long>"


@dataclass
class Image:
    boxes: DataFrame
    voxels: DataFrame
    size: tuple[int, int, int]
    keys: tuple[str, ...] = ()

    def as_voxels(self) -> DataFrame:
        """keys, x, y, z, v of all."""
        b = self.boxes.select(*self.keys, "x0", "y0", "z0", F.col("size")[0].alias("w"), F.col("size")[1].alias("h"), F.posexplode("data").alias("i", "v"))
        at = {"x": F.col("x0") + F.col("i") % F.col("w"), "y": F.col("y0") + F.floor(F.col("i") / F.col("w")) % F.col("h"), "z": F.col("z0") + F.floor(F.col("i") / (F.col("w") * F.col("h")))}
        return b.select(*self.keys, *[c.cast("long").alias(k) for k, c in at.items()], "v").unionByName(self.voxels)


def image_of(blocks: DataFrame, cell: Sequence[int], size: Sequence[int], keys: Sequence[str] = ()) -> Image:
    """An image of chunks (keys, gx, gy, gz, data) of one size; those at the image's edge may be cut to it or reach beyond it."""
    inside = [F.least(F.lit(c), F.lit(n) - F.col(f"g{a}") * c) for a, c, n in zip("xyz", cell, size)]
    count = inside[0] * inside[1] * inside[2]
    i = lambda k: [(k % cell[0]) < inside[0], (F.floor(k / cell[0]) % cell[1]) < inside[1], F.floor(k / (cell[0] * cell[1])) < inside[2]]
    values = F.col("data").cast("array<long>")

    def kept(k: Column) -> Column:
        x, y, z = i(k)
        return x & y & z

    wrong = F.raise_error(F.concat(F.lit("a chunk has another number of values than its size: "), F.size("data").cast("string"))).cast("array<long>")
    cut = F.when(F.size("data") == count, values).when(F.size("data") == prod(cell), F.filter(values, lambda v, k: kept(k))).otherwise(wrong)
    boxes = blocks.where((inside[0] > 0) & (inside[1] > 0) & (inside[2] > 0)).select(
        *keys, *[(F.col(f"g{a}").cast("long") * c).alias(f"{a}0") for a, c in zip("xyz", cell)], F.array(*[n.cast("int") for n in inside]).alias("size"), cut.alias("data")
    )
    none = boxes.where("false").select(*keys, F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"), F.lit(0).cast("long").alias("v"))
    return Image(boxes, none, tuple(size), tuple(keys))


def _axis(first: int, count: int, factor: int, size: int) -> tuple[int, np.ndarray, tuple[int, int]]:
    """For an axis of a box: the first voxel of the next level that it has part in, the weights (next level by box), and which of those it has whole."""
    m = max(1, size // factor)
    x = np.arange(first, first + count)
    to = x // factor
    low, high = int(to[0]), min(int(to[-1]), m - 1)
    weights = np.zeros((max(0, high - low + 1), count), np.int64)
    fine = np.flatnonzero(to <= high)
    # The image's last voxel stands for those that its block lacks.
    w = np.where(x == size - 1, np.maximum((to + 1) * factor - (size - 1), 1), 1)
    weights[to[fine] - low, fine] = w[fine]
    whole = np.flatnonzero(weights.sum(1) == factor)
    return low, weights, (int(whole[0]), int(whole[-1]) + 1) if len(whole) else (0, 0)


def downsample(image: Image, factors: Sequence[int]) -> Image:
    """The mean, rounded down, of each block of factors.

    The result has max(1, size div factor) voxels a side; where a block
    reaches past the image its edge counts again. The result is computed once
    and checkpointed, as levels are read by the next ones and by writers.
    """
    keys, size, total = image.keys, image.size, prod(factors)
    kinds = {f.name: f.dataType.simpleString() for f in image.boxes.schema.fields}

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                own = [row.column(k) for k in keys]
                first = [row.column(c)[0].as_py() for c in ("x0", "y0", "z0")]
                shape = row.column("size")[0].as_py()
                data = row.column("data").flatten().to_numpy(zero_copy_only=False).reshape(shape[::-1])
                axes = [_axis(a, n, f, s) for a, n, f, s in zip(first, shape, factors, size)]
                if any(len(a[1]) == 0 for a in axes):
                    continue
                sums = np.einsum("kz,jy,ix,zyx->kji", axes[2][1], axes[1][1], axes[0][1], data, optimize=True)
                (x0, x1), (y0, y1), (z0, z1) = (a[2] for a in axes)
                low = [a[0] for a in axes]
                whole = sums[z0:z1, y0:y1, x0:x1] // total
                parts = [(True, (x0, y0, z0), whole)] if whole.size else []
                if not whole.size:
                    parts.append((False, (0, 0, 0), sums))
                else:  # what is around the whole ones
                    nz, ny, nx = sums.shape
                    around = [(slice(0, z0), slice(0, ny), slice(0, nx)), (slice(z1, nz), slice(0, ny), slice(0, nx)), (slice(z0, z1), slice(0, y0), slice(0, nx)), (slice(z0, z1), slice(y1, ny), slice(0, nx)), (slice(z0, z1), slice(y0, y1), slice(0, x0)), (slice(z0, z1), slice(y0, y1), slice(x1, nx))]
                    parts += [(False, (s[2].start, s[1].start, s[0].start), sums[s]) for s in around if sums[s].size]
                at = pa.array(np.zeros(len(parts), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[k.take(at) for k in own], pa.array([p[0] for p in parts]), *[pa.array([low[i] + p[1][i] for p in parts], pa.int64()) for i in range(3)],
                     pa.array([list(p[2].shape[::-1]) for p in parts], pa.list_(pa.int32())), pa.array([p[2].reshape(-1) for p in parts], pa.list_(pa.int64()))],
                    names=[*keys, "whole", "x0", "y0", "z0", "size", "data"],
                )

    # Both parts of the result come from one pass.
    out = settled(image.boxes.mapInArrow(shrink, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "whole boolean", _BOX])))
    boxes = out.where("whole").drop("whole")
    partial = Image(out.where("not whole").drop("whole"), image.voxels.where("false"), size, keys).as_voxels()
    weight, inside = F.lit(1), F.lit(True)
    for a, f, n in zip("xyz", factors, size):
        reach = (F.floor(F.col(a) / f) + 1) * f - (n - 1)
        weight = weight * F.when(F.col(a) == n - 1, F.greatest(reach, F.lit(1))).otherwise(1)
        inside = inside & (F.floor(F.col(a) / f) < max(1, n // f))
    voxels = image.voxels.where(inside).select(*keys, *[F.floor(F.col(a) / f).cast("long").alias(a) for a, f in zip("xyz", factors)], (F.col("v") * weight).cast("long").alias("v"))
    summed = settled(partial.unionByName(voxels).groupBy(*keys, "x", "y", "z").agg(F.floor(F.sum("v") / total).cast("long").alias("v")))
    return Image(boxes, summed, tuple(max(1, n // f) for n, f in zip(size, factors)), keys)


def pyramid(image: Image, resolutions: Sequence[Sequence[int]], least_saving: int = 8) -> list[Image]:
    """All levels, each from the finer level that the plan names or from the original."""
    levels: list[Image] = []
    for k, r in enumerate(resolutions):
        if k == 0 and all(f == 1 for f in r):
            levels.append(image)
            continue
        finer = source_level(resolutions, k, least_saving)
        base = resolutions[finer] if finer is not None else [1, 1, 1]
        levels.append(downsample(levels[finer] if finer is not None else image, [a // b for a, b in zip(r, base)]))
    return levels


def chunks(image: Image, cell: Sequence[int]) -> DataFrame:
    """keys, gx, gy, gz, size, data: the image in chunks of one size, cut at its edge; values that are not there are 0, chunks without any don't come.

    Boxes are cut where they lie into their parts of chunks; a chunk's parts
    meet in one task.
    """
    keys, size = image.keys, image.size
    kinds = {f.name: f.dataType.simpleString() for f in image.boxes.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                first = [row.column(c)[0].as_py() for c in ("x0", "y0", "z0")]
                shape = row.column("size")[0].as_py()
                data = row.column("data").flatten().to_numpy(zero_copy_only=False).reshape(shape[::-1])
                spans = [[(g, max(a, g * c), min(a + n, g * c + c)) for g in range(a // c, (a + n - 1) // c + 1)] for a, n, c in zip(first, shape, cell)]
                parts = [(x, y, z) for z in spans[2] for y in spans[1] for x in spans[0]]
                pick = lambda p: data[tuple(slice(s[1] - f, s[2] - f) for s, f in zip(p[::-1], first[::-1]))].reshape(-1)  # noqa: B023, E731
                at = pa.array(np.zeros(len(parts), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[row.column(k).take(at) for k in keys], *[pa.array([p[i][0] for p in parts], pa.int32()) for i in range(3)], *[pa.array([p[i][1] for p in parts], pa.int64()) for i in range(3)],
                     pa.array([[s[2] - s[1] for s in p] for p in parts], pa.list_(pa.int32())), pa.array([pick(p) for p in parts], pa.list_(pa.int64()))],
                    names=[*keys, "gx", "gy", "gz", "x0", "y0", "z0", "size", "data"],
                )

    typed = [f"`{k}` {kinds[k]}" for k in keys]
    parts = image.boxes.mapInArrow(cut, ", ".join([*typed, "gx int, gy int, gz int", _BOX]))
    single = image.voxels.select(*keys, *[F.floor(F.col(a) / c).cast("int").alias(f"g{a}") for a, c in zip("xyz", cell)], *[F.col(a).alias(f"{a}0") for a in "xyz"], F.array(F.lit(1), F.lit(1), F.lit(1)).alias("size"), F.array(F.col("v")).alias("data"))

    def join(group: tuple, table: pa.Table) -> pa.Table:
        place = [v.as_py() for v in group[len(keys) :]]
        origin = [g * c for g, c in zip(place, cell)]
        shape = [min(c, n - o) for c, n, o in zip(cell, size, origin)]
        out = np.zeros(shape[::-1], np.int64)
        for r in table.select(["x0", "y0", "z0", "size", "data"]).to_pylist():
            at = [r[c] - o for c, o in zip(("x0", "y0", "z0"), origin)]
            out[tuple(slice(a, a + n) for a, n in zip(at[::-1], r["size"][::-1]))] = np.reshape(r["data"], r["size"][::-1])
        return pa.table([*[pa.array([v.as_py()], v.type) for v in group], pa.array([shape], pa.list_(pa.int32())), pa.array([out.reshape(-1)], pa.list_(pa.int64()))], names=[*keys, "gx", "gy", "gz", "size", "data"])

    return parts.unionByName(single).groupBy(*keys, "gx", "gy", "gz").applyInArrow(join, ", ".join([*typed, "gx int, gy int, gz int, size array<int>, data array<long>"]))
