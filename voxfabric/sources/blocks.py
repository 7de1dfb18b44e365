"""Chunked arrays: chunks to voxels and back, padding, missing chunks.

A chunk is a row: its place in the grid (gx, gy, gz) and its values, x
fastest. Chunks are what is stored and shuffled; voxels are a view of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.functions.scalars import cell_count


def explode_blocks(blocks: DataFrame, cell: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """x, y, z, v of every value of chunks of one size; keep names further columns."""
    cx, cy, cz = cell
    rows = blocks.select(*keep, "gx", "gy", "gz", F.posexplode("data").alias("i", "v"))
    i = F.col("i")
    return rows.select(
        *keep,
        (F.col("gx").cast("long") * cx + i % cx).alias("x"),
        (F.col("gy").cast("long") * cy + F.floor(i / cx) % cy).alias("y"),
        (F.col("gz").cast("long") * cz + F.floor(i / (cx * cy))).alias("z"),
        "v",
    )


def extent(blocks: DataFrame, cell: Sequence[int]) -> tuple[int, int, int]:
    """The size of the volume that chunks of one size lie in, from its origin to the last chunk of each axis; 0 without chunks."""
    last = blocks.agg(*[F.max(g) for g in ("gx", "gy", "gz")]).first()
    return tuple((-1 if g is None else g) * n + n for g, n in zip(last, cell))


def collect_blocks(voxels: DataFrame, cell: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Voxels to chunks of one size; values that are not there are 0."""
    cx, cy, cz = cell
    g = [F.floor(F.col(c) / n).cast("long") for c, n in zip("xyz", cell)]
    at = (F.pmod("x", F.lit(cx)) + cx * (F.pmod("y", F.lit(cy)) + cy * F.pmod("z", F.lit(cz)))).cast("int")
    grouped = voxels.select(*keys, *[c.alias(n) for c, n in zip(g, ("gx", "gy", "gz"))], at.alias("i"), "v").groupBy(*keys, "gx", "gy", "gz")
    # A chunk has cx * cy * cz values at most. What is missing is put in as zeros, then all are sorted by place.
    found = grouped.agg(F.collect_list(F.struct("i", "v")).alias("m"))
    kind = voxels.schema["v"].dataType
    missing = F.array_except(F.sequence(F.lit(0), F.lit(cx * cy * cz - 1)), F.col("m.i"))
    zeros = F.transform(missing, lambda i: F.struct(i.alias("i"), F.lit(0).cast(kind).alias("v")))
    data = F.transform(F.array_sort(F.concat("m", zeros)), lambda e: e["v"])
    return found.select(*keys, "gx", "gy", "gz", data.alias("data"))


def pad_block(data: Column, have: Sequence[Column], cell: Sequence[int]) -> Column:
    """A chunk of another size laid into one of the full size, zeros around it; null gives zeros alone."""
    cx, cy, cz = cell
    hx, hy, hz = have

    def value(i: Column) -> Column:
        x, y, z = i % cx, F.floor(i / cx) % cy, F.floor(i / (cx * cy))
        inside = (x < hx) & (y < hy) & (z < hz)
        return F.when(inside, F.get(data, (x + hx * (y + hy * z)).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(cx * cy * cz - 1)), lambda i: F.coalesce(value(i), F.lit(0)))


def fill_missing(blocks: DataFrame, grid: DataFrame, cell: Sequence[int], keys: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """All chunks of a grid; those that are not stored are zeros."""
    zeros = F.array_repeat(F.lit(0), cell[0] * cell[1] * cell[2])
    return grid.join(blocks, list(keys), "left").withColumn("data", F.coalesce("data", zeros))


def grid_of(dims: DataFrame, cell: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """One row per chunk of images of size dim_x, dim_y, dim_z: its place, first voxel and size; chunks at the edge are cut."""
    n = {a: cell_count(F.col(f"dim_{a}"), F.lit(c)) for a, c in zip("xyz", cell)}
    out = dims
    for a in "xyz":
        out = out.withColumn(f"g{a}", F.explode(F.sequence(F.lit(0).cast("long"), n[a] - 1)))
    sizes = [F.least(F.lit(c).cast("long"), F.col(f"dim_{a}") - F.col(f"g{a}") * c).alias(f"size_{a}") for a, c in zip("xyz", cell)]
    return out.select(*keys, "gx", "gy", "gz", *[(F.col(f"g{a}") * c).alias(f"min_{a}") for a, c in zip("xyz", cell)], *sizes)
