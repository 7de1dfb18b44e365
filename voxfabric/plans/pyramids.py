"""Planning of resolution pyramids: block sizes, levels, and what each level is computed from.

These are closed formulas over one image's size, so they run on the driver or
as expressions; the pixels follow the plan in operators.pyramid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BLOCK_ELEMENTS = 4096
COARSEST_SIZE = 256
LOOP_BACK = 8


def block_size(voxel_scale: Sequence[float], max_elements: int = MAX_BLOCK_ELEMENTS, image: Sequence[int] | None = None) -> list[int]:
    """A power-of-two block that is as close to a cube in the world as its elements allow.

    Each axis has an ideal, real number of bits; it gets the whole ones, no
    more than cover the image, and the bits left over go one by one to the
    axis that is furthest below its ideal (earlier axes first on a tie). Once
    the block covers the image, the first axis takes the rest.
    """
    n = len(voxel_scale)
    bits = math.log2(max_elements)
    mean = (bits + sum(math.log2(v) for v in voxel_scale)) / n
    ideal = [mean - math.log2(v) for v in voxel_scale]
    caps = [max(0, math.ceil(math.log2(s))) for s in image] if image else [math.inf] * n
    got = [min(max(0, int(i)), c) for i, c in zip(ideal, caps)]
    while sum(got) + 1 <= bits:
        below = [d for d in range(n) if got[d] < caps[d]] or [0]
        got[max(below, key=lambda d: ideal[d] - got[d] + 0.01 * (n - d))] += 1
    return [1 << b for b in got]


def propose(size: Sequence[int], voxel: Sequence[float], max_elements: int = MAX_BLOCK_ELEMENTS) -> list[dict]:
    """Levels from full resolution until no side is longer than 256: resolution and block size of each.

    Each step halves the axes whose voxels are at most twice as long as the
    shortest (and which have more than one voxel left), or all of them if
    there is none.
    """
    resolution = [1] * len(size)
    levels = []
    shortest = min(voxel)
    scale = [v / shortest for v in voxel]
    while True:
        now = [max(1, s // r) for s, r in zip(size, resolution)]
        at = [v * r for v, r in zip(scale, resolution)]
        levels.append({"resolution": list(resolution), "subdivision": block_size([a / min(at) for a in at], max_elements, now)})
        if max(now) <= COARSEST_SIZE:
            return levels
        near = [d for d in range(len(size)) if at[d] / min(at) <= 2 and now[d] > 1]
        for d in near or range(len(size)):
            resolution[d] *= 2


def source_level(resolutions: Sequence[Sequence[int]], level: int, least_saving: int = LOOP_BACK) -> int | None:
    """The finer level that a level is computed from, None for the original image.

    It is the nearest one whose factors divide this level's, if it spares at
    least eight times the reading.
    """
    for finer in range(level - 1, -1, -1):
        if all(a % b == 0 for a, b in zip(resolutions[level], resolutions[finer])):
            return finer if math.prod(resolutions[finer]) >= least_saving * math.prod(resolutions[0]) else None
    return None


def tile_levels(width: int, height: int, tile_width: int, tile_height: int) -> int:
    """One level, and one more for each halving that leaves the image larger than a tile both ways."""
    n = 1
    while width >> n > tile_width and height >> n > tile_height:
        n += 1
    return n


def tile_levels_of(width: Column, height: Column, tile_width: int, tile_height: int) -> Column:
    """The same for columns."""
    larger = F.filter(F.sequence(F.lit(1), F.lit(62)), lambda k: (F.call_function("shiftright", width, k) > tile_width) & (F.call_function("shiftright", height, k) > tile_height))
    return F.size(larger) + 1


def tile_level(width: int, height: int, depth: int, z_scale: float, level: int) -> dict:
    """Factors and size of a tile pyramid's level: z follows x and y where its voxels are longer."""
    xy = 1 << level
    z = max(1, math.floor(xy / z_scale + 0.5))
    return {"resolution": [xy, xy, z], "size": [width >> level, height >> level, depth // z]}
