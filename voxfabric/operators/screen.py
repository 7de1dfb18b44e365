"""From sources to the screen: culling, resolution levels, tiles.

Sources and tiles number in the thousands; the joins here are by rectangle,
made equi-joins by cutting the plane into bins of the tile size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators.sampling import computed
from voxfabric.sources.scratch import settled

#: Pairs of rectangles that one task compares, about (a fixed value).
PAIRS = 50_000_000


def screen_bounds(sources: DataFrame, to_screen: affine.Affine, margin: float = 0.5) -> DataFrame:
    """Adds s_min_x .. s_max_z, the bounds on the screen of each source's box grown by margin (0.5: nearest neighbour, 1: linear)."""
    low = [F.col(f"min_{a}") - F.lit(margin) for a in "xyz"]
    high = [F.col(f"max_{a}") + F.lit(margin) for a in "xyz"]
    bounds = affine.box_bounds(to_screen, low, high)
    # Filters on them would compute them once more in each of their terms.
    return computed(sources, {f"s_{m}_{a}": b[i] for a, b in zip("xyz", bounds) for i, m in enumerate(("min", "max"))})


def cull(sources: DataFrame, to_screen: affine.Affine, width: int, height: int, margin: float = 0.5) -> DataFrame:
    """Sources that may be seen: those that opt out of culling, and those whose bounds touch the screen and the plane z = 0."""
    bounded = screen_bounds(sources, to_screen, margin)
    near = (F.col("s_max_x") >= 0) & (F.col("s_min_x") <= width - 1) & (F.col("s_max_y") >= 0) & (F.col("s_min_y") <= height - 1)
    near = near & (F.col("s_min_z") <= 0) & (F.col("s_max_z") >= 0)
    return bounded.where(~F.col("culled") | near)


def screen_rectangle(bounded: DataFrame, width: int, height: int) -> DataFrame:
    """Adds x0, y0, x1, y1: the bounds rounded outwards and clipped to the screen, where empty ones go; the whole screen for sources that opt out of culling."""
    sides = {
        "x0": F.greatest(F.floor("s_min_x"), F.lit(0)),
        "y0": F.greatest(F.floor("s_min_y"), F.lit(0)),
        "x1": F.least(F.ceil("s_max_x"), F.lit(width - 1)),
        "y1": F.least(F.ceil("s_max_y"), F.lit(height - 1)),
    }
    screen = {"x0": 0, "y0": 0, "x1": width - 1, "y1": height - 1}
    out = bounded.withColumns({k: F.when(F.col("culled"), v).otherwise(screen[k]).cast("long") for k, v in sides.items()})
    return out.where("x0 <= x1 and y0 <= y1")


def rendered_pixels(rectangles: DataFrame, width: int, height: int) -> DataFrame:
    """pixels: how many source pixels a frame takes; per_pixel: sources to a pixel of the screen, on average."""
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    total = F.coalesce(F.sum(area), F.lit(0)).cast("long")
    return rectangles.agg(total.alias("pixels"), (total / (width * height)).alias("per_pixel"))


def cull_cells(cells: DataFrame, to_screen: affine.Affine, width: int, height: int, below: float = 1.0, above: float = 0.0) -> DataFrame:
    """Chunks (min_x, size_x, ..) whose voxels a slice may touch: box grown by `below` and `above`, projected, against the viewport and z = 0."""
    low = [F.col(f"min_{a}") - F.lit(below) for a in "xyz"]
    high = [F.col(f"min_{a}") + F.col(f"size_{a}") - 1 + F.lit(above) for a in "xyz"]
    (x0, x1), (y0, y1), (z0, z1) = affine.box_bounds(to_screen, low, high)
    return cells.where((x1 >= 0) & (x0 < width) & (y1 >= 0) & (y0 < height) & (z0 <= 0) & (z1 >= 0))


def level_distance(to_screen: Column) -> Column:
    """How far a level's voxels are from screen pixels: the squared distance of a pixel's two sides, in voxels, from 1.

    A pixel's sides are the first two columns of the inverse map: cofactors
    over the determinant, each named once.
    """
    p = affine.entries(to_screen)
    x = [p[5] * p[10] - p[6] * p[9], p[6] * p[8] - p[4] * p[10], p[4] * p[9] - p[5] * p[8]]
    y = [p[2] * p[9] - p[1] * p[10], p[0] * p[10] - p[2] * p[8], p[1] * p[8] - p[0] * p[9]]
    det = F.nullif(F.abs(p[0] * x[0] + p[1] * x[1] + p[2] * x[2]), F.lit(0.0))
    side = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) / det - 1
    return F.pow(side(x), F.lit(2)) + F.pow(side(y), F.lit(2))


def nearest_level(to_screen: Sequence[affine.Affine]) -> Column:
    """distance and level of that of a source's levels, given by their maps, whose voxels are nearest to pixels; of equals the finer one."""
    near = [F.struct(level_distance(m).alias("distance"), F.lit(i).alias("level")) for i, m in enumerate(to_screen)]
    return F.least(*near) if len(near) > 1 else near[0]


def best_level(levels: DataFrame, keys: Sequence[str], to_screen: str | Sequence[affine.Affine] = "to_screen") -> DataFrame:
    """Per key the level whose voxels are nearest to pixels; of equals the finer one.

    levels: rows of keys, level and a map, or, if to_screen lists the maps of
    all levels, rows of keys. Only distances go to the grouping, in the latter
    case one a row.
    """
    near = F.struct(level_distance(F.col(to_screen)).alias("distance"), "level") if isinstance(to_screen, str) else nearest_level(to_screen)
    return levels.select(*keys, near.alias("near")).groupBy(*keys).agg(F.min("near")["level"].alias("best"))


def level_order(best: DataFrame, keys: Sequence[str], new_timepoint: bool, count: str = "num_levels") -> DataFrame:
    """The levels to draw in order, with the priority of fetching each.

    At a new timepoint the best and then the coarsest are drawn, fetched the
    other way round; else all from the best to the coarsest, fetched from the
    coarsest on.
    """
    last = F.col(count) - 1
    if new_timepoint:
        levels = F.when(F.col("best") == last, F.array("best")).otherwise(F.array(F.col("best"), last))
    else:
        levels = F.sequence(F.col("best"), last)
    out = best.select(*keys, F.size(levels).alias("n"), F.posexplode(levels).alias("render_order", "level"))
    return out.select(*keys, "level", F.col("render_order").cast("long").alias("render_order"), (F.col("n") - 1 - F.col("render_order")).cast("long").alias("fetch_order"))


def screen_scale(frames: DataFrame, estimates: Sequence[str], target: Column) -> DataFrame:
    """Adds scale: the first screen scale whose estimated time meets the target, else the last."""
    out = F.lit(len(estimates) - 1)
    for i in reversed(range(len(estimates))):
        out = F.when(F.col(estimates[i]) <= target, i).otherwise(out)
    return frames.withColumn("scale", out.cast("long"))


def scaled_screen(width: Column, height: Column, scale: Column) -> dict[str, Column]:
    """Size of a scaled screen image, and the shift of its map (a pixel's centre stays where it is)."""
    shift = scale * 0.5 - 0.5
    return {"width": F.ceil(width * scale).cast("long"), "height": F.ceil(height * scale).cast("long"), "shift": shift}


def scaled_interval(rectangles: DataFrame, width: int, height: int, scale: Column) -> DataFrame:
    """Adds i_x0, i_y0, i_x1, i_y1: rectangles of the screen in its scaled image, rounded outwards and clipped to it."""
    size = scaled_screen(F.lit(width), F.lit(height), scale)
    low = {f"i_{a}0": F.greatest(F.lit(0), F.floor(F.col(f"{a}0") * scale)).cast("long") for a in "xy"}
    high = {f"i_{a}1": F.least(size[n] - 1, F.ceil(F.col(f"{a}1") * scale)).cast("long") for a, n in (("x", "width"), ("y", "height"))}
    return rectangles.withColumns(low | high)


def tiles(width: int, height: int, size: int, spark) -> DataFrame:
    """tile_id, x0, y0, x1, y1 of the tiles of a screen; the last ones are cut."""
    nx, ny = -(-width // size), -(-height // size)
    k = F.col("id")
    x, y = (k % nx) * size, F.floor(k / nx) * size
    return spark.range(nx * ny).select(k.alias("tile_id"), x.alias("x0"), y.alias("y0"), F.least(x + size - 1, F.lit(width - 1)).cast("long").alias("x1"), F.least(y + size - 1, F.lit(height - 1)).cast("long").alias("y1"))


def tile_members(rectangles: DataFrame, width: int, size: int) -> DataFrame:
    """tile_id, source_id: each source with each tile its rectangle overlaps.

    As the bins are the tiles, listing a rectangle's bins is the join itself:
    no source meets another's tiles, and nothing is shuffled.
    """
    nx = -(-width // size)
    over = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / size), F.floor(F.col(f"{a}1") / size)))
    return rectangles.withColumn("tx", over("x")).withColumn("ty", over("y")).select((F.col("ty") * nx + F.col("tx")).cast("long").alias("tile_id"), "source_id")


def overlapping(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs of rectangles (x0, y0, x1, y1; right's with prefix r_) that overlap, by an equi-join on bins.

    A pair that shares several bins is kept in the one that holds the upper
    left corner of its intersection. A bin's work is the product of its two
    sides: the left ones of full bins are dealt out to blocks, to each of which
    the right ones go, so that a task compares about PAIRS rectangles, however
    many lie in one place. There are as many tasks as that takes.
    """
    bins, corner = ["bin_x", "bin_y"], {p: [f"{p}bin_{a}0" for a in "xy"] for p in ("", "r_")}

    def binned(df: DataFrame, p: str) -> DataFrame:
        for a, first in zip("xy", corner[p]):
            low, high = (F.floor(F.col(f"{p}{a}{i}") / size) for i in (0, 1))
            df = df.withColumn(first, low).withColumn(f"bin_{a}", F.explode(F.sequence(low, high)))
        return df

    spark, one, two = left.sparkSession, binned(left, ""), binned(right, "r_")
    work = F.col("n_left") * F.col("n_right")
    sides = [df.groupBy(*bins).agg(F.count("*").alias(n)) for df, n in ((one, "n_left"), (two, "n_right"))]
    # A row per bin of the plane.
    blocks = settled(sides[0].join(sides[1], bins).select(*bins, work.alias("work"), F.ceil(work / PAIRS).cast("int").alias("blocks")))
    total = blocks.agg(F.sum("work")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
    dealt = one.join(F.broadcast(blocks), bins).withColumn("block", F.pmod(F.xxhash64(*left.columns), F.col("blocks")).cast("int"))
    given = two.join(F.broadcast(blocks), bins).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    on = [*bins, "block"]
    one, two = (df.drop("work", "blocks").repartition(n, *on) for df in (dealt, given))
    both = one.hint("merge").join(two, on)
    for a in "xy":
        both = both.where((F.col(f"{a}0") <= F.col(f"r_{a}1")) & (F.col(f"r_{a}0") <= F.col(f"{a}1")) & (F.greatest(f"bin_{a}0", f"r_bin_{a}0") == F.col(f"bin_{a}")))
    return both.drop(*on, *corner[""], *corner["r_"])


def strips(tiles_: DataFrame, rows: int) -> DataFrame:
    """Tiles cut into strips of a number of rows: adds y0, y1 of each strip."""
    starts = F.explode(F.sequence(F.col("y0"), F.col("y1"), F.lit(rows).cast("long")))
    return tiles_.withColumn("strip_y0", starts).withColumn("strip_y1", F.least(F.col("strip_y0") + rows - 1, F.col("y1")))


def equal_strips(tiles_: DataFrame, most: int) -> DataFrame:
    """Tiles cut into strips of equal height (but the last) of about `most` pixels: adds strip_y0, strip_y1."""
    height, area = F.col("y1") - F.col("y0") + 1, (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    step = F.when(area < most, height).otherwise(F.ceil(height / F.ceil(area / most)))
    cut = tiles_.withColumn("strip_rows", step.cast("long")).withColumn("strip_y0", F.explode(F.sequence(F.col("y0"), F.col("y1"), F.col("strip_rows"))))
    return cut.withColumn("strip_y1", F.least(F.col("strip_y0") + F.col("strip_rows") - 1, F.col("y1"))).drop("strip_rows")


def split_candidate(rectangles: DataFrame) -> DataFrame:
    """split_x: where to halve the screen, the middle one of the rectangles' distinct left and right edges."""
    edges = F.array_sort(F.collect_set("edge"))
    # A rectangle's edges are whole pixels, so there are no more of them than the screen is wide.
    listed = rectangles.select(F.explode(F.array("x0", F.col("x1") + 1)).alias("edge")).agg(edges.alias("edges"))
    return listed.select(F.get("edges", F.floor(F.size("edges") / 2).cast("int")).alias("split_x"))
