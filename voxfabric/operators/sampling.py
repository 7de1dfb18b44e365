"""Sampling volumes at the pixels of a plane, and cropping.

A pixel is mapped back into each source, and what it needs of the volume is
an equi-join on the chunk or voxel that this names: one row for the nearest
voxel, eight for linear interpolation. Outside a volume the value is 0 and
the mask tells how much of the weight lies inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.functions import affine


def pixels(spark, width: int, height: int) -> DataFrame:
    """px, py of a screen."""
    k = F.col("id")
    return spark.range(width * height).select((k % width).alias("px"), F.floor(k / width).alias("py"))


def into_source(points: DataFrame, back: affine.Affine, x: str = "px", y: str = "py", z: Column | None = None) -> DataFrame:
    """Adds sx, sy, sz: where pixels (at z, 0 by default) lie in a source's own coordinates."""
    at = affine.apply(back, F.col(x), F.col(y), z if z is not None else F.lit(0))
    return points.withColumns(dict(zip(("sx", "sy", "sz"), at)))


def nearest(points: DataFrame, voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds v and mask: the value of the voxel nearest to (sx, sy, sz), by floor(s + 1/2); 0 and 0 where there is none."""
    at = points.withColumns({a: F.floor(F.col(f"s{a}") + 0.5).cast("long") for a in "xyz"})
    found = at.join(voxels, [*keys, "x", "y", "z"], "left")
    return found.select(*points.columns, F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.col("v").isNotNull().cast("long").alias("mask"))


def nearest_in_blocks(points: DataFrame, blocks: DataFrame, cell: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """The same from chunks, which are not exploded: a pixel joins its chunk and picks one value."""
    at = {a: F.floor(F.col(f"s{a}") + 0.5).cast("long") for a in "xyz"}
    placed = points.withColumns({f"g{a}": F.floor(at[a] / n).cast("int") for a, n in zip("xyz", cell)})
    i = F.pmod(at["x"], F.lit(cell[0])) + cell[0] * (F.pmod(at["y"], F.lit(cell[1])) + cell[1] * F.pmod(at["z"], F.lit(cell[2])))
    found = placed.join(blocks, [*keys, "gx", "gy", "gz"], "left")
    v = F.get("data", i.cast("int"))
    return found.select(*points.columns, F.coalesce(v, F.lit(0)).cast("long").alias("v"), v.isNotNull().cast("long").alias("mask"))


#: Pixels far off any screen.
_FAR = 1e15


def _span(origin: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The px, as doubles, at which origin + px * step enters and leaves [low, high]; a span that is empty where it never does."""
    near = lambda c: F.least(F.greatest(c, F.lit(-_FAR)), F.lit(_FAR))
    first, last = near((low - origin) / F.nullif(step, F.lit(0.0))), near((high - origin) / F.nullif(step, F.lit(0.0)))
    inside = (low <= origin) & (origin <= high)
    flat = step == 0
    return F.when(flat, F.when(inside, -_FAR).otherwise(_FAR)).otherwise(F.least(first, last)), F.when(flat, F.when(inside, _FAR).otherwise(-_FAR)).otherwise(F.greatest(first, last))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, each computed once: by a generator, as a projection is repeated in all later expressions that name it."""
    others = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("made")
    return df.select(*others, made).select(*others, "made.*")


def clip_lines(lines: DataFrame, bounds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Lines (x0, x1; at px they lie at o_x + px * d_x, ...) cut to where they may be inside of bounds, by up to a pixel more at either end; lines that never are go."""
    spans = [_span(F.col(f"o_{a}"), F.col(f"d_{a}"), *bounds[a]) for a in "xyz"]
    first, last = F.greatest(*[b[0] for b in spans]), F.least(*[b[1] for b in spans])
    ends = {"x0": F.greatest("x0", F.ceil("first").cast("long") - 1), "x1": F.least("x1", F.floor("last").cast("long") + 1)}
    return computed(computed(lines, {"first": first, "last": last}), ends).drop("first", "last").where("x0 <= x1")


def nearest_on_lines(lines: DataFrame, blocks: DataFrame, cell: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Adds px and v: what nearest_in_blocks() gives at the pixels x0 to x1 of lines, without those that no stored voxel covers.

    A line joins each chunk that it goes through once, and becomes pixels
    after that: what is shuffled is lines, however many pixels they have, and
    chunks. lines: o_x, d_x, .., the place of px 0 and the step to the next
    pixel, min_x, max_x, .., the source's box, whole chunks from 0.
    """
    half = {a: (F.col(f"min_{a}") - 0.5, F.col(f"max_{a}") + 0.5) for a in "xyz"}
    cut = clip_lines(lines, half)
    voxel = lambda a, px: F.floor(F.col(f"o_{a}") + px * F.col(f"d_{a}") + 0.5)
    chunk = lambda a, n, px: F.floor(voxel(a, px) / n).cast("int")
    # A line's chunk changes where an axis crosses a border: the chunks at the pixels beside all crossings are all there are.
    beside = [F.array("x0", "x1")]
    for a, n in zip("xyz", cell):
        ends = chunk(a, n, F.col("x0")), chunk(a, n, F.col("x1"))
        borders = F.when(F.abs(ends[0] - ends[1]) > 0, F.sequence(F.least(*ends) + 1, F.greatest(*ends))).otherwise(F.array().cast("array<int>"))
        at = lambda k: F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), (k * n - 0.5 - F.col(f"o_{a}")) / F.nullif(F.col(f"d_{a}"), F.lit(0.0))))  # noqa: B023, E731
        for rounded, step in ((F.ceil, -1), (F.floor, 0), (F.floor, 1)):
            beside.append(F.transform(borders, lambda k: (rounded(at(k)) + step).cast("long")))  # noqa: B023
    pixels_ = F.filter(F.concat(*beside), lambda p: p.between(F.col("x0"), F.col("x1")))
    chunks = F.array_distinct(F.transform(pixels_, lambda p: F.struct(*[chunk(a, n, p).alias(f"g{a}") for a, n in zip("xyz", cell)])))
    names = lines.columns
    runs = cut.select(*names, F.explode(chunks).alias("chunk")).select(*names, "chunk.*")
    runs = clip_lines(runs, {a: (F.col(f"g{a}") * n - 0.5, (F.col(f"g{a}") + 1) * n - 0.5) for a, n in zip("xyz", cell)})
    # Few bytes become many pixels here, so the number of tasks must not follow the bytes.
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = runs.repartition(tasks, *keys, "gx", "gy", "gz").join(blocks, [*keys, "gx", "gy", "gz"]).withColumn("px", F.explode(F.sequence("x0", "x1")))
    at = {a: voxel(a, F.col("px")) for a in "xyz"}
    for a, n in zip("xyz", cell):  # a pixel at a border belongs to one of the chunks that meet there
        found = found.where((F.floor(at[a] / n) == F.col(f"g{a}")) & at[a].between(F.col(f"min_{a}"), F.col(f"max_{a}")))
    i = F.pmod(at["x"], F.lit(cell[0])) + cell[0] * (F.pmod(at["y"], F.lit(cell[1])) + cell[1] * F.pmod(at["z"], F.lit(cell[2])))
    return found.select(*names, "px", F.get("data", i.cast("int")).cast("long").alias("v")).where("v is not null")


def _corners(points: DataFrame) -> DataFrame:
    """Each point's corners that have a weight, eight at most: adds x, y, z, weight."""
    base = {a: F.floor(f"s{a}") for a in "xyz"}
    part = {a: F.col(f"s{a}") - base[a] for a in "xyz"}
    n = F.col("corner")
    asked = points.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    weight, corner = F.lit(1.0), {}
    for axis, a in enumerate("xyz"):
        far = F.getbit(n, F.lit(axis)).cast("int")
        corner[a] = (base[a] + far).cast("long")
        weight = weight * F.when(far == 1, part[a]).otherwise(1 - part[a])
    return asked.withColumns({**corner, "weight": weight}).where("weight > 0")


def _weighed(found: DataFrame, v: Column, id_columns: Sequence[str]) -> DataFrame:
    inside = F.when(v.isNotNull(), F.col("weight")).otherwise(0.0)
    return found.groupBy(*id_columns).agg(F.sum(F.col("weight") * F.coalesce(v, F.lit(0))).alias("v"), F.sum(inside).alias("mask"))


def linear_in_blocks(points: DataFrame, blocks: DataFrame, cell: Sequence[int], id_columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """linear() from chunks, which are not exploded: a point's corners join the chunks they lie in and pick one value each."""
    asked = _corners(points)
    placed = asked.withColumns({f"g{a}": F.floor(F.col(a) / n).cast("int") for a, n in zip("xyz", cell)})
    i = F.pmod("x", F.lit(cell[0])) + cell[0] * (F.pmod("y", F.lit(cell[1])) + cell[1] * F.pmod("z", F.lit(cell[2])))
    found = placed.join(blocks, [*keys, "gx", "gy", "gz"], "left")
    return _weighed(found, F.get("data", i.cast("int")), id_columns)


def linear(points: DataFrame, voxels: DataFrame, id_columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation: id_columns with v (a double) and mask, the weight of corners inside the volume.

    Each point asks for the corners around it that have a weight, eight at
    most; their weighted sum is a map-side aggregation by point.
    """
    found = _corners(points).join(voxels, [*keys, "x", "y", "z"], "left")
    return _weighed(found, F.col("v"), id_columns)


def crop_interval(box: Sequence[tuple[float, float]], back: affine.Affine, image: Sequence[tuple[int, int]], border: int = 0) -> dict[str, Column]:
    """The closed interval of an image that holds a world box: min_x, max_x, ...

    The box is mapped into the image, rounded outwards, cut to the image and
    grown by the border. If nothing is left, it is the one voxel at the box's
    centre.
    """
    low, high = [F.lit(float(b[0])) for b in box], [F.lit(float(b[1])) for b in box]
    bounds = affine.box_bounds(back, low, high)
    cut = [(F.greatest(F.floor(b[0]), F.lit(i[0])), F.least(F.ceil(b[1]), F.lit(i[1]))) for b, i in zip(bounds, image)]
    empty = F.lit(False)
    for a, b in cut:
        empty = empty | (a > b)
    out = {}
    for name, (a, b), bound in zip("xyz", cut, bounds):
        centre = F.floor((bound[0] + bound[1]) / 2 + 0.5)
        out[f"min_{name}"] = (F.when(empty, centre).otherwise(a) - border).cast("long")
        out[f"max_{name}"] = (F.when(empty, centre).otherwise(b) + border).cast("long")
    return out


def crop(voxels: DataFrame, interval: Sequence[tuple[int, int]]) -> DataFrame:
    """The voxels of a closed interval, moved to begin at 0."""
    inside = F.lit(True)
    for a, (low, high) in zip("xyz", interval):
        inside = inside & F.col(a).between(low, high)
    return voxels.where(inside).withColumns({a: F.col(a) - low for a, (low, _) in zip("xyz", interval)})


def in_box(interval: Sequence[tuple[float, float]], inside: int, outside: int) -> Column:
    """The value of a box source at x, y, z: closed bounds."""
    within = F.lit(True)
    for a, (low, high) in zip("xyz", interval):
        within = within & F.col(a).between(low, high)
    return F.when(within, inside).otherwise(outside)
