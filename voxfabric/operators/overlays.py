"""Overlays: points, boxes and polygons as seen on the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators.bounds import corners

#: The edges of a box as pairs of corners that differ in one bit.
EDGES = [(a, a | 1 << d) for d in range(3) for a in range(8) if not a >> d & 1]


def project(x: Column, y: Column, z: Column, perspective: bool, scale: float, depth: float, origin: tuple[float, float, float]) -> tuple[Column, Column]:
    """A point seen from a camera at distance depth: screen x and y about the origin."""
    f = F.lit(scale * depth) / (z - origin[2]) if perspective else F.lit(float(scale))
    return (x - origin[0]) * f, (y - origin[1]) * f


def points(found: DataFrame, to_screen: affine.Affine) -> DataFrame:
    """Points of interest on the screen: left, top, size and alpha; those far from the plane are fainter."""
    x, y, z = affine.apply(to_screen, F.col("x"), F.col("y"), F.col("z"))
    size = F.when(F.abs(z) < 3, 5).otherwise(3)
    whole = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    alpha = F.greatest(F.lit(64), 255 - F.floor(F.abs(z) + 0.5)).cast("long")
    return found.withColumns({"left": whole(x - size / 2), "top": whole(y - size / 2), "size": size.cast("long"), "alpha": alpha})


def box_edges(boxes: DataFrame, key: str, to_screen: affine.Affine) -> DataFrame:
    """The 12 edges of boxes on the screen: key, edge, ends, whether each end is in front (z <= 0), and where the edge crosses z = 0."""
    spots = corners(boxes, to_screen).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("corner", F.struct("x", "y", "z")))).alias("at"))
    edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES])
    rows = spots.select(key, "at", F.posexplode(edges).alias("edge", "ends"))
    rows = rows.select(key, F.col("edge").cast("long").alias("edge"), F.element_at("at", F.col("ends.a")).alias("p"), F.element_at("at", F.col("ends.b")).alias("q"))
    cross = (F.col("p.z") <= 0) != (F.col("q.z") <= 0)
    part = F.col("p.z") / F.nullif(F.col("p.z") - F.col("q.z"), F.lit(0.0))
    on_plane = [F.when(cross, F.col(f"p.{c}") + part * (F.col(f"q.{c}") - F.col(f"p.{c}"))).alias(f"cross_{c}") for c in "xy"]
    return rows.select(key, "edge", (F.col("p.z") <= 0).alias("front_a"), (F.col("q.z") <= 0).alias("front_b"), *on_plane)


def section_polygons(edges: DataFrame, key: str) -> DataFrame:
    """The polygon in which each box meets the screen: its crossing points counter-clockwise about their centre. A box has six at most."""
    hit = edges.where("cross_x is not null").select(key, F.struct("cross_x", "cross_y").alias("p"))
    grouped = hit.groupBy(key).agg(F.collect_list("p").alias("ps"), F.avg("p.cross_x").alias("cx"), F.avg("p.cross_y").alias("cy"))
    angle = lambda p: F.atan2(p["cross_y"] - F.col("cy"), p["cross_x"] - F.col("cx"))
    ordered = F.array_sort(F.transform("ps", lambda p: F.struct(angle(p).alias("angle"), p["cross_x"].alias("x"), p["cross_y"].alias("y"))))
    return grouped.select(key, "cx", "cy", F.posexplode(ordered).alias("i", "p")).select(key, "cx", "cy", F.col("i").cast("long").alias("i"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
