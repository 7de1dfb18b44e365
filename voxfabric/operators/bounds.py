"""Bounding boxes in the world, intervals, and editing of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.functions import affine

AXES = "xyz"


def world_bounds(boxes: DataFrame, model: affine.Affine, whole: bool, keys: Sequence[str] = ()) -> DataFrame:
    """The box of all transformed boxes; whole: its bounds cut to whole numbers (towards 0), else real up to the voxels' far edge."""
    low = [F.col(f"min_{a}") for a in AXES]
    high = [F.col(f"max_{a}") + (0 if whole else 1) for a in AXES]
    bounds = affine.box_bounds(model, low, high)
    out = []
    for a, (x, y) in zip(AXES, bounds):
        for c, name in ((F.min(x), f"min_{a}"), (F.max(y), f"max_{a}")):
            out.append((c.cast("long") if whole else c).alias(name))
    return boxes.groupBy(*keys).agg(*out)


def union(boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest box that holds all."""
    return boxes.groupBy(*keys).agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES])


def intersection(boxes: DataFrame, other: Sequence[tuple[int, int]]) -> DataFrame:
    """Each box cut to another; empty ones go."""
    cut = {}
    for a, (low, high) in zip(AXES, other):
        cut[f"min_{a}"], cut[f"max_{a}"] = F.greatest(f"min_{a}", F.lit(low)), F.least(f"max_{a}", F.lit(high))
    return boxes.withColumns(cut).where(" and ".join(f"min_{a} <= max_{a}" for a in AXES))


def corners(boxes: DataFrame, model: affine.Affine = affine.IDENTITY) -> DataFrame:
    """The eight corners: adds corner and its transformed x, y, z."""
    out = boxes.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = [affine.corner(F.col(f"min_{a}"), F.col(f"max_{a}"), F.col("corner"), i) for i, a in enumerate(AXES)]
    return out.withColumns(dict(zip(AXES, affine.apply(model, *at))))


def grown(box: dict[str, Column], by: float) -> dict[str, Column]:
    """Bounds moved outwards (inwards if negative)."""
    return {k: v - by if k.startswith("min") else v + by for k, v in box.items()}


def rounded(box: dict[str, Column]) -> dict[str, Column]:
    """Bounds at the nearest whole numbers, halves up."""
    return {k: F.floor(v + 0.5).cast("long") for k, v in box.items()}
