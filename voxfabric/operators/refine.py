"""Progressive rendering: best value so far, patches, and frame times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_available(samples: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """Per pixel the value of the finest level that is valid (not null), its level, and whether the pixel is final; 0 where none is."""
    known = F.col("v").isNotNull()
    best = samples.groupBy(*keys).agg(F.min_by("v", F.when(known, F.col("level"))).alias("v"), F.min(F.when(known, F.col("level"))).alias("level"))
    return best.select(*keys, F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("level", F.lit(levels)).cast("long").alias("level"), (F.coalesce("level", F.lit(levels)) == 0).alias("final"))


def patch(image: DataFrame, new: DataFrame, rectangle: tuple[int, int, int, int], scale: int = 1) -> DataFrame:
    """An image (px, py, v) with a rectangle (x0, y0, x1, y1) repainted from new, which has one pixel per scale * scale of them."""
    x0, y0, x1, y1 = rectangle
    inside = F.col("px").between(x0, x1) & F.col("py").between(y0, y1)
    coarse = new.select(F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("v").alias("new"))
    at = image.withColumns({"cx": F.floor(F.col("px") / scale), "cy": F.floor(F.col("py") / scale)})
    painted = at.join(coarse, ["cx", "cy"], "left")
    return painted.select("px", "py", F.when(inside, F.coalesce("new", F.lit(0))).otherwise(F.col("v")).cast("long").alias("v"))


def moving_average(frames: DataFrame, order: str, value: str, keys: Sequence[str] = (), width: int = 3, initial: float = 500.0) -> DataFrame:
    """Adds average: of the last `width` values, the initial one standing for those not there yet."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)
    return frames.withColumn("average", (F.sum(value).over(w) + F.lit(initial) * (width - F.count("*").over(w))) / width)
