"""A whole frame: cull, place, sample, colour and fuse all visible sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.functions.scalars import to_color
from voxfabric.operators import fusing, sampling, screen


def render(sources: DataFrame, blocks: DataFrame, viewer: affine.Affine, width: int, height: int, cell: Sequence[int], average: bool = False) -> DataFrame:
    """px, py, a, r, g, b of the plane z = 0 of the viewer through all sources; pixels that no source covers don't come.

    sources: source_id, box (min_x ..., max_z), culled, model, cmin, cmax,
    color. blocks: source_id, gx, gy, gz, data. A source becomes the lines of
    its rectangle on the screen, each cut to the pixels inside the source's
    box; a line joins each chunk that it goes through and becomes pixels
    there. So the work follows what is seen, and what is shuffled before the
    fusion is lines and chunks. Settings go along with the lines.
    """
    placed = sources.withColumn("to_screen", affine.compose(viewer, "model"))
    seen = screen.screen_rectangle(screen.cull(placed, "to_screen", width, height), width, height)
    box = [f"{m}_{a}" for a in "xyz" for m in ("min", "max")]
    carried = ["source_id", *box, "x0", "x1", "cmin", "cmax", "color"]
    rows = seen.select(*carried, affine.inverse("to_screen").alias("back"), F.explode(F.sequence("y0", "y1")).alias("py"))
    back = affine.entries("back")
    places = {f"o_{a}": back[4 * i + 1] * F.col("py") + back[4 * i + 3] for i, a in enumerate("xyz")} | {f"d_{a}": back[4 * i] for i, a in enumerate("xyz")}
    lines = sampling.computed(rows, places).drop("back")
    samples = sampling.nearest_on_lines(lines, blocks, cell, ["source_id"])
    colors = samples.select("px", "py", *[c.alias(k) for k, c in to_color(F.col("v"), F.col("cmin"), F.col("cmax"), F.col("color")).items()])
    return fusing.blend_average(colors) if average else fusing.blend_sum(colors)
