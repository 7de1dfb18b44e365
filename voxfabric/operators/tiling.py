"""A screen cut into tiles along the edges of what is seen."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.sources.scratch import settled

#: Tiles of so many pixels or fewer are not split, and those for rendering are cut to about so many (fixed values).
LEAST, MOST = 64, 1024
#: Most sources of a tile that one task splits to the end.
CROWD = 10_000
#: Rows of tiles and sources that one task makes, about, of sources that are in every tile (a fixed value).
ROWS = 5_000_000


def split_tiles(rects: np.ndarray, tile: tuple[int, int, int, int], least: int = LEAST) -> list[tuple[tuple[int, int, int, int], np.ndarray]]:
    """Tiles (x0, y0, x1, y1) with the numbers of the rectangles (rows of the same) that overlap each.

    A tile is halved at the middle one of the edges of rectangles inside it,
    of its longer side if there are any, else of the other.
    """
    done, open_ = [], [(tile, np.arange(len(rects)))]
    while open_:
        (x0, y0, x1, y1), own = open_.pop()
        sides = [(x1 - x0 + 1, 0, x0, x1), (y1 - y0 + 1, 1, y0, y1)]
        edges = np.zeros(0, np.int64)
        if sides[0][0] * sides[1][0] > least:
            for _, d, low, high in sorted(sides, key=lambda s: (-s[0], -s[1])):
                edges = np.unique(np.concatenate([rects[own, d], rects[own, d + 2] + 1]))
                edges = edges[(edges > low) & (edges <= high)]
                if len(edges):
                    break
        if not len(edges):
            done.append(((x0, y0, x1, y1), own))
            continue
        at = int(edges[len(edges) // 2])
        lower = (x0, y0, at - 1, y1) if d == 0 else (x0, y0, x1, at - 1)
        upper = (at, y0, x1, y1) if d == 0 else (x0, at, x1, y1)
        open_ += [(upper, own[rects[own, d + 2] >= at]), (lower, own[rects[own, d] < at])]
    return done


def strips_of(tile: tuple[int, int, int, int], most: int = MOST) -> list[tuple[int, int, int, int]]:
    """A tile cut into strips of equal height of about `most` pixels."""
    x0, y0, x1, y1 = tile
    width, height = x1 - x0 + 1, y1 - y0 + 1
    if width * height < most:
        return [tile]
    h = math.ceil(height / math.ceil(width * height / most))
    return [(x0, y, x1, min(y + h - 1, y1)) for y in range(y0, y1 + 1, h)]


_RECT = ("r_x0", "r_y0", "r_x1", "r_y1")
_TILE = ("x0", "y0", "x1", "y1")


def _splits(members: DataFrame, tiles: DataFrame, frame: Sequence[str], least: int) -> DataFrame:
    """frame, path, axis, at: where tiles are halved, the middle one of the distinct edges inside; tiles that no edge cuts, or of `least` pixels or fewer, don't come."""
    edges = members.select(*frame, "path", *_TILE, F.explode(F.array(*[F.struct(F.lit(d).alias("axis"), e.alias("at")) for d, a in enumerate("xy") for e in (F.col(f"r_{a}0"), F.col(f"r_{a}1") + 1)])).alias("e"))
    edges = edges.select(*frame, "path", *_TILE, "e.*").where(F.when(F.col("axis") == 0, (F.col("at") > F.col("x0")) & (F.col("at") <= F.col("x1"))).otherwise((F.col("at") > F.col("y0")) & (F.col("at") <= F.col("y1"))))
    # Edges are whole pixels: no more of them than the screen is wide and high.
    found = edges.groupBy(*frame, "path").agg(*[F.array_sort(F.collect_set(F.when(F.col("axis") == d, F.col("at")))).alias(f"edges_{d}") for d in (0, 1)])
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    other = lambda d: F.when(F.size(f"edges_{d}") > 0, d).otherwise(1 - d)
    plan = tiles.where(w * h > least).join(found, [*frame, "path"]).where("size(edges_0) + size(edges_1) > 0").withColumn("axis", F.when(h >= w, other(1)).otherwise(other(0)))
    own = F.when(F.col("axis") == 0, F.col("edges_0")).otherwise(F.col("edges_1"))
    return plan.select(*frame, "path", *_TILE, "axis", F.get(own, F.floor(F.size(own) / 2).cast("int")).alias("at"))


def _halves(df: DataFrame, others: Sequence[str]) -> DataFrame:
    """Both halves of tiles with axis and at: path grows by 0 or 1, side tells which."""
    both = df.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = lambda d: F.col("axis") == d
    low, high = F.col("side") == 1, F.col("side") == 0
    x0, y0 = (F.when(cut(d) & low, F.col("at")).otherwise(F.col(c)) for d, c in ((0, "x0"), (1, "y0")))
    x1, y1 = (F.when(cut(d) & high, F.col("at") - 1).otherwise(F.col(c)) for d, c in ((0, "x1"), (1, "y1")))
    return both.select(*others, F.concat("path", F.col("side").cast("string")).alias("path"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def split_level(members: DataFrame, tiles: DataFrame, frame: Sequence[str], least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of splitting of all frames at once: members and tiles after it, and the tiles that stay as they are.

    members: frame, path, source_id, the tile (x0 ...) and the rectangle (r_x0
    ...) of each source in each tile; tiles: frame, path, x0, y0, x1, y1.
    """
    plan = settled(_splits(members, tiles, frame, least))
    on = [*frame, "path"]
    stay = tiles.join(plan.select(*on), on, "left_anti")
    moved = _halves(members.join(plan.select(*on, "axis", "at"), on), [*frame, "source_id", *_RECT])
    moved = moved.where("r_x0 <= x1 and r_x1 >= x0 and r_y0 <= y1 and r_y1 >= y0")
    return moved, _halves(plan, frame), stay


def adaptive_tiles(rectangles: DataFrame, keys: Sequence[str], width: int, height: int, least: int = LEAST, most: int = MOST, crowd: int = CROWD, depth: int | None = None) -> DataFrame:
    """keys, tile_id, x0, y0, x1, y1, source_id: per frame the tiles for rendering and the sources of each; tiles without sources have null.

    rectangles: keys, source_id, culled, x0, y0, x1, y1. Sources that opt out
    of culling are in every tile and split none. While a tile has more than
    `crowd` sources, tiles are split level by level, all frames at once; what
    is left of each such tile is split by one task. depth: no more than so
    many levels. Tiles are numbered from the upper left one of the first
    split on.
    """
    frame = list(keys)
    spark = rectangles.sparkSession
    wide = rectangles.select(*frame, "source_id", "culled", *[F.col(c).cast("long").alias(f"r_{c}") for c in _TILE])
    frames = wide.select(*frame).distinct()
    whole = [F.lit("").alias("path"), *[F.lit(v).cast("long").alias(c) for c, v in zip(_TILE, (0, 0, width - 1, height - 1))]]
    members, tiles = wide.where("culled").select(*frame, "source_id", *_RECT, *whole), frames.select(*frame, *whole)
    quiet_members, quiet_tiles, level = [], [], 0
    while depth is None or level < depth:
        counts = members.groupBy(*frame, "path").agg(F.count("*").alias("n"))
        crowded = settled(counts.where(F.col("n") > (crowd if depth is None else 0)).select(*frame, "path"))
        if crowded.isEmpty():
            break
        on = [*frame, "path"]
        quiet_members.append(members.join(crowded, on, "left_anti"))
        quiet_tiles.append(tiles.join(crowded, on, "left_anti"))
        held, open_ = settled(members.join(crowded, on, "left_semi")), settled(tiles.join(crowded, on, "left_semi"))
        members, split, stay = split_level(held, open_, frame, least)
        members, tiles, stay, level = settled(members), settled(split), settled(stay), level + 1
        quiet_tiles.append(stay)  # no edge cuts these, however many their sources
        quiet_members.append(held.join(stay.select(*on), on, "left_semi"))
    names = [*frame, "source_id", *_RECT, "path", *_TILE]
    all_members, all_tiles = members.select(names), tiles.select(*frame, "path", *_TILE)
    for m in quiet_members:
        all_members = all_members.unionByName(m.select(names))
    for t in quiet_tiles:
        all_tiles = all_tiles.unionByName(t.select(*frame, "path", *_TILE))
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema.fields}
    head = "".join(f"`{k}` {kinds[k]}, " for k in frame)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        """A tile split to the end; a row without a source is the tile itself."""
        first = group.iloc[0]
        own = group[group.source_id.notna()]
        rects, ids = own[list(_RECT)].to_numpy(np.int64), own.source_id.to_numpy()
        out = []
        for number, (tile, inside) in enumerate(split_tiles(rects, tuple(int(first[c]) for c in _TILE), least if depth is None else 1 << 62)):
            for k, strip in enumerate(strips_of(tile, most)):
                out += [(first.path, number, k, *strip, s) for s in [*ids[inside].tolist()] or [None]]
        found = pd.DataFrame(out, columns=["path", "number", "strip", *_TILE, "source_id"]).astype({"source_id": "Int64"})
        for k in reversed(frame):
            found.insert(0, k, first[k])
        return found

    alone = all_tiles.select(*frame, F.lit(None).cast(kinds["source_id"]).alias("source_id"), *[F.lit(0).cast("long").alias(c) for c in _RECT], "path", *_TILE)
    # A task a tile, nearly: by their bytes, all would go to a few.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * all_tiles.count())
    cut = all_members.unionByName(alone).repartition(n, *frame, "path").groupBy(*frame, "path").applyInPandas(finish, head + "path string, number int, strip int, x0 long, y0 long, x1 long, y1 long, source_id long")
    cut = settled(cut)
    place = [*frame, "path", "number", "strip"]
    # A frame has no more tiles than the screen has pixels.
    order = Window.partitionBy(*frame).orderBy("path", "number", "strip")
    numbered = settled(cut.select(*place, *_TILE).distinct().withColumn("tile_id", F.row_number().over(order).cast("long") - 1))
    always = wide.where("not culled").select(*frame, F.col("source_id").cast("long").alias("source_id"))
    everywhere = _in_every(numbered.select(*frame, "tile_id", *_TILE), always, frame)
    given = cut.where("source_id is not null").select(*place, "source_id").join(numbered, place).select(*frame, "tile_id", *_TILE, "source_id")
    bare = numbered.join(given.select(*frame, "tile_id").distinct(), [*frame, "tile_id"], "left_anti").join(always.select(*frame).distinct(), frame, "left_anti")
    return given.unionByName(everywhere).unionByName(bare.select(*frame, "tile_id", *_TILE, F.lit(None).cast("long").alias("source_id")))


def _in_every(tiles: DataFrame, always: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Each source of a frame in each of its tiles: tiles are dealt out to blocks of about ROWS rows, to each of which the frame's sources go."""
    sides = [df.groupBy(*frame).agg(F.count("*").alias(n)) for df, n in ((tiles, "n_tiles"), (always, "n_always"))]
    work = F.col("n_tiles") * F.col("n_always")
    # A row per frame.
    blocks = settled(sides[0].join(sides[1], list(frame)).select(*frame, work.alias("work"), F.ceil(work / ROWS).cast("int").alias("blocks")))
    total = blocks.agg(F.sum("work")).first()[0] or 0
    n = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    on = [*frame, "block"]
    dealt = tiles.join(F.broadcast(blocks), list(frame)).withColumn("block", F.pmod(F.col("tile_id"), F.col("blocks")).cast("int")).drop("work", "blocks")
    given = always.join(F.broadcast(blocks), list(frame)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("work", "blocks")
    return dealt.repartition(n, *on).hint("merge").join(given.repartition(n, *on), on).select(*frame, "tile_id", *_TILE, "source_id")
