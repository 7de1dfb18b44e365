"""Visibility, culling, levels and tiles."""

from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import bounds, catalog, overlays, screen, visibility
from voxfabric.queries.registry import query
from voxfabric.sources import blocks, derived
from voxfabric.sources.derived import with_sql
from voxfabric.streaming import state

WIDTH, HEIGHT = 1680, 997
#: Half size, moved: all numbers are dyadic, so both engines compute the same bounds.
VIEW = (0.5, 0.0, 0.0, 64.0, 0.0, 0.5, 0.25, 32.0, 0.0, 0.0, 1.0, 0.0)


def _shown(spark, sf_dir, mode, **current):
    s = derived.sources(spark, sf_dir)
    return visibility.visible(s, s.select("group_id", "source_id"), derived.groups(spark, sf_dir), mode, **current).select("source_id", "name")


@query(with_sql("sources", "SELECT source_id, name FROM sources WHERE source_id = 7"))
def visible_single(spark, sf_dir):
    return _shown(spark, sf_dir, "SINGLE", current_source=7)


@query(with_sql("sources", "SELECT source_id, name FROM sources WHERE group_id = 3"))
def visible_group(spark, sf_dir):
    return _shown(spark, sf_dir, "GROUP", current_group=3)


@query(with_sql("sources", "SELECT source_id, name FROM sources WHERE active"))
def visible_fused(spark, sf_dir):
    return _shown(spark, sf_dir, "FUSED")


@query(with_sql("sources groups", "SELECT source_id, s.name AS name FROM sources s JOIN groups_ g USING (group_id) WHERE g.active"))
def visible_fusedgroup(spark, sf_dir):
    return _shown(spark, sf_dir, "FUSEDGROUP")


@query(with_sql("sources views", "SELECT source_id, name FROM sources JOIN views ON source_id = setup_id WHERE active AND t = 3 AND present"))
def visible_present(spark, sf_dir):
    views = derived.views(spark, sf_dir).withColumnRenamed("t", "timepoint_id")
    return visibility.visible_and_present(_shown(spark, sf_dir, "FUSED"), views, 3)


@query(with_sql("sources", "SELECT group_id AS image_id, source_id, active AS visible, source_id IS NOT DISTINCT FROM min(CASE WHEN active THEN source_id END) OVER (PARTITION BY group_id) AS present FROM sources"))
def virtual_channel(spark, sf_dir):
    s = derived.sources(spark, sf_dir).select(F.col("group_id").alias("image_id"), "source_id", F.col("source_id").alias("ord"), F.col("active").alias("visible"))
    return visibility.virtual_channels(s).select("image_id", "source_id", "visible", "present")


@query(with_sql("sources", "SELECT group_id, arg_min(source_id, name) AS source_id FROM sources GROUP BY group_id"))
def first_of_group(spark, sf_dir):
    s = derived.sources(spark, sf_dir)
    order = catalog.dense_order(s.select("source_id", "name"), "name").select("source_id", F.col("index").alias("ord"))
    return visibility.first_of_group(s.select("group_id", "source_id"), order)


@query(with_sql("sources groups", "SELECT group_id, g.name AS name, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS sources FROM sources s JOIN groups_ g USING (group_id) GROUP BY group_id, g.name"))
def group_tree(spark, sf_dir):
    s = derived.sources(spark, sf_dir)
    tree = visibility.group_tree(s.select("group_id", "source_id"), derived.groups(spark, sf_dir), s.select("source_id", F.col("source_id").alias("ord")))
    return tree.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query(with_sql("log", """, s AS (SELECT session, event_id, sum(CASE WHEN kind IN ('mode', 'source') AND arg % 2 = 0 THEN 1 ELSE 0 END) OVER w % 2 AS f, sum(CASE WHEN kind IN ('mode', 'source') AND arg % 2 = 1 THEN 1 ELSE 0 END) OVER w % 2 AS g
FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT session, event_id, CASE WHEN f = 1 AND g = 1 THEN 'FUSEDGROUP' WHEN f = 1 THEN 'FUSED' WHEN g = 1 THEN 'GROUP' ELSE 'SINGLE' END AS mode FROM s""").replace("FROM events)\n,", "FROM events),"))
def mode_transitions(spark, sf_dir):
    """The display mode after each action of a log that switches fusing and grouping."""
    log = derived.event_log(spark, sf_dir)
    kind = F.when(F.col("kind").isin("mode", "source"), F.when(F.col("arg") % 2 == 0, "fused").otherwise("grouping")).otherwise(F.col("kind"))
    return state.modes_after(log.withColumn("kind", kind)).select("session", "event_id", "mode")


_BOUNDED = """bounded AS (
  SELECT *, 0.5*(min_x-0.5) + 64 AS sx0, 0.5*(max_x+0.5) + 64 AS sx1, 0.5*(min_y-0.5) + 0.25*(min_z-0.5) + 32 AS sy0, 0.5*(max_y+0.5) + 0.25*(max_z+0.5) + 32 AS sy1, min_z-0.5 AS sz0, max_z+0.5 AS sz1 FROM boxes),
seen AS (SELECT * FROM bounded WHERE NOT culled OR (sx1 >= 0 AND sx0 <= 1679 AND sy1 >= 0 AND sy0 <= 996 AND sz0 <= 0 AND sz1 >= 0)),
rects AS (SELECT * FROM (SELECT source_id, culled, CAST(greatest(floor(sx0), 0) AS BIGINT) AS x0, CAST(greatest(floor(sy0), 0) AS BIGINT) AS y0, CAST(least(ceil(sx1), 1679) AS BIGINT) AS x1, CAST(least(ceil(sy1), 996) AS BIGINT) AS y1 FROM seen WHERE culled) WHERE x0 <= x1 AND y0 <= y1
          UNION ALL SELECT source_id, culled, 0, 0, 1679, 996 FROM boxes WHERE NOT culled)
"""


def _sql(body):
    return with_sql("boxes", ",\n" + _BOUNDED + body).replace("FROM part)\n,\n", "FROM part),\n")


def _rectangles(spark, sf_dir):
    seen = screen.cull(derived.boxes(spark, sf_dir), VIEW, WIDTH, HEIGHT)
    return screen.screen_rectangle(seen, WIDTH, HEIGHT).select("source_id", "culled", "x0", "y0", "x1", "y1")


@query(_sql("SELECT source_id FROM seen"))
def cull_sources(spark, sf_dir):
    return screen.cull(derived.boxes(spark, sf_dir), VIEW, WIDTH, HEIGHT).select("source_id")


@query(_sql("SELECT source_id, x0, y0, x1, y1 FROM rects"))
def screen_rectangles(spark, sf_dir):
    return _rectangles(spark, sf_dir).drop("culled")


@query(_sql("SELECT CAST(sum((x1-x0+1)*(y1-y0+1)) AS BIGINT) AS pixels, sum((x1-x0+1)*(y1-y0+1))::DOUBLE / (1680*997) AS per_pixel FROM rects"))
def rendered_pixels(spark, sf_dir):
    return screen.rendered_pixels(_rectangles(spark, sf_dir), WIDTH, HEIGHT)


@query(_sql(""", k AS (SELECT *, [1.0, 0.75, 0.5, 0.25, 0.125][CAST(source_id % 5 + 1 AS INT)]::DOUBLE AS s FROM rects)
SELECT source_id, greatest(0, floor(x0 * s))::BIGINT AS i_x0, greatest(0, floor(y0 * s))::BIGINT AS i_y0, least(ceil(s * 1680) - 1, ceil(x1 * s))::BIGINT AS i_x1, least(ceil(s * 997) - 1, ceil(y1 * s))::BIGINT AS i_y1 FROM k"""))
def scaled_intervals(spark, sf_dir):
    """Each source's rectangle in one of the scaled screens."""
    scale = F.element_at(F.array(*[F.lit(v) for v in (1.0, 0.75, 0.5, 0.25, 0.125)]), (F.col("source_id") % 5 + 1).cast("int"))
    return screen.scaled_interval(_rectangles(spark, sf_dir), WIDTH, HEIGHT, scale).select("source_id", "i_x0", "i_y0", "i_x1", "i_y1")


_TILES = "tiles AS (SELECT ty * 27 + tx AS tile_id, tx * 64 AS tx0, ty * 64 AS ty0 FROM (SELECT unnest(range(0, 27)) AS tx), (SELECT unnest(range(0, 16)) AS ty))"


@query(_sql(", " + _TILES + " SELECT tile_id, source_id FROM tiles JOIN rects ON x0 <= tx0 + 63 AND x1 >= tx0 AND y0 <= ty0 + 63 AND y1 >= ty0"))
def tile_members(spark, sf_dir):
    return screen.tile_members(_rectangles(spark, sf_dir), WIDTH, 64)


@query(_sql(", " + _TILES + """ SELECT tile_id, count(*) AS sources, count(*) = 1 AS alone FROM tiles JOIN rects ON x0 <= tx0 + 63 AND x1 >= tx0 AND y0 <= ty0 + 63 AND y1 >= ty0 GROUP BY tile_id"""))
def tile_counts(spark, sf_dir):
    return screen.tile_members(_rectangles(spark, sf_dir), WIDTH, 64).groupBy("tile_id").agg(F.count("*").alias("sources"), (F.count("*") == 1).alias("alone"))


@query(_sql("SELECT a.source_id AS source_id, b.source_id AS other_id FROM rects a JOIN rects b ON a.source_id < b.source_id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 WHERE a.culled AND b.culled"))
def overlapping_sources(spark, sf_dir):
    r = _rectangles(spark, sf_dir).where("culled").drop("culled")
    other = r.select(*[F.col(c).alias("other_id" if c == "source_id" else f"r_{c}") for c in r.columns])
    return screen.overlapping(r, other, 64).where("source_id < other_id").select("source_id", "other_id")


@query(_sql(""", h AS (SELECT *, CAST(ceil((y1 - y0 + 1) / ceil((x1 - x0 + 1) * (y1 - y0 + 1) / 1024.0)) AS BIGINT) AS n FROM rects),
k AS (SELECT *, CASE WHEN (x1 - x0 + 1) * (y1 - y0 + 1) < 1024 THEN y1 - y0 + 1 ELSE n END AS step FROM h)
SELECT source_id, CAST(y AS BIGINT) AS strip_y0, least(y + step - 1, y1) AS strip_y1 FROM (SELECT source_id, y1, step, unnest(range(y0, y1 + 1, step)) AS y FROM k)"""))
def tile_strips(spark, sf_dir):
    """Rectangles on the screen cut into strips of equal height for rendering."""
    return screen.equal_strips(_rectangles(spark, sf_dir), 1024).select("source_id", "strip_y0", "strip_y1")


@query(_sql(", e AS (SELECT DISTINCT unnest([x0, x1 + 1]) AS edge FROM rects) SELECT list(edge ORDER BY edge)[count(*) // 2 + 1] AS split_x FROM e"))
def split_candidate(spark, sf_dir):
    return screen.split_candidate(_rectangles(spark, sf_dir))


@query("""
WITH l AS (SELECT p_partkey, unnest(range(0, 5)) AS level, 0.125::DOUBLE * (p_size % 16 + 1) AS zoom FROM part),
d AS (SELECT p_partkey, level, pow(1.0 / (zoom * pow(2.0, level)) - 1, 2) + pow(1.0 / (zoom * (1 + p_partkey % 5) * pow(2.0, level)) - 1, 2) AS dist FROM l)
SELECT p_partkey, CAST(arg_min(level, (dist, level)) AS BIGINT) AS best FROM d GROUP BY p_partkey""")
def best_level(spark, sf_dir):
    zoom = F.col("zoom")
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", (F.lit(0.125) * (F.col("p_size") % 16 + 1)).alias("zoom"))
    maps = [affine.scaling([zoom * f, zoom * f * (1 + F.col("p_partkey") % 5), F.lit(3.0 * f)], True) for f in (1.0, 2.0, 4.0, 8.0, 16.0)]
    return screen.best_level(rows, ["p_partkey"], maps).withColumn("best", F.col("best").cast("long"))


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 4 AS best, 4 AS n FROM part),
a AS (SELECT *, CASE WHEN best = 3 THEN [3] ELSE [best, 3] END AS ls FROM b),
z AS (SELECT *, range(best, 4) AS ls FROM b)
SELECT true AS moved, p_partkey, CAST(unnest(ls) AS BIGINT) AS level, CAST(unnest(range(0, len(ls))) AS BIGINT) AS render_order, CAST(len(ls) - 1 - unnest(range(0, len(ls))) AS BIGINT) AS fetch_order FROM a
UNION ALL SELECT false, p_partkey, unnest(ls), unnest(range(0, len(ls))), len(ls) - 1 - unnest(range(0, len(ls))) FROM z""")
def level_order(spark, sf_dir):
    b = derived.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("long").alias("best"), F.lit(4).cast("long").alias("num_levels"))
    both = [screen.level_order(b, ["p_partkey"], moved).withColumn("moved", F.lit(moved)) for moved in (True, False)]
    return both[0].unionByName(both[1])


@query("""SELECT p_partkey, CASE WHEN p_size * 1.0 <= 20 THEN 0 WHEN p_size * 0.5 <= 20 THEN 1 ELSE 2 END::BIGINT AS scale FROM part""")
def screen_scale(spark, sf_dir):
    frames = derived.table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_size") * s).alias(n) for n, s in (("e0", 1.0), ("e1", 0.5), ("e2", 0.25))])
    return screen.screen_scale(frames, ["e0", "e1", "e2"], F.lit(20.0)).select("p_partkey", "scale")


@query("""SELECT p_partkey, CAST(ceil(p_partkey % 2000 * s) AS BIGINT) AS width, CAST(ceil(p_size * s) AS BIGINT) AS height, s * 0.5 - 0.5 AS shift FROM (SELECT *, 1.0::DOUBLE / pow(2.0, p_partkey % 4) AS s FROM part)""")
def scaled_screen(spark, sf_dir):
    s = F.lit(1.0) / F.pow(F.lit(2.0), F.col("p_partkey") % 4)
    out = screen.scaled_screen(F.col("p_partkey") % 2000, F.col("p_size"), s)
    return derived.table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in out.items()])


@query("""
WITH c AS (SELECT r_regionkey AS setup_id, 8 * gx AS min_x, 8 * gy AS min_y, 4 * gz AS min_z, least(8, 60 + r_regionkey - 8 * gx) AS size_x, least(8, 50 - 8 * gy) AS size_y, least(4, 30 - 4 * gz) AS size_z, gx, gy, gz
FROM region, (SELECT unnest(range(0, 8)) AS gx), (SELECT unnest(range(0, 7)) AS gy), (SELECT unnest(range(0, 8)) AS gz)),
b AS (SELECT *, 0.5*(min_x-1) - 8 AS x0, 0.5*(min_x+size_x-1) - 8 AS x1, 0.5*(min_y-1) + 0.25*(min_z-1) - 4 AS y0, 0.5*(min_y+size_y-1) + 0.25*(min_z+size_z-1) - 4 AS y1, (min_z-1) + 0.25*(min_x-1) - 12 AS z0, (min_z+size_z-1) + 0.25*(min_x+size_x-1) - 12 AS z1 FROM c)
SELECT CAST(setup_id AS BIGINT) AS setup_id, gx, gy, gz FROM b WHERE x1 >= 0 AND x0 < 16 AND y1 >= 0 AND y0 < 12 AND z0 <= 0 AND z1 >= 0""")
def cull_cells(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    dims = derived.table(spark, sf_dir, "region").select(k.alias("setup_id"), (k + 60).alias("dim_x"), F.lit(50).cast("long").alias("dim_y"), F.lit(30).cast("long").alias("dim_z"))
    cells = blocks.grid_of(dims, (8, 8, 4), ["setup_id"])
    view = (0.5, 0.0, 0.0, -8.0, 0.0, 0.5, 0.25, -4.0, 0.25, 0.0, 1.0, -12.0)
    return screen.cull_cells(cells, view, 16, 12).select("setup_id", "gx", "gy", "gz")


@query(with_sql("boxes", """
SELECT CAST(min(trunc(0.5*min_x + 64)) AS BIGINT) AS min_x, CAST(max(trunc(0.5*max_x + 64)) AS BIGINT) AS max_x, CAST(min(trunc(0.5*min_y + 0.25*min_z + 32)) AS BIGINT) AS min_y, CAST(max(trunc(0.5*max_y + 0.25*max_z + 32)) AS BIGINT) AS max_y,
CAST(min(min_z) AS BIGINT) AS min_z, CAST(max(max_z) AS BIGINT) AS max_z FROM boxes"""))
def world_bbox_int(spark, sf_dir):
    return bounds.world_bounds(derived.boxes(spark, sf_dir), VIEW, whole=True)


@query(with_sql("boxes", """
SELECT culled, min(0.5*min_x + 64) AS min_x, max(0.5*(max_x+1) + 64) AS max_x, min(0.5*min_y + 0.25*min_z + 32) AS min_y, max(0.5*(max_y+1) + 0.25*(max_z+1) + 32) AS max_y, min(min_z)::DOUBLE AS min_z, max(max_z + 1)::DOUBLE AS max_z FROM boxes GROUP BY culled"""))
def world_bbox_real(spark, sf_dir):
    return bounds.world_bounds(derived.boxes(spark, sf_dir), VIEW, whole=False, keys=["culled"])


@query(with_sql("boxes", "SELECT source_id, greatest(min_x, 100) AS min_x, least(max_x, 900) AS max_x, greatest(min_y, 50) AS min_y, least(max_y, 700) AS max_y, greatest(min_z, -5) AS min_z, least(max_z, 5) AS max_z FROM boxes WHERE greatest(min_x, 100) <= least(max_x, 900) AND greatest(min_y, 50) <= least(max_y, 700) AND greatest(min_z, -5) <= least(max_z, 5)"))
def interval_intersection(spark, sf_dir):
    out = bounds.intersection(derived.boxes(spark, sf_dir), [(100, 900), (50, 700), (-5, 5)])
    return out.select("source_id", *[F.col(f"{m}_{a}").cast("long").alias(f"{m}_{a}") for a in "xyz" for m in ("min", "max")])


@query(with_sql("boxes", "SELECT culled, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM boxes GROUP BY culled"))
def interval_union(spark, sf_dir):
    return bounds.union(derived.boxes(spark, sf_dir), ["culled"])


@query(with_sql("boxes", """
SELECT source_id, CAST(trunc(0.5*min_x + 64 - (CASE WHEN abs(min_z) < 3 THEN 5 ELSE 3 END) / 2.0) AS BIGINT) AS "left", CAST(trunc(0.5*min_y + 0.25*min_z + 32 - (CASE WHEN abs(min_z) < 3 THEN 5 ELSE 3 END) / 2.0) AS BIGINT) AS top,
CASE WHEN abs(min_z) < 3 THEN 5 ELSE 3 END::BIGINT AS size, CAST(greatest(64, 255 - floor(abs(min_z) + 0.5)) AS BIGINT) AS alpha FROM boxes"""))
def points_overlay(spark, sf_dir):
    p = derived.boxes(spark, sf_dir).select("source_id", *[F.col(f"min_{a}").alias(a) for a in "xyz"])
    return overlays.points(p, VIEW).select("source_id", "left", "top", "size", "alpha")


@query(with_sql("boxes", """
SELECT source_id, 4 * (CASE WHEN min_z <= 0 AND max_z > 0 THEN 1 ELSE 0 END)::BIGINT AS crossing, CASE WHEN min_z <= 0 AND max_z > 0 THEN (0.5*min_x + 0.5*max_x)/2 + 64 END AS centre_x FROM boxes"""))
def box_edges(spark, sf_dir):
    edges = overlays.box_edges(derived.boxes(spark, sf_dir), "source_id", VIEW)
    return edges.groupBy("source_id").agg(F.count("cross_x").alias("crossing"), F.avg("cross_x").alias("centre_x"))


@query(with_sql("boxes", """, c AS (SELECT source_id, unnest([0, 1, 2, 3]) AS i, unnest([min_x, max_x, max_x, min_x]) AS px, unnest([min_y, min_y, max_y, max_y]) AS py FROM boxes WHERE min_z <= 0 AND max_z > 0)
SELECT source_id, CAST(i AS BIGINT) AS i, CAST(floor(1e3 * (0.5 * px + 64) + 0.5) AS BIGINT) AS x, CAST(floor(1e3 * (0.5 * py + 32) + 0.5) AS BIGINT) AS y FROM c""").replace("FROM part)\n,", "FROM part),"))
def section_polygon(spark, sf_dir):
    """The corners, in order, of the polygons in which boxes meet the screen, in thousandths of a pixel."""
    found = overlays.section_polygons(overlays.box_edges(derived.boxes(spark, sf_dir), "source_id", VIEW), "source_id")
    return found.select("source_id", "i", *[F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(c) for c in "xy"])


@query(with_sql("boxes", """, e AS (SELECT *, min_z <= 0 AND max_z > 0 AS cut FROM boxes)
SELECT source_id, CAST(d AS BIGINT) AS edge, CASE WHEN d >= 8 AND cut THEN CAST(floor(1e3 * (0.5 * (CASE WHEN d % 2 = 1 THEN max_x ELSE min_x END) + 64) + 0.5) AS BIGINT) END AS x,
CASE WHEN d >= 8 AND cut THEN CAST(floor(1e3 * (0.5 * (CASE WHEN d >= 10 THEN max_y ELSE min_y END) + 32) + 0.5) AS BIGINT) END AS y FROM e, (SELECT unnest(range(0, 12)) AS d)""").replace("FROM part)\n,", "FROM part),"))
def box_edge_crossings(spark, sf_dir):
    """Where each of the twelve edges of each box crosses the plane, if it does; the last four run along z."""
    edges = overlays.box_edges(derived.boxes(spark, sf_dir), "source_id", VIEW)
    return edges.select("source_id", "edge", *[F.floor(F.col(f"cross_{c}") * 1e3 + 0.5).cast("long").alias(c) for c in "xy"])


@query(with_sql("views", "SELECT setup_id, t, model[1] AS xx, model[2] AS xy, model[4] AS tx, model[5] AS yx, model[6] AS yy, model[8] AS ty FROM views"))
def overlay_plane(spark, sf_dir):
    """The two-dimensional part of each view's map, for overlays."""
    m = affine.plane_rows("model")
    return derived.views(spark, sf_dir).select("setup_id", "t", *[m[i].alias(n) for i, n in enumerate(("xx", "xy", "tx", "yx", "yy", "ty"))])


@query(with_sql("boxes", """SELECT source_id, CAST(floor(1e6 * (min_x - 840) * 500.0 / (min_z + 1000) + 0.5) AS BIGINT) AS px, (min_x - 840) * 0.5 AS ox FROM boxes"""))
def point_projection(spark, sf_dir):
    x, y, z = (F.col(f"min_{a}") for a in "xyz")
    near = overlays.project(x, y, z, True, 0.5, 1000.0, (840.0, 498.0, -1000.0))
    flat = overlays.project(x, y, z, False, 0.5, 1000.0, (840.0, 498.0, -1000.0))
    return derived.boxes(spark, sf_dir).select("source_id", F.floor(near[0] * 1e6 + 0.5).cast("long").alias("px"), flat[0].alias("ox"))
