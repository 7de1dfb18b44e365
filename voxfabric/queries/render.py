"""Sampling, colours, fusion, projections, contrast."""

from pyspark.sql import functions as F

from voxfabric.functions import scalars
from voxfabric.operators import contrast, frame, fusing, refine, sampling, scene
from voxfabric.queries.registry import query
from voxfabric.sources import derived
from voxfabric.sources.derived import with_sql

#: Screen to volume: an oblique plane with dyadic steps.
BACK = (0.5, 0.25, 0.0, -2.0, -0.25, 0.5, 0.0, 8.0, 0.125, 0.25, 1.0, 0.5)
SECOND = (0.5, 0.25, 0.0, 3.0, -0.25, 0.5, 0.0, 2.0, 0.125, 0.25, 1.0, 3.5)
WIDTH, HEIGHT = 64, 48
#: Chunks of the volume.
CELL = (4, 4, 4)

_PIXELS = "pix AS (SELECT px, py FROM (SELECT unnest(range(0, 64)) AS px), (SELECT unnest(range(0, 48)) AS py))"
_AT = "at1 AS (SELECT px, py, 0.5*px + 0.25*py - 2 AS sx, -0.25*px + 0.5*py + 8 AS sy, 0.125*px + 0.25*py + 0.5 AS sz FROM pix)"
_AT2 = "at2 AS (SELECT px, py, 0.5*px + 0.25*py + 3 AS sx, -0.25*px + 0.5*py + 2 AS sy, 0.125*px + 0.25*py + 3.5 AS sz FROM pix)"


def _near(n):
    return f"near{n} AS (SELECT px, py, coalesce(v, 0) AS v, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS mask FROM at{n} LEFT JOIN voxels ON x = floor(sx + 0.5) AND y = floor(sy + 0.5) AND z = floor(sz + 0.5))"


def _sql(parts, body):
    return with_sql("voxels", body).replace("FROM blocks))\n", "FROM blocks)),\n" + ",\n".join(parts) + "\n", 1)


def _points(spark, back=BACK):
    return sampling.into_source(sampling.pixels(spark, WIDTH, HEIGHT), back)


@query(_sql([_PIXELS, _AT, _near(1)], "SELECT px, py, v, CAST(mask AS BIGINT) AS mask FROM near1"))
def sample_nn(spark, sf_dir):
    return sampling.nearest(_points(spark), derived.voxels(spark, sf_dir)).select("px", "py", "v", "mask")


@query(_sql([_PIXELS, _AT, _near(1)], "SELECT px, py, v, CAST(mask AS BIGINT) AS mask FROM near1"))
def sample_nn_blocks(spark, sf_dir):
    return sampling.nearest_in_blocks(_points(spark), derived.blocks(spark, sf_dir), (4, 4, 4)).select("px", "py", "v", "mask")


_LINEAR = """lin AS (
  SELECT px, py, sum(w * coalesce(v, 0)) AS v, sum(CASE WHEN v IS NULL THEN 0 ELSE w END) AS mask FROM (
    SELECT px, py, floor(sx) + cx AS x, floor(sy) + cy AS y, floor(sz) + cz AS z,
           (CASE cx WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE cy WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE cz WHEN 1 THEN sz - floor(sz) ELSE 1 - sz + floor(sz) END) AS w
    FROM at1, (SELECT unnest([0, 1]) AS cx), (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cz)) a
  LEFT JOIN voxels USING (x, y, z) WHERE w > 0 GROUP BY px, py)"""


@query(_sql([_PIXELS, _AT, _LINEAR], "SELECT px, py, v::DOUBLE AS v, mask::DOUBLE AS mask FROM lin"))
def sample_nlinear(spark, sf_dir):
    return sampling.linear_in_blocks(_points(spark), derived.blocks(spark, sf_dir), CELL, ["px", "py"])


@query(_sql([_PIXELS, _AT, _near(1), _LINEAR], "SELECT 'NEAREST' AS mode, px, py, v::DOUBLE AS v FROM near1 UNION ALL SELECT 'LINEAR', px, py, v::DOUBLE FROM lin"))
def interpolation_choice(spark, sf_dir):
    """The same points by either interpolation, from voxels."""
    both = [scene.sample(_points(spark), derived.voxels(spark, sf_dir), m, ["px", "py"]).select(F.lit(m).alias("mode"), "px", "py", "v") for m in ("NEAREST", "LINEAR")]
    return both[0].unionByName(both[1])


def _two_sources(spark, sf_dir):
    """Two sources of one volume on the screen: samples with colours."""
    chunks = derived.blocks(spark, sf_dir)
    both = [sampling.nearest_in_blocks(_points(spark, b), chunks, CELL).select("px", "py", "v", "mask").withColumn("source_id", F.lit(i)) for i, b in enumerate((BACK, SECOND))]
    converters = spark.createDataFrame([(0, 28000.0, 37000.0, -16776961 + 65280), (1, 30000.0, 36000.0, -65536)], "source_id int, cmin double, cmax double, color int")
    colors = fusing.colored(both[0].unionByName(both[1]), F.broadcast(converters))
    return fusing.masked(colors, F.col("mask"))


_COLORS = """s AS (
  SELECT px, py, mask, CAST(least(255, greatest(0, floor((v - 28000.0) * 255 / 9000.0 + 0.5))) AS BIGINT) AS i, 0 AS k FROM near1
  UNION ALL SELECT px, py, mask, CAST(least(255, greatest(0, floor((v - 30000.0) * 255 / 6000.0 + 0.5))) AS BIGINT), 1 FROM near2),
c AS (SELECT px, py, k, 255 * mask AS a, CASE k WHEN 0 THEN 0 ELSE i END AS r, CASE k WHEN 0 THEN i ELSE 0 END AS g, CASE k WHEN 0 THEN i ELSE 0 END AS b FROM s)"""
_TWO = [_PIXELS, _AT, _AT2, _near(1), _near(2), _COLORS]


@query(_sql(_TWO, "SELECT px, py, CAST(k AS BIGINT) AS source_id, CAST(a AS BIGINT) AS a, r, g, b FROM c"))
def to_argb(spark, sf_dir):
    return _two_sources(spark, sf_dir).select("px", "py", F.col("source_id").cast("long").alias("source_id"), *"argb")


@query(_sql(_TWO, "SELECT px, py, CAST(least(255, sum(a)) AS BIGINT) AS a, CAST(least(255, sum(r)) AS BIGINT) AS r, CAST(least(255, sum(g)) AS BIGINT) AS g, CAST(least(255, sum(b)) AS BIGINT) AS b FROM c GROUP BY px, py"))
def blend_sum(spark, sf_dir):
    return fusing.blend_sum(_two_sources(spark, sf_dir))


@query(_sql(_TWO, "SELECT px, py, CAST(least(255, sum(a)) AS BIGINT) AS a, CAST(least(255, coalesce(sum(r*a) // nullif(sum(a), 0), 0)) AS BIGINT) AS r, CAST(least(255, coalesce(sum(g*a) // nullif(sum(a), 0), 0)) AS BIGINT) AS g, CAST(least(255, coalesce(sum(b*a) // nullif(sum(a), 0), 0)) AS BIGINT) AS b FROM c GROUP BY px, py"))
def blend_avg(spark, sf_dir):
    return fusing.blend_average(_two_sources(spark, sf_dir))


@query(_sql(_TWO, "SELECT px, py, CAST(max(a) AS BIGINT) AS a, max(r) AS r, max(g) AS g, max(b) AS b FROM c GROUP BY px, py"))
def blend_custom(spark, sf_dir):
    return fusing.blend_custom(_two_sources(spark, sf_dir), F.max)


@query(_sql(_TWO, """SELECT px, py, CAST(a * 16777216 + r * 65536 + g * 256 + b - CASE WHEN a >= 128 THEN 4294967296 ELSE 0 END AS BIGINT) AS argb FROM (
SELECT px, py, least(255, sum(a)) AS a, least(255, sum(r)) AS r, least(255, sum(g)) AS g, least(255, sum(b)) AS b FROM c GROUP BY px, py)"""))
def fused_slice(spark, sf_dir):
    """The flagship: an oblique plane through two sources, coloured, summed and packed."""
    fused = fusing.blend_sum(_two_sources(spark, sf_dir))
    return fused.select("px", "py", scalars.pack_argb(*[F.col(c) for c in "argb"]).cast("long").alias("argb"))


def _projection(spark, sf_dir):
    points = fusing.slices(sampling.pixels(spark, 32, 24), 6, 1.0)
    at = sampling.into_source(points, BACK, z=F.col("depth"))
    return sampling.nearest_in_blocks(at, derived.blocks(spark, sf_dir), CELL).withColumns({c: F.col("v") for c in "rgb"}).withColumns({"a": F.col("mask") * 255, "t": F.lit(0).cast("long")})


@query(_sql(["pix AS (SELECT px, py, d FROM (SELECT unnest(range(0, 32)) AS px), (SELECT unnest(range(0, 24)) AS py), (SELECT unnest(range(0, 6)) AS d))",
             "at1 AS (SELECT px, py, 0.5*px + 0.25*py - 2 AS sx, -0.25*px + 0.5*py + 8 AS sy, 0.125*px + 0.25*py + d + 0.5 AS sz FROM pix)", _near(1)],
            "SELECT CAST(0 AS BIGINT) AS t, px, py, CAST(max(mask) * 255 AS BIGINT) AS a, max(v) AS r, max(v) AS g, max(v) AS b FROM near1 GROUP BY px, py"))
def max_projection(spark, sf_dir):
    return fusing.max_projection(_projection(spark, sf_dir))


@query(with_sql("sparse", ", pix AS (SELECT t, px, py FROM (SELECT unnest(range(0, 7)) AS t), (SELECT unnest(range(0, 64)) AS px), (SELECT unnest(range(0, 64)) AS py)) SELECT k.setup AS setup, pix.t AS t, px, py, coalesce(v, 0) AS v FROM pix CROSS JOIN (SELECT unnest(range(0, 3)) AS setup) k LEFT JOIN sparse s ON s.t = pix.t AND s.setup = k.setup AND z = 2 AND x = px AND y = py").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def movie_frames(spark, sf_dir):
    """One frame per setup and timepoint, all in one job."""
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    frames = sampling.pixels(spark, 64, 64).withColumn("t", count(6)).withColumn("setup", count(2))
    at = frames.withColumns({"sx": F.col("px") * 1.0, "sy": F.col("py") * 1.0, "sz": F.lit(2.0)})
    vox = derived.sparse_voxels(spark, sf_dir).select(F.col("setup").cast("long").alias("setup"), F.col("t").cast("long").alias("t"), "x", "y", "z", "v")
    return sampling.nearest(at, vox, ["setup", "t"]).select("setup", "t", "px", "py", "v")


def _middle(spark, sf_dir):
    depth = derived.volume_size(spark, sf_dir)[2]
    return contrast.middle_slice(derived.voxels(spark, sf_dir), 0, depth - 1)


@query(with_sql("voxels", "SELECT CAST(least(6534, floor(v * 6535 / 65535.0)) AS BIGINT) AS bin, count(*) AS n FROM voxels WHERE z = (SELECT (max(z) + 1) // 2 FROM voxels) GROUP BY 1"))
def histogram(spark, sf_dir):
    return contrast.histogram(_middle(spark, sf_dir))


@query(with_sql("voxels", """, h AS (SELECT CAST(least(6534, floor(v * 6535 / 65535.0)) AS BIGINT) AS bin, count(*) AS n FROM voxels WHERE z = (SELECT (max(z) + 1) // 2 FROM voxels) GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h)
SELECT CAST(min(CASE WHEN upto >= total * 0.001::DOUBLE THEN (bin + 1) * 65535 // 6535 END) AS BIGINT) AS cmin, CAST(min(CASE WHEN upto >= total * 0.999::DOUBLE THEN (bin + 1) * 65535 // 6535 END) AS BIGINT) AS cmax FROM c""").replace("FROM blocks))\n,", "FROM blocks)),"))
def contrast_bounds(spark, sf_dir):
    return contrast.cut_offs(contrast.histogram(_middle(spark, sf_dir)))


@query(with_sql("sources", """SELECT source_id, CASE WHEN source_id % 3 = 0 AND active THEN 100 + source_id ELSE 0 END AS cmin, CASE WHEN source_id % 3 = 0 AND active THEN 9000 + source_id WHEN source_id % 3 = 1 THEN 255 ELSE 65535 END AS cmax FROM sources"""))
def range_by_type(spark, sf_dir):
    dtype = F.element_at(F.array(F.lit("uint16"), F.lit("uint8"), F.lit("float32")), (F.col("source_id") % 3 + 1).cast("int"))
    s = derived.sources(spark, sf_dir).select("source_id", dtype.alias("dtype"), F.col("active").alias("present"), (F.col("source_id") + 100).alias("cmin"), (F.col("source_id") + 9000).alias("cmax"))
    return contrast.range_by_type(s).select("source_id", "cmin", "cmax")


@query(with_sql("sources", "SELECT source_id, group_id, CASE WHEN group_id < 2 THEN 10 * group_id ELSE source_id END AS cmin, CASE WHEN group_id < 2 THEN 99 ELSE 50 + source_id END AS cmax FROM sources"))
def shared_range(spark, sf_dir):
    s = derived.sources(spark, sf_dir).select("source_id", "group_id", F.col("source_id").alias("cmin"), (F.col("source_id") + 50).alias("cmax"))
    changes = spark.range(2).select(F.col("id").alias("group_id"), (F.col("id") * 10).alias("cmin"), F.lit(99).cast("long").alias("cmax"))
    return contrast.share_range(s, changes).select("source_id", "group_id", "cmin", "cmax")


@query(with_sql("sparse", """SELECT x, y, z, coalesce(arg_min(v, (setup, t)), 0) AS v, CAST(min(setup) AS BIGINT) AS level, min(setup) = 0 AS final FROM sparse GROUP BY x, y, z"""))
def best_available_level(spark, sf_dir):
    samples = derived.sparse_voxels(spark, sf_dir)
    samples = samples.groupBy("x", "y", "z", F.col("setup").alias("level")).agg(F.min_by("v", "t").alias("v"))
    return refine.best_available(samples, ["x", "y", "z"], 3)


@query(_sql([_PIXELS, _AT, _near(1)], """SELECT a.px AS px, a.py AS py, CASE WHEN a.px BETWEEN 8 AND 39 AND a.py BETWEEN 4 AND 27 THEN coalesce(b.v, 0) ELSE a.v END AS v
FROM near1 a LEFT JOIN near1 b ON b.px = a.px // 2 AND b.py = a.py // 2"""))
def patch_region(spark, sf_dir):
    image = sampling.nearest(_points(spark), derived.voxels(spark, sf_dir)).select("px", "py", "v")
    return refine.patch(image, image, (8, 4, 39, 27), scale=2)


@query("""SELECT event_id, user_id, (sum(x) OVER w + 500.0 * (3 - count(*) OVER w)) / 3 AS average FROM (SELECT *, floor(value) AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)""")
def moving_average(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").alias("x"))
    return refine.moving_average(e, "event_id", "x", ["user_id"]).select("event_id", "user_id", "average")


@query(with_sql("voxels", "SELECT x, y, z, CAST(255 AS BIGINT) AS a, v // 256 AS r, v % 256 AS g, 255 - v // 256 AS b FROM voxels"))
def custom_converter(spark, sf_dir):
    """Voxels coloured by a function of one's own."""

    def two_bytes(values):
        high = values // 256
        return -(1 << 24) + high * 65536 + values % 256 * 256 + 255 - high

    return fusing.colored_by(derived.voxels(spark, sf_dir), two_bytes).drop("v")


@query(with_sql("voxels", """, at1 AS (SELECT r_regionkey AS k, px, py, 0.5 * px - 8 * r_regionkey AS sx, 0.5 * py - 4 * r_regionkey AS sy, 0.25 * px + 5 + r_regionkey AS sz
  FROM region, (SELECT unnest(range(0, 100)) AS px), (SELECT unnest(range(0, 96)) AS py)),
s AS (SELECT k, px, py, CAST(least(255, greatest(0, floor((v - 28000.0) * 255 / 9000.0 + 0.5))) AS BIGINT) AS i FROM at1 JOIN voxels ON x = floor(sx + 0.5) AND y = floor(sy + 0.5) AND z = floor(sz + 0.5))
SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, 255::BIGINT AS a, least(255, sum(CASE WHEN k % 2 = 0 THEN i ELSE 0 END))::BIGINT AS r, least(255, sum(i))::BIGINT AS g, least(255, sum(CASE WHEN k % 2 = 0 THEN i ELSE 0 END))::BIGINT AS b
FROM s GROUP BY px, py""").replace("FROM blocks))\n,", "FROM blocks)),"))
def frame_scene(spark, sf_dir):
    """Five sources of the whole volume at different places, on an oblique plane: culled, sampled by lines, coloured and summed."""
    k = F.col("r_regionkey")
    size = derived.volume_size(spark, sf_dir)
    one, zero = F.lit(1.0), F.lit(0.0)
    model = F.array(one, zero, zero, 8.0 * k, zero, one, zero, 4.0 * k, zero, zero, one, -1.0 * k)
    box = {f"{m}_{a}": F.lit(0 if m == "min" else n - 1) for a, n in zip("xyz", size) for m in ("min", "max")}
    sources = derived.table(spark, sf_dir, "region").select(k.alias("source_id"), model.alias("model"), F.lit(True).alias("culled"), F.lit(28000.0).alias("cmin"), F.lit(37000.0).alias("cmax"), F.when(k % 2 == 0, -1).otherwise(-16711936).alias("color"), *[c.alias(n) for n, c in box.items()])
    chunks = derived.blocks(spark, sf_dir).join(F.broadcast(sources.select("source_id")))
    return frame.render(sources, chunks, (2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, -0.5, 0.0, 1.0, -5.0), 100, 96, CELL)
