"""Chunks, crops, pyramids and sources of voxels."""

import pandas as pd
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import boxes, pyramid, sampling
from voxfabric.plans import pyramids
from voxfabric.queries.registry import query
from voxfabric.sources import blocks, derived, formats, generated
from voxfabric.sources.derived import with_sql


@query(with_sql("voxels", "SELECT x, y, z, v FROM voxels"))
def explode_voxels(spark, sf_dir):
    return derived.voxels(spark, sf_dir)


@query(with_sql("voxels", """SELECT x // 8 AS gx, y // 8 AS gy, z // 4 AS gz, sum(v)::BIGINT AS total, sum(v * (x % 8 + 8 * (y % 8 + 8 * (z % 4))))::BIGINT AS moment FROM voxels GROUP BY 1, 2, 3"""))
def rechunk(spark, sf_dir):
    """Chunks cut and joined to chunks of another size, and sums over their arrays."""
    cell = boxes.chunks(_image(spark, sf_dir), (8, 8, 4))
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    moment = F.aggregate(F.transform("data", lambda v, i: v * i), F.lit(0).cast("long"), lambda a, v: a + v)
    return cell.select(*[F.col(g).cast("long").alias(g) for g in ("gx", "gy", "gz")], total.alias("total"), moment.alias("moment"))


@query(with_sql("blocks", """SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, CAST(gz AS BIGINT) AS gz, CAST(i AS BIGINT) AS i, CASE WHEN i % 4 < 3 AND i // 4 % 4 < 2 AND (gx + gy) % 5 <> 0 THEN data[i % 4 + 3 * (i // 4 % 4 + 2 * (i // 16)) + 1] ELSE 0 END AS v
FROM blocks, (SELECT unnest(range(0, 64)) AS i)"""))
def zero_pad(spark, sf_dir):
    """Chunks cut at the edge (3 * 2 * 4) laid into whole ones; some are not stored at all."""
    b = derived.blocks(spark, sf_dir)
    stored = b.where("(gx + gy) % 5 <> 0").withColumn("data", F.slice("data", 1, 24))
    padded = stored.withColumn("data", blocks.pad_block(F.col("data"), [F.lit(3), F.lit(2), F.lit(4)], (4, 4, 4)))
    whole = blocks.fill_missing(padded, b.select("gx", "gy", "gz"), (4, 4, 4))
    return whole.select(*[F.col(g).cast("long").alias(g) for g in ("gx", "gy", "gz")], F.posexplode("data").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("""SELECT CAST(r_regionkey AS BIGINT) AS setup_id, gx, gy, gz, 16 * gx AS min_x, least(16, 30 + 10 * r_regionkey - 16 * gx)::BIGINT AS size_x, least(16, 20 - 16 * gy)::BIGINT AS size_y, least(4, 5 - 4 * gz)::BIGINT AS size_z
FROM region, (SELECT unnest(range(0, 8)) AS gx), (SELECT unnest(range(0, 2)) AS gy), (SELECT unnest(range(0, 2)) AS gz) WHERE 16 * gx < 30 + 10 * r_regionkey""")
def cell_grid(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    dims = derived.table(spark, sf_dir, "region").select(k.alias("setup_id"), (k * 10 + 30).alias("dim_x"), F.lit(20).cast("long").alias("dim_y"), F.lit(5).cast("long").alias("dim_z"))
    return blocks.grid_of(dims, (16, 16, 4), ["setup_id"]).select("setup_id", "gx", "gy", "gz", "min_x", "size_x", "size_y", "size_z")


@query(with_sql("voxels", "SELECT x - 5 AS x, y - 6 AS y, z - 3 AS z, v FROM voxels WHERE x BETWEEN 5 AND 20 AND y BETWEEN 6 AND 30 AND z BETWEEN 3 AND 11"))
def crop_voxels(spark, sf_dir):
    return sampling.crop(derived.voxels(spark, sf_dir), [(5, 20), (6, 30), (3, 11)])


@query("""SELECT p_partkey, CASE WHEN e THEN floor((a + b) / 2 + 0.5) ELSE greatest(floor(a), 0) END::BIGINT - 1 AS min_x, CASE WHEN e THEN floor((a + b) / 2 + 0.5) ELSE least(ceil(b), 39) END::BIGINT + 1 AS max_x
FROM (SELECT *, greatest(floor(a), 0) > least(ceil(b), 39) AS e FROM (SELECT p_partkey, 0.5::DOUBLE * 10 - p_size * 2 + 20 AS a, 0.5::DOUBLE * 30 - p_size * 2 + 20 AS b FROM part))""")
def crop_interval(spark, sf_dir):
    back = F.array(F.lit(0.5), F.lit(0.0), F.lit(0.0), 20.0 - F.col("p_size") * 2, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    box = sampling.crop_interval([(10, 30), (2, 8), (1, 5)], back, [(0, 39), (0, 39), (0, 19)], border=1)
    return derived.table(spark, sf_dir, "part").select("p_partkey", box["min_x"].alias("min_x"), box["max_x"].alias("max_x"))


@query(with_sql("voxels", "SELECT x, y, v FROM voxels WHERE z = 7"))
def hyperslice(spark, sf_dir):
    return derived.voxels(spark, sf_dir).where("z = 7").drop("z")


@query(with_sql("voxels", "SELECT x, y, z, CASE WHEN x BETWEEN 3 AND 9 AND y BETWEEN 5 AND 7 AND z BETWEEN 0 AND 4 THEN 1000 ELSE 200 END::BIGINT AS v FROM voxels"))
def box_source(spark, sf_dir):
    return derived.voxels(spark, sf_dir).withColumn("v", sampling.in_box([(3, 9), (5, 7), (0, 4)], 1000, 200).cast("long"))


@query(with_sql("voxels", "SELECT x, y, z, x * x + 2 * y - z AS v, CAST(7 AS BIGINT) AS constant FROM voxels"))
def function_source(spark, sf_dir):
    return derived.voxels(spark, sf_dir).select("x", "y", "z", (F.col("x") * F.col("x") + F.col("y") * 2 - F.col("z")).alias("v"), F.lit(7).cast("long").alias("constant"))


def saddle(x, y, z):
    """A function on the grid."""
    return x * x - 3 * y * z


@query(with_sql("voxels", "SELECT x, y, z, v, CAST(x * x - 3 * y * z AS BIGINT) AS f FROM voxels WHERE x BETWEEN 5 AND 37 AND y >= 11"))
def function_crop(spark, sf_dir):
    """An unbounded function beside the volume: the crop reaches the source, which evaluates what is left of its box."""
    generated.register(spark)
    high = ",".join(str(n - 1) for n in derived.volume_size(spark, sf_dir))
    f = spark.read.format("function").options(function="voxfabric.queries.volumes:saddle", low="0,0,0", high=high, cell="16,16,16").load()
    v = derived.voxels(spark, sf_dir).join(f.withColumnRenamed("v", "f"), ["x", "y", "z"])
    return v.where("x between 5 and 37 and y >= 11").select("x", "y", "z", "v", F.col("f").cast("long").alias("f"))


@query(with_sql("sparse", "SELECT CAST(setup AS BIGINT) AS setup, z AS channel, CAST(t AS BIGINT) AS t, x, y, v FROM sparse"))
def axis_split(spark, sf_dir):
    """An XYZ stack read as XYC: its third axis numbers channels."""
    return derived.sparse_voxels(spark, sf_dir).select(F.col("setup").cast("long").alias("setup"), F.col("z").alias("channel"), F.col("t").cast("long").alias("t"), "x", "y", "v")


@query(with_sql("voxels", "SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(v)::BIGINT // count(*) AS v FROM voxels GROUP BY 1, 2, 3"))
def downsample(spark, sf_dir):
    return pyramid.downsample_blocks(derived.blocks(spark, sf_dir), (4, 4, 4), (2, 2, 2))


def _image(spark, sf_dir):
    return boxes.image_of(derived.blocks(spark, sf_dir), (4, 4, 4), derived.volume_size(spark, sf_dir))


@query(with_sql("voxels", """, a AS (SELECT x // 3 AS x, y // 5 AS y, z, sum(v)::BIGINT // 15 AS v FROM voxels WHERE x < 39 GROUP BY ALL) SELECT * FROM a""").replace("FROM blocks))\n,", "FROM blocks)),"))
def downsample_edge(spark, sf_dir):
    """Factors that divide neither the size nor the chunks: the rest of the last row is not a voxel of the level, and blocks reach over borders."""
    return boxes.downsample(_image(spark, sf_dir), (3, 5, 1)).as_voxels()


@query(with_sql("voxels", """, l1 AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(v)::BIGINT // count(*) AS v FROM voxels GROUP BY 1, 2, 3),
l2 AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(v)::BIGINT // count(*) AS v FROM l1 GROUP BY 1, 2, 3),
l3 AS (SELECT x // 3 AS x, y // 3 AS y, z // 3 AS z, sum(v)::BIGINT // 27 AS v FROM l2 WHERE x < 9 AND y < 9 AND z // 3 < (SELECT (max(z) + 1) // 3 FROM l2) GROUP BY 1, 2, 3)
SELECT CAST(1 AS BIGINT) AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3""").replace("FROM blocks))\n,", "FROM blocks)),"))
def downsample_cascade(spark, sf_dir):
    """Three levels, each from the one before, as boxes; the last by factors that divide neither."""
    levels = boxes.pyramid(_image(spark, sf_dir), [(1, 1, 1), (2, 2, 2), (4, 4, 4), (12, 12, 12)])
    out = [x.as_voxels().select(F.lit(k).cast("long").alias("level"), "x", "y", "z", "v") for k, x in enumerate(levels)]
    return out[1].unionByName(out[2]).unionByName(out[3])


@query("""WITH RECURSIVE n AS (SELECT p_partkey, 300 + p_size * 40 AS w, 200 + p_partkey % 900 AS h FROM part),
l AS (SELECT p_partkey, w, h, 1 AS n FROM n UNION ALL SELECT p_partkey, w // 2, h // 2, n + 1 FROM l WHERE w // 2 > 256 AND h // 2 > 256) SELECT p_partkey, CAST(max(n) AS BIGINT) AS levels FROM l GROUP BY p_partkey""")
def tile_level_count(spark, sf_dir):
    """Levels of tile pyramids."""
    w, h = (F.col("p_size") * 40 + 300).cast("long"), (F.col("p_partkey") % 900 + 200).cast("long")
    return derived.table(spark, sf_dir, "part").select("p_partkey", pyramids.tile_levels_of(w, h, 256, 256).cast("long").alias("levels"))


@query(with_sql("sparse", "SELECT CAST(setup AS BIGINT) AS setup, CAST(t AS BIGINT) AS t, x, y, z // 3 AS z, sum(v * 5)::BIGINT // 3 AS r, sum(v * 3)::BIGINT // 3 AS g, sum(v)::BIGINT // 3 AS b, CAST(255 AS BIGINT) AS a FROM sparse GROUP BY setup, t, x, y, z // 3"))
def slab_mean(spark, sf_dir):
    keys = [F.col(k).cast("long").alias(k) for k in ("setup", "t")]
    s = derived.sparse_voxels(spark, sf_dir).select(*keys, "x", "y", "z", (F.col("v") * 5).alias("r"), (F.col("v") * 3).alias("g"), F.col("v").alias("b"))
    return pyramid.slab_mean(s, 3, ["setup", "t", "x", "y"])


@query()
def propose_mipmaps(spark, sf_dir):
    """Pyramids proposed for images of different sizes and voxels, and what each level is computed from."""
    k, s = F.col("p_partkey"), F.col("p_size")
    images = derived.table(spark, sf_dir, "part").select(k.alias("image"), F.array(s * 97 + 200, k % 900 + 150, s * 13 + 1).alias("size"), F.array(F.lit(1.0), F.lit(1.0), k % 14 * 0.25 + 0.5).alias("voxel"))

    def plan(batches):
        for batch in batches:
            rows = []
            for image, size, voxel in zip(batch.image, batch["size"], batch.voxel):
                levels = pyramids.propose([int(v) for v in size], [float(v) for v in voxel])
                resolutions = [x["resolution"] for x in levels]
                rows += [(image, i, x["resolution"], x["subdivision"], pyramids.source_level(resolutions, i)) for i, x in enumerate(levels)]
            yield pd.DataFrame(rows, columns=["image", "level", "resolution", "subdivision", "source_level"]).astype({"source_level": "Int32"})

    return images.mapInPandas(plan, "image long, level int, resolution array<int>, subdivision array<int>, source_level int")


@query(with_sql("blocks", "SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, CAST(gz AS BIGINT) AS gz, list_sum(data)::BIGINT AS total FROM blocks"))
def remote_cells(spark, sf_dir):
    """Chunks sent as big-endian 16-bit bytes, decoded again."""
    code = F.aggregate("data", F.lit(""), lambda a, v: F.concat(a, F.lpad(F.hex(v), 4, "0")))
    sent = derived.blocks(spark, sf_dir).select("gx", "gy", "gz", F.unhex(code).alias("payload"))
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    return formats.remote_cells(sent).select(*[F.col(g).cast("long").alias(g) for g in ("gx", "gy", "gz")], total.alias("total"))


@query("""SELECT event_id, CAST(CASE WHEN props LIKE '{%' THEN json_extract(props, '$.k') END AS BIGINT) AS k FROM events""")
def json_attributes(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(with_sql("views", "SELECT setup_id, t, model[4] AS tx, model[8] AS ty FROM views"))
def json_affine(spark, sf_dir):
    """Maps written as JSON and read again."""
    rows = derived.views(spark, sf_dir).withColumn("j", F.to_json(F.col("model"))).withColumn("m", formats.json_affine("j"))
    e = affine.entries("m")
    return rows.select("setup_id", "t", e[3].alias("tx"), e[7].alias("ty"))
