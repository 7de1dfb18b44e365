"""Volumes, views and logs derived from the star-schema tables, for queries that can be checked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.sources.blocks import explode_blocks, extent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 4*4*4 chunks of a volume of 16-bit values: gx, gy, gz, data."""
    k = F.col("vec_id")
    data = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 32767).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        (k % 10).cast("int").alias("gx"), (F.floor(k / 10) % 10).cast("int").alias("gy"), F.floor(k / 100).cast("int").alias("gz"), data.alias("data")
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v of that volume."""
    return explode_blocks(blocks(spark, sf_dir), (4, 4, 4)).select("x", "y", "z", F.col("v").cast("long").alias("v"))


def volume_size(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """That volume's size; its depth grows with the table."""
    return extent(blocks(spark, sf_dir), (4, 4, 4))


def sparse_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as three setups over seven timepoints with holes: setup, t, x, y, z, v."""
    li = table(spark, sf_dir, "lineitem")
    setup = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    keyed = li.select(
        setup.alias("setup"), (F.year("l_shipdate") - 1995).alias("t"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"),
        (F.col("l_linenumber") - 1).cast("long").alias("z"), F.col("l_quantity").cast("long").alias("v"),
    )
    return keyed.groupBy("setup", "t", "x", "y", "z").agg(F.max("v").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as source boxes on a screen of 1680 * 997, some of them across z = 0: source_id and six bounds, closed."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    x, y, z = (k * 7) % 1680, (k * 13) % 997, s - 25
    return table(spark, sf_dir, "part").select(
        k.alias("source_id"), x.alias("min_x"), y.alias("min_y"), z.alias("min_z"), (x + s * 2).alias("max_x"), (y + s).alias("max_y"), (z + s).alias("max_z"), (k % 10 != 0).alias("culled")
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation * 7 timepoints: setup_id, t, present, model (an affine map of halves and quarters)."""
    s, t = F.col("n_nationkey").cast("long"), F.col("t")
    zero = F.lit(0.0)
    model = F.array(1 + (s % 4) * 0.25, zero, zero, t * 2.0, zero, 1 + (s % 3) * 0.5, (t % 2) * 0.25, s * 1.0, zero, zero, F.lit(2.0), t + s * 0.5)
    return (
        table(spark, sf_dir, "nation").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("t"))
        .select(s.alias("setup_id"), t, ((s * 7 + t * 3) % 11 != 0).alias("present"), model.alias("model"))
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as sources in list order: source_id, name, group_id, active."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("source_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("group_id"), (k % 3 != 0).alias("active"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region as groups of sources: group_id, name, active."""
    k = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region").select(k.alias("group_id"), F.col("r_name").alias("name"), (k % 2 == 0).alias("active"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as viewer actions: session, ts, event_id, kind, arg."""
    kinds = {"view": "timepoint", "click": "source", "purchase": "mode", "signup": "add", "error": "remove"}
    kind = F.lit(None).cast("string")
    for name, k in kinds.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", kind.alias("kind"), F.pmod(F.floor(F.col("value")), F.lit(10)).cast("long").alias("arg"))


#: The same for DuckDB, as common table expressions by name.
SQL = {
    "blocks": "blocks AS (SELECT vec_id % 10 AS gx, (vec_id // 10) % 10 AS gy, vec_id // 100 AS gz, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 32767) AS INT)) AS data FROM embeddings)",
    "voxels": """voxels AS (
  SELECT gx * 4 + i % 4 AS x, gy * 4 + (i // 4) % 4 AS y, gz * 4 + i // 16 AS z, CAST(v AS BIGINT) AS v
  FROM (SELECT gx, gy, gz, unnest(range(0, 64)) AS i, unnest(data) AS v FROM blocks))""",
    "sparse": """sparse AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS setup, year(l_shipdate) - 1995 AS t, l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z, max(CAST(l_quantity AS BIGINT)) AS v
  FROM lineitem GROUP BY ALL)""",
    "boxes": """boxes AS (
  SELECT p_partkey AS source_id, (p_partkey * 7) % 1680 AS min_x, (p_partkey * 13) % 997 AS min_y, CAST(p_size AS BIGINT) - 25 AS min_z,
         (p_partkey * 7) % 1680 + p_size * 2 AS max_x, (p_partkey * 13) % 997 + p_size AS max_y, CAST(p_size AS BIGINT) - 25 + p_size AS max_z, p_partkey % 10 <> 0 AS culled
  FROM part)""",
    "views": """views AS (
  SELECT CAST(n_nationkey AS BIGINT) AS setup_id, t, (n_nationkey * 7 + t * 3) % 11 <> 0 AS present,
         [1 + (n_nationkey % 4) * 0.25::DOUBLE, 0, 0, t * 2.0::DOUBLE, 0, 1 + (n_nationkey % 3) * 0.5::DOUBLE, (t % 2) * 0.25::DOUBLE, n_nationkey * 1.0::DOUBLE, 0, 0, 2.0::DOUBLE, t + n_nationkey * 0.5::DOUBLE] AS model
  FROM nation, (SELECT unnest(range(0, 7)) AS t))""",
    "sources": "sources AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS group_id, n_nationkey % 3 <> 0 AS active FROM nation)",
    "groups": "groups_ AS (SELECT CAST(r_regionkey AS BIGINT) AS group_id, r_name AS name, r_regionkey % 2 = 0 AS active FROM region)",
    "log": """log AS (
  SELECT user_id AS session, ts, event_id,
         CASE event_type WHEN 'view' THEN 'timepoint' WHEN 'click' THEN 'source' WHEN 'purchase' THEN 'mode' WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' END AS kind,
         CAST(((floor(value) % 10) + 10) % 10 AS BIGINT) AS arg
  FROM events)""",
}


def with_sql(names: str, body: str) -> str:
    """body after the named expressions; voxels brings blocks with it."""
    found = []
    for n in names.split():
        found += [SQL["blocks"]] * (n == "voxels") + [SQL[n]]
    return "WITH " + ",\n".join(found) + "\n" + body
