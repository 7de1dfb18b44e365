"""Views, registrations, merging, partitions."""

from pyspark.sql import functions as F

from voxfabric.functions import affine, scalars
from voxfabric.operators import catalog
from voxfabric.queries.registry import query
from voxfabric.sources import derived
from voxfabric.sources.derived import with_sql


def _views(spark, sf_dir):
    return derived.views(spark, sf_dir).withColumnRenamed("t", "timepoint_id")


def _tables(spark, sf_dir):
    v = _views(spark, sf_dir)
    keys = ["setup_id", "timepoint_id"]
    setups, times = v.select("setup_id").distinct(), v.select("timepoint_id").distinct()
    return v, setups, times, v.where("present").select(*keys, "model"), v.where("not present").select(*keys)


@query(with_sql("views", "SELECT setup_id, t AS timepoint_id FROM views WHERE present"))
def presence(spark, sf_dir):
    v, _, times, _, missing = _tables(spark, sf_dir)
    return catalog.present_views(v, missing, times).select("setup_id", "timepoint_id")


@query(with_sql("views", "SELECT setup_id, t AS timepoint_id FROM views WHERE NOT present"))
def missing_views(spark, sf_dir):
    _, setups, times, registrations, _ = _tables(spark, sf_dir)
    return catalog.missing_views(setups, times, registrations)


def _levels(spark):
    f = F.pow(F.lit(2.0), F.col("level"))
    return spark.range(25).withColumnRenamed("id", "setup_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("mip", affine.scaling([f, f, f], True))


@query(with_sql("views", """
SELECT setup_id, t AS timepoint_id, CAST(level AS BIGINT) AS level, CASE WHEN present THEN model[1]*f ELSE 1 END AS m00, CASE WHEN present THEN model[1]*(f-1)*0.5 + model[4] ELSE 0 END AS m03,
       CASE WHEN present THEN model[6]*(f-1)*0.5 + model[7]*(f-1)*0.5 + model[8] ELSE 0 END AS m13 FROM (SELECT *, unnest(range(0, 3)) AS level FROM views) JOIN (SELECT unnest([0, 1, 2]) AS level, unnest([1.0::DOUBLE, 2.0, 4.0]) AS f) USING (level)"""))
def source_transform(spark, sf_dir):
    v, _, _, registrations, _ = _tables(spark, sf_dir)
    out = catalog.source_transforms(v.select("setup_id", "timepoint_id"), registrations, _levels(spark))
    return out.select("setup_id", "timepoint_id", F.col("level").cast("long").alias("level"), F.col("model")[0].alias("m00"), F.col("model")[3].alias("m03"), F.col("model")[7].alias("m13"))


@query(with_sql("views", "SELECT setup_id, t AS timepoint_id, CAST(unnest(range(0, 3)) AS BIGINT) AS level FROM views WHERE present"))
def view_levels(spark, sf_dir):
    _, setups, times, _, missing = _tables(spark, sf_dir)
    return catalog.view_levels(setups, times, missing, _levels(spark)).select("setup_id", "timepoint_id", F.col("level").cast("long").alias("level"))


@query(with_sql("views", """SELECT setup_id, t AS timepoint_id, present AS "exists", CASE WHEN present THEN 10 + setup_id ELSE 1 END AS dim_x, CASE WHEN present THEN 20 + t ELSE 1 END AS dim_y, CASE WHEN present THEN 5 ELSE 1 END::BIGINT AS dim_z FROM views"""))
def dataset_exists(spark, sf_dir):
    v, _, _, registrations, _ = _tables(spark, sf_dir)
    dims = registrations.select("setup_id", "timepoint_id", (F.col("setup_id") + 10).alias("dim_x"), (F.col("timepoint_id") + 20).alias("dim_y"), F.lit(5).cast("long").alias("dim_z"))
    return catalog.with_existence(v.select("setup_id", "timepoint_id"), dims)


@query(with_sql("views", "SELECT CASE WHEN setup_id % 5 = 0 THEN setup_id + 100 ELSE setup_id END AS setup_id, t AS timepoint_id FROM views"))
def id_remap(spark, sf_dir):
    mapping = spark.range(0, 25, 5).select(F.col("id").alias("old"), (F.col("id") + 100).alias("new"))
    return catalog.remap(_views(spark, sf_dir).select("setup_id", "timepoint_id"), mapping, "setup_id")


@query(with_sql("views", """
SELECT setup_id, t AS timepoint_id, printf('part-%02d', k) AS path, t - 2 * k AS partition_timepoint, setup_id - 10 * k AS partition_setup
FROM views, (SELECT unnest(range(0, 3)) AS k) WHERE t BETWEEN 2 * k AND 2 * k + 3 AND setup_id BETWEEN 10 * k AND 10 * k + 9"""))
def partition_contains(spark, sf_dir):
    k = F.col("id")
    number = lambda low, n: F.map_from_arrays(F.sequence(low, low + n), F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    parts = spark.range(3).select(F.format_string("part-%02d", k).alias("path"), number(k * 2, 3).alias("timepoint_map"), number(k * 10, 9).alias("setup_map"))
    return catalog.in_partition(_views(spark, sf_dir).select("setup_id", "timepoint_id"), parts)


@query(with_sql("views", "SELECT setup_id, t AS timepoint_id, t // 3 AS t_file, setup_id // 4 AS s_file, printf('out-%02d-%02d', t // 3, setup_id // 4) AS path FROM views"))
def partition_split(spark, sf_dir):
    return catalog.split_partitions(_views(spark, sf_dir).select("setup_id", "timepoint_id"), 3, 4, "out")


@query("""
WITH parts AS (SELECT 0 AS part, n_nationkey AS setup_id, n_name AS name FROM nation UNION ALL SELECT 1, n_nationkey + 20, lower(n_name) FROM nation)
SELECT CAST(setup_id AS BIGINT) AS setup_id, arg_max(name, part) AS name FROM parts GROUP BY setup_id""")
def merge_setups(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    parts = n.select(F.lit(0).alias("part"), key.alias("setup_id"), F.col("n_name").alias("name")).unionByName(n.select(F.lit(1).alias("part"), (key + 20).alias("setup_id"), F.lower("n_name").alias("name")))
    return catalog.merge(parts, ["setup_id"])


@query(with_sql("views", """
SELECT setup_id, t AS timepoint_id, model[4] AS tx FROM views WHERE present UNION ALL SELECT setup_id + 100, t, model[4] FROM views WHERE present"""))
def merge_registrations(spark, sf_dir):
    _, _, _, registrations, _ = _tables(spark, sf_dir)
    both = registrations.unionByName(registrations.withColumn("setup_id", F.col("setup_id") + 100))
    return catalog.merge_registrations(both).select("setup_id", "timepoint_id", F.col("model")[3].alias("tx"))


@query("""
WITH RECURSIVE p AS (SELECT n_nationkey AS part, n_regionkey * 3 AS first, n_regionkey * 3 + n_nationkey % 4 AS last FROM nation),
c AS (SELECT part, first, last, greatest(first, 0) AS new_first FROM p WHERE part = 0
      UNION ALL SELECT p.part, p.first, p.last, greatest(p.first, c.new_first + c.last - c.first + 1) FROM c JOIN p ON p.part = c.part + 1)
SELECT CAST(part AS BIGINT) AS part, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(new_first AS BIGINT) AS new_first FROM c""")
def merge_timepoints(spark, sf_dir):
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    parts = derived.table(spark, sf_dir, "nation").select(k.alias("part"), (r * 3).alias("first"), (r * 3 + k % 4).alias("last"))
    return catalog.chain_timepoints(parts)


@query("""
WITH RECURSIVE taken AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT n_nationkey + 25 FROM nation WHERE n_nationkey < 15),
free AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT unnest(range(0, 200)) AS id) WHERE id NOT IN (SELECT id FROM taken)),
g AS (SELECT 0::BIGINT AS old, (SELECT min(id) FROM free WHERE id >= 0) AS "new" UNION ALL SELECT old + 1, (SELECT min(id) FROM free WHERE id >= old + 1 AND id > g."new") FROM g WHERE old < 24)
SELECT old, "new" FROM g""")
def setup_id_reassign(spark, sf_dir):
    """Setups joining a data set that uses the same ids and fifteen more: each takes the next free one."""
    ids = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("old"))
    # What is taken follows the table: twice its first ten ids and all others.
    used = ids.select(F.col("old").alias("id")).unionByName(ids.where("old < 15").select((F.col("old") + 25).alias("id")))
    return catalog.next_free(ids, used)


@query("""SELECT CASE WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(l, r) AS source_id
FROM (SELECT CAST(n_nationkey AS BIGINT) AS l, n_name FROM nation WHERE n_nationkey < 20)
FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) AS r, CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE n_name END AS now FROM nation WHERE n_nationkey > 3) ON l = r WHERE l IS NULL OR r IS NULL OR n_name <> now""")
def table_diff(spark, sf_dir):
    s = derived.sources(spark, sf_dir)
    new = s.where("source_id > 3").withColumn("name", F.when(F.col("source_id") % 4 == 0, "x").otherwise(F.col("name")))
    return catalog.table_diff(s.where("source_id < 20"), new, "source_id", "name")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS source_id, row_number() OVER (ORDER BY n_name) - 1 AS "index" FROM nation WHERE n_nationkey % 4 <> 1""")
def list_index(spark, sf_dir):
    return catalog.dense_order(derived.sources(spark, sf_dir).where("source_id % 4 <> 1"), "name").select("source_id", "index")


@query(with_sql("views", "SELECT max(setup_id) + 1 AS next_setup, count(DISTINCT t) AS timepoints, count(*) FILTER (WHERE present) AS views FROM views"))
def catalog_counts(spark, sf_dir):
    v = _views(spark, sf_dir)
    return v.agg((F.max("setup_id") + 1).alias("next_setup"), F.count_distinct("timepoint_id").alias("timepoints"), F.count_if("present").alias("views"))


@query("""SELECT p_partkey, (p_size * 7 + 15) // 16 AS nx, (p_partkey % 90 + 8) // 8 AS ny, (p_partkey % 3) + ((p_size * 7 + 15) // 16) * ((p_size % 5) + ((p_partkey % 90 + 8) // 8) * 2) AS flat FROM part""")
def cell_counts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    nx, ny = scalars.cell_count(s * 7, F.lit(16)), scalars.cell_count(k % 90 + 1, F.lit(8))
    return derived.table(spark, sf_dir, "part").select("p_partkey", nx.alias("nx"), ny.alias("ny"), scalars.cell_index([k % 3, s % 5, F.lit(2)], [nx, ny]).alias("flat"))


@query(with_sql("views", "SELECT DISTINCT 'setup_id' AS attribute, CAST(setup_id AS VARCHAR) AS value FROM views UNION SELECT 't', CAST(t AS VARCHAR) FROM views UNION SELECT 'present', CAST(present AS VARCHAR) FROM views"))
def distinct_sets(spark, sf_dir):
    """Ids in use and attributes that occur."""
    return catalog.distinct_sets(derived.views(spark, sf_dir), ["setup_id", "t", "present"])
