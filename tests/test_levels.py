from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import screen
from voxfabric.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_levels_as_rows_and_as_maps(spark):
    """Both forms agree, also where levels are equally near (the finer one) and where a key has several rows."""
    sources = spark.createDataFrame([(1, 1.0), (2, 0.25), (3, 0.125), (3, 0.5), (4, 2.0 / 3)], "k int, zoom double")
    maps = [affine.scaling([F.col("zoom") * f] * 2 + [1.0]) for f in (1.0, 2.0, 4.0, 4.0)]
    rows = sources.select("k", F.posexplode(F.array(*maps)).alias("level", "to_screen"))
    want = {1: 0, 2: 2, 3: 1, 4: 1}
    assert {r.k: r.best for r in screen.best_level(sources, ["k"], maps).collect()} == want
    assert {r.k: r.best for r in screen.best_level(rows, ["k"]).collect()} == want


def test_grouping_gets_one_distance_a_source(spark):
    """Maps of all levels of all parts, sorted by one task, took its memory."""
    plan = QUERIES["best_level"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Generate" not in plan
