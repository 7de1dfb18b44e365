"""Views, registrations and setups: presence, joins, merging, partitions.

Catalog tables have a row per view or setup; they are small next to pixels,
and all of this is plain joins that Spark broadcasts by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.functions.scalars import setup_name

VIEW = ["setup_id", "timepoint_id"]


def present_views(views: DataFrame, missing: DataFrame, timepoints: DataFrame) -> DataFrame:
    """Views of known timepoints that are not listed as missing."""
    return views.join(timepoints, "timepoint_id", "left_semi").join(missing, VIEW, "left_anti")


def missing_views(setups: DataFrame, timepoints: DataFrame, registrations: DataFrame) -> DataFrame:
    """Pairs of a setup and a timepoint without a registration."""
    every = setups.select("setup_id").join(timepoints.select("timepoint_id"))
    return every.join(registrations, VIEW, "left_anti")


def source_transforms(views: DataFrame, registrations: DataFrame, levels: DataFrame) -> DataFrame:
    """setup_id, timepoint_id, level, model: registration after the level's own map; identity where a view has none."""
    found = views.join(registrations.select(*VIEW, F.col("model").alias("registered")), VIEW, "left").join(levels, "setup_id")
    whole = affine.compose("registered", "mip")
    return found.select(*VIEW, "level", F.when(F.col("registered").isNull(), affine.affine(affine.IDENTITY)).otherwise(whole).alias("model"))


def view_levels(setups: DataFrame, timepoints: DataFrame, missing: DataFrame, levels: DataFrame) -> DataFrame:
    """Every (setup, timepoint, level) whose metadata a reader would fetch."""
    every = setups.select("setup_id").join(timepoints.select("timepoint_id"))
    return every.join(missing, VIEW, "left_anti").join(levels.select("setup_id", "level"), "setup_id")


def with_existence(views: DataFrame, dims: DataFrame) -> DataFrame:
    """Adds `exists`, and sizes of 1 where an image is not stored."""
    sizes = [f"dim_{a}" for a in "xyz"]
    found = views.join(dims, VIEW, "left")
    return found.select(*views.columns, F.col(sizes[0]).isNotNull().alias("exists"), *[F.coalesce(c, F.lit(1)).cast("long").alias(c) for c in sizes])


def remap(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """column by mapping(old, new); ids that it lacks stay."""
    out = table.join(mapping, table[column] == F.col("old"), "left")
    return out.select(*[F.coalesce("new", c).alias(c) if c == column else c for c in table.columns])


def in_partition(views: DataFrame, partitions: DataFrame) -> DataFrame:
    """Each view in each partition (maps timepoint_map, setup_map of sequence ids to its own) that has both ids."""
    both = F.map_contains_key("timepoint_map", F.col("timepoint_id")) & F.map_contains_key("setup_map", F.col("setup_id"))
    found = views.join(partitions).where(both)
    return found.select(*VIEW, "path", F.element_at("timepoint_map", F.col("timepoint_id")).alias("partition_timepoint"), F.element_at("setup_map", F.col("setup_id")).alias("partition_setup"))


def split_partitions(views: DataFrame, timepoints_per_file: int, setups_per_file: int, base: str) -> DataFrame:
    """Views dealt to files base-TT-SS by the rank of their timepoint and setup."""
    rank = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1
    times = views.select("timepoint_id").distinct().select("timepoint_id", F.floor(rank("timepoint_id") / timepoints_per_file).cast("long").alias("t_file"))
    setups = views.select("setup_id").distinct().select("setup_id", F.floor(rank("setup_id") / setups_per_file).cast("long").alias("s_file"))
    return views.join(times, "timepoint_id").join(setups, "setup_id").withColumn("path", F.format_string(f"{base}-%02d-%02d", "t_file", "s_file"))


def merge(parts: DataFrame, keys: list[str], order: str = "part") -> DataFrame:
    """Rows of several data sets (column part, the later wins) with one row per key."""
    last = [F.max_by(c, order).alias(c) for c in parts.columns if c not in (*keys, order)]
    return parts.groupBy(*keys).agg(*last)


def merge_registrations(parts: DataFrame) -> DataFrame:
    """Registrations of several data sets; a view that two of them register is an error."""
    found = parts.groupBy(*VIEW).agg(F.count("*").alias("n"), F.first("model").alias("model"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.format_string("view (%d, %d) is registered twice", *VIEW)).cast("array<double>")).otherwise(F.col("model"))
    return found.select(*VIEW, checked.alias("model"))


def chain_timepoints(parts: DataFrame) -> DataFrame:
    """part, first, last of data sets to put after each other: adds new_first, its own or the next one free.

    new_first of a part is the greatest, over it and each earlier part, of
    that part's own first plus the lengths of what follows it up to here.
    """
    w = Window.orderBy("part")
    before = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = parts.withColumn("before", before)
    start = F.max(F.col("first") - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("new_first", (start + F.col("before")).cast("long")).drop("before")


def next_free(old: DataFrame, used: DataFrame) -> DataFrame:
    """old, new: each id of old, in order, with the first free one that is not smaller and not given to another; used (id) are taken.

    With the free ids in a list, the k-th of old takes place k + the greatest,
    over the ids up to it, of the first place it may take less its own number.
    """
    size = old.agg((F.max("old") + F.count("*")).alias("most")).join(used.agg(F.count("*").alias("taken")))
    free = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") + F.col("taken"))).alias("id")).join(used, "id", "left_anti")
    w = Window.orderBy("id")
    free = free.withColumn("place", F.row_number().over(w) - 1)
    asked = old.withColumn("k", F.row_number().over(Window.orderBy("old")) - 1)
    # The first place an id may take: how many free ids are smaller.
    both = asked.select(F.col("old").alias("at"), "k", F.lit(1).alias("asks")).unionByName(free.select(F.col("id").alias("at"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("asks")))
    below = F.sum(1 - F.col("asks")).over(Window.orderBy("at", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0))
    first = both.withColumn("first", below).where("asks = 1")
    place = F.col("k") + F.max(F.col("first") - F.col("k")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return first.select(F.col("at").alias("old"), place.alias("place")).join(free, "place").select("old", F.col("id").alias("new"))


def dense_order(items: DataFrame, order: str) -> DataFrame:
    """Adds index, the place in the list from 0 on."""
    return items.withColumn("index", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def table_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: added, removed or changed; rows that are the same don't come."""
    a, b = old.select(key, F.col(value).alias("was")), new.select(key, F.col(value).alias("now"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, status.alias("status")).where("status is not null")


def names_of(setups: DataFrame, name: Column, angle: Column, channel: Column) -> DataFrame:
    """Setups with a name: their own, or one made of angle and channel."""
    return setups.withColumn("name", setup_name(name, angle, channel))


def distinct_sets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, value: the distinct values of each column as text, nulls left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])).alias("a")
    return rows.select(each).select("a.*").where("value is not null").distinct()
