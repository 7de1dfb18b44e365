"""What is shown: sources put on display, their settings and transforms.

Tables have a row per source; a change is a join or an expression, so a
session's state stays a DataFrame throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.functions import affine, scalars
from voxfabric.operators import sampling


def show(shown: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Sources on display with those of arrivals (ord, name, dtype) put after them: source_id, name, dtype, color, cmin, cmax, active, current.

    New sources get the next ids in their order, are active, white, and have
    the first display range of their pixel type; a type without one is an
    error. The first source of an empty display becomes current.
    """
    last = shown.agg(F.coalesce(F.max("source_id"), F.lit(-1)).alias("last"), F.coalesce(F.max(F.col("current").cast("int")), F.lit(0)).alias("has"))
    low, high = scalars.display_range(F.col("dtype"))
    place = F.row_number().over(Window.orderBy("ord"))  # a row per source put on display
    new = arrivals.join(F.broadcast(last)).select(
        (F.col("last") + place).cast("long").alias("source_id"), "name", "dtype", F.lit(-1).alias("color"), low.cast("double").alias("cmin"), high.cast("double").alias("cmax"),
        F.lit(True).alias("active"), ((F.col("has") == 0) & (place == 1)).alias("current"),
    )
    return shown.unionByName(new)


def channels_of(channels: DataFrame, timepoints: int) -> DataFrame:
    """A list of channels (ord, name, dtype) as sources with their views: one for every channel and timepoint."""
    return channels.select("ord", "name", "dtype", F.explode(F.sequence(F.lit(0), F.lit(timepoints - 1))).alias("t"))


def changed(shown: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings put in from changes (source_id and any of name, color, cmin, cmax, active; null: as it was); adds `differs`, whether a row is not what it was."""
    given = [c for c in changes.columns if c != "source_id"]
    new = changes.select("source_id", *[F.col(c).alias(f"new_{c}") for c in given])
    out = shown.join(new, "source_id", "left")
    differs = F.lit(False)
    for c in given:
        differs = differs | ~F.coalesce(f"new_{c}", c).eqNullSafe(F.col(c))
    return out.withColumn("differs", differs).select(*[F.coalesce(f"new_{c}", c).alias(c) if c in given else c for c in shown.columns], "differs")


def colored_where(dtype: Column, color: Column, wanted: Column) -> Column:
    """A source's new colour; sources of colours have none, and keep theirs."""
    return F.when(dtype == "argb", color).otherwise(wanted)


def set_current(shown: DataFrame, source_id: int) -> DataFrame:
    """The source made current, if it is there."""
    there = F.max(F.col("source_id") == source_id).over(Window.partitionBy())
    return shown.withColumn("current", F.when(there, F.col("source_id") == source_id).otherwise(F.col("current")))


def removed(shown: DataFrame, gone: DataFrame) -> DataFrame:
    """The display without some sources; if the current one goes, the first one left becomes current."""
    left = shown.join(gone, "source_id", "left_anti")
    w = Window.partitionBy()  # a row per source
    keeps = F.max(F.col("current").cast("int")).over(w) == 1
    return left.withColumn("current", F.when(keeps, F.col("current")).otherwise(F.col("source_id") == F.min("source_id").over(w)))


def with_placeholders(shown: DataFrame, names: DataFrame) -> DataFrame:
    """Adds sources without data: no pixel type, never present, never active."""
    blank = names.select("source_id", "name")
    for c, kind in shown.dtypes:
        if c not in ("source_id", "name"):
            blank = blank.withColumn(c, F.lit(False) if kind == "boolean" else F.lit(None).cast(kind))
    return shown.unionByName(blank)


def info_text(timepoint: Column, timepoint_name: Column, source: Column, group: Column, grouping: Column) -> dict[str, Column]:
    """What is told about the view: timepoint by name or number, the current source, and the current group where groups are shown."""
    shown = F.coalesce(F.concat(F.lit("t = "), timepoint_name), F.concat(F.lit("t = "), timepoint.cast("string")))
    return {"timepoint": shown, "source": F.coalesce(source, F.lit("")), "group": F.when(grouping, F.coalesce(group, F.lit(""))).otherwise("")}


def source_table(shown: DataFrame) -> DataFrame:
    """name, current, active, color of each source, in order; sources of colours have no colour of their own."""
    return shown.select("source_id", "name", "current", "active", F.when(F.col("dtype") == "argb", F.lit(None)).otherwise(F.col("color")).alias("color"))


def sample(points: DataFrame, voxels: DataFrame, interpolation: str, id_columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """id_columns and v (a double): values at points by the chosen interpolation, "NEAREST" or "LINEAR", over an image that is zero outside."""
    if interpolation == "NEAREST":
        return sampling.nearest(points, voxels, keys).select(*id_columns, F.col("v").cast("double").alias("v"))
    if interpolation == "LINEAR":
        return sampling.linear(points, voxels, id_columns, keys).select(*id_columns, "v")
    raise ValueError(f"no interpolation {interpolation}")


def applied(sources: DataFrame, live: affine.Affine) -> DataFrame:
    """A manual transform made lasting: of the sources with `chosen`, fixed becomes live after fixed after incremental; incremental ends for all."""
    fixed = affine.compose(live, affine.compose("fixed", "incremental"))
    return sources.withColumns({"fixed": F.when(F.col("chosen"), fixed).otherwise(F.col("fixed")), "incremental": affine.affine(affine.IDENTITY)})


def aborted(sources: DataFrame) -> DataFrame:
    """A manual transform given up: incremental ends, fixed stays."""
    return sources.withColumn("incremental", affine.affine(affine.IDENTITY))


def reset(sources: DataFrame) -> DataFrame:
    """Back to where the chosen sources were at first: incremental undoes fixed."""
    return sources.withColumn("incremental", F.when(F.col("chosen"), affine.inverse("fixed")).otherwise(F.col("incremental")))


def saved_transforms(sources: DataFrame) -> DataFrame:
    """index, fixed: the fixed transforms in the order of the sources."""
    return sources.select((F.row_number().over(Window.orderBy("source_id")) - 1).cast("long").alias("index"), "fixed")


def restored_transforms(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """Fixed transforms put back by their place in the list; if there are not as many as sources, all stay as they are."""
    w = Window.partitionBy()
    placed = sources.withColumns({"index": (F.row_number().over(Window.orderBy("source_id")) - 1).cast("long"), "n": F.count("*").over(w)})
    other = saved.select("index", F.col("fixed").alias("new"), F.count("*").over(w).alias("m"))
    out = placed.join(other, "index", "left").withColumn("m", F.max("m").over(w))
    return out.select(*[F.when(F.col("n") == F.col("m"), F.col("new")).otherwise(F.col("fixed")).alias("fixed") if c == "fixed" else c for c in sources.columns])


def box_query(voxels: DataFrame, low: Sequence[int], high: Sequence[int], timepoints: tuple[int, int], t: str = "t") -> DataFrame:
    """What a box selection gives: the voxels of a closed box, and of a range of timepoints."""
    inside = F.col(t).between(*timepoints)
    for a, x, y in zip("xyz", low, high):
        inside = inside & F.col(a).between(x, y)
    return voxels.where(inside)


def renumbered(table: DataFrame, column: str, old: int, new: int) -> DataFrame:
    """One id changed; where the new one is taken, that is an error."""
    taken = F.max((F.col(column) == new).cast("int")).over(Window.partitionBy()) == 1
    moved = F.when(taken, F.raise_error(F.lit(f"{column} {new} is taken"))).otherwise(F.lit(new))
    return table.withColumn(column, F.when(F.col(column) == old, moved.cast(table.schema[column].dataType)).otherwise(F.col(column)))


def free_name(name: Column, taken: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys and columns that name is made of) with `free`: the name's stem and the least number from its own + 1 on that no taken name has."""
    stem, number = F.regexp_extract(name, r"(?s)^(.+) \((\d+)\)$", 1), F.regexp_extract(name, r"(?s)^(.+) \((\d+)\)$", 2)
    asked = rows.withColumns({"stem": F.when(stem != "", stem).otherwise(name), "after": F.when(number != "", number.cast("int")).otherwise(1)})
    used = taken.select(F.regexp_extract("name", r"(?s)^(.+) \((\d+)\)$", 1).alias("stem"), F.regexp_extract("name", r"(?s)^(.+) \((\d+)\)$", 2).try_cast("int").alias("number"))
    used = used.groupBy("stem").agg(F.collect_set("number").alias("numbers"))
    found = asked.join(used, "stem", "left")
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    tried = F.sequence(F.col("after") + 1, F.col("after") + 1 + F.size(numbers))
    free = F.array_min(F.array_except(tried, numbers))
    return found.select(*keys, F.concat("stem", F.lit(" ("), free.cast("string"), F.lit(")")).alias("free"))


def merged_setups(parts: DataFrame, extra: affine.Affine | None = None) -> DataFrame:
    """Registrations of two data sets (part 0 and 1; setup_id, timepoint_id, model): the second's setups follow the first's, its models after an extra transform."""
    first = parts.where("part = 0").agg((F.coalesce(F.max("setup_id"), F.lit(-1)) + 1).cast("long").alias("offset"))
    model = affine.compose(extra, "model") if extra is not None else F.col("model")
    second = F.col("part") == 1
    return parts.join(F.broadcast(first)).select(
        "part", (F.col("setup_id") + F.when(second, F.col("offset")).otherwise(0)).cast("long").alias("setup_id"), "timepoint_id", F.when(second, model).otherwise(F.col("model")).alias("model")
    )


def partitions_or_whole(partitions: DataFrame, views: DataFrame, path: str) -> DataFrame:
    """A data set's partitions (path, timepoint_map, setup_map); one that holds all of it, ids unchanged, where it has none."""
    same = lambda c: F.map_from_arrays(F.array_sort(F.collect_set(c)), F.array_sort(F.collect_set(c)))
    whole = views.agg(same("timepoint_id").alias("timepoint_map"), same("setup_id").alias("setup_map")).select(F.lit(path).alias("path"), "timepoint_map", "setup_map")
    some = partitions.limit(1).select(F.lit(1).alias("some"))
    return partitions.unionByName(whole.join(F.broadcast(some), how="left_anti"))


def column_major(values: Column) -> Column:
    """Coordinates of the other axis order."""
    return F.reverse(values)


def truncated(values: Column, kind: str = "int") -> Column:
    """Numbers of an array cut to whole ones."""
    return F.transform(values, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast(kind))


def resolution_text(resolutions: Column) -> Column:
    """An array of resolutions as text: { {1,1,1}, {2,2,2} }."""
    one = F.transform(resolutions, lambda r: F.concat(F.lit("{"), F.array_join(F.transform(r, lambda v: v.cast("string")), ","), F.lit("}")))
    return F.concat(F.lit("{ "), F.array_join(one, ", "), F.lit(" }"))
