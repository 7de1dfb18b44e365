"""Data set descriptions and remote chunk formats, decoded by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.functions import affine

_VIEW = "_timepoint:int,_setup:int"
_DATASET = f"""SequenceDescription struct<ViewSetups:struct<ViewSetup:array<struct<id:int,name:string,size:string,voxelSize:struct<unit:string,size:string>>>>,
Timepoints:struct<_type:string,first:int,last:int,integerpattern:string>,MissingViews:struct<MissingView:array<struct<{_VIEW}>>>>,
ViewRegistrations struct<ViewRegistration:array<struct<{_VIEW},ViewTransform:array<struct<affine:string>>>>>"""


def integer_pattern(pattern: Column) -> Column:
    """The numbers of a pattern, ascending: single ones, ranges "0-9" and ranges with a step "0-9:2", with commas between them."""
    part = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*(?::\s*(\d+)\s*)?)?$"

    def numbers(p: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("not a pattern of whole numbers: "), p)).cast("array<int>")
        group = lambda i, other: F.coalesce(F.regexp_extract(p, part, i).try_cast("int"), other)
        first = F.regexp_extract(p, part, 1).try_cast("int")
        last = group(2, first)
        return F.when(~p.rlike(part), wrong).when(first > last, F.array().cast("array<int>")).otherwise(F.sequence(first, F.greatest(first, last), F.greatest(group(3, F.lit(1)), F.lit(1))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(pattern, ","), numbers))))


def read_dataset_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a SpimData XML file: setups, timepoints, missing, registrations (model: the view's maps, composed; identity where it has none).

    What a setup doesn't state is null. Timepoints are a range or a pattern.
    """
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.from_xml("value", _DATASET, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    whole = lambda c, kind: F.transform(F.split(F.trim(c), r"\s+"), lambda v: v.cast(kind))
    s = d.select(F.explode("SequenceDescription.ViewSetups.ViewSetup").alias("s")).select("s.*")
    setups = s.select(F.col("id").alias("setup_id"), "name", whole(F.col("size"), "long").alias("size"), F.struct(F.col("voxelSize.unit").alias("unit"), whole(F.col("voxelSize.size"), "double").alias("size")).alias("voxel"))
    t = d.select("SequenceDescription.Timepoints.*")
    listed = F.when(F.col("integerpattern").isNotNull(), integer_pattern(F.col("integerpattern"))).otherwise(F.sequence("first", "last"))
    timepoints = t.select(F.posexplode(listed).alias("t_index", "timepoint_id"))
    ids = [F.col("v._timepoint").alias("timepoint_id"), F.col("v._setup").alias("setup_id")]
    missing = d.select(F.explode("SequenceDescription.MissingViews.MissingView").alias("v")).select(*ids)
    registered = d.select(F.explode("ViewRegistrations.ViewRegistration").alias("v"))
    maps = F.transform(F.coalesce("v.ViewTransform", F.array()), lambda t: whole(F.coalesce(t["affine"], F.raise_error(F.lit("a view transform without an affine map"))), "double"))
    # The first of the list is applied last.
    model = F.aggregate(maps, affine.affine(affine.IDENTITY), affine.compose)
    return {"setups": setups, "timepoints": timepoints, "missing": missing, "registrations": registered.select(*ids, model.alias("model"))}


def big_endian_16(payload: Column, index: Column) -> Column:
    """The unsigned 16-bit value at an index of a remote server's cell."""
    return F.conv(F.hex(F.substring(payload, index * 2 + 1, F.lit(2))), 16, 10).cast("int")


def remote_cells(cells: DataFrame, payload: str = "payload") -> DataFrame:
    """Cells as sent by a chunk server (big-endian unsigned 16-bit) to data arrays."""
    n = F.floor(F.octet_length(payload) / 2).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return cells.withColumn("data", F.transform(index, lambda i: big_endian_16(F.col(payload), i))).drop(payload)


def remote_cell_url(base: str, index: Column, t: Column, setup: Column, level: Column, size: list[Column], low: list[Column]) -> Column:
    """The request for one cell."""
    return F.concat_ws("/", F.lit(f"{base}?p=cell"), index, t, setup, level, *size, *low)


_TOKEN = "dataset struct<imagesize:map<string,array<bigint>>,slicerange:array<bigint>,cube_dimension:map<string,array<bigint>>,resolutions:array<int>,zscale:map<string,double>>"


def cutout_levels(tokens: DataFrame, column: str = "json") -> DataFrame:
    """Levels of cutout-service token information: resolution, dim_x, dim_y, dim_z (slices from the first one on), cell, scale."""
    info = tokens.select(F.from_json(column, _TOKEN).alias("i")).select("i.dataset.*")
    levels = info.select("*", F.explode("resolutions").alias("resolution"))
    key = F.col("resolution").cast("string")
    size, cube = F.element_at("imagesize", key), F.element_at("cube_dimension", key)
    scale = F.pow(F.lit(2.0), F.col("resolution") - F.array_min("resolutions"))
    return levels.select("resolution", size[0].alias("dim_x"), size[1].alias("dim_y"), (F.col("slicerange")[1] - F.col("slicerange")[0] + 1).alias("dim_z"), cube.alias("cell"), F.array(scale, scale, F.coalesce(F.element_at("zscale", key), F.lit(1.0))).alias("scale"))


def json_affine(column: str) -> Column:
    """An affine map from its JSON array."""
    return F.from_json(column, "array<double>")


def attribute_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, attributes (JSON): all attributes.json files below a store, as one table that can be kept as a cache."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="attributes.json")
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "/attributes.json$", "").alias("path"), F.col("value").alias("attributes"))
