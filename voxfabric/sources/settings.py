"""A session's settings as XML: view, display ranges, manual transforms, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.sources.datasets import _element, _listed, _text

#: How display modes and interpolations are told in settings (fixed values).
MODES = {"SINGLE": "ss", "GROUP": "sg", "FUSED": "fs", "FUSEDGROUP": "fg"}
INTERPOLATIONS = {"NEAREST": "nearestneighbor", "LINEAR": "nlinear"}


def _code(column: str, names: dict[str, str]) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown value "), F.col(column)))
    for name, code in names.items():
        out = F.when(F.col(column) == name, code).otherwise(out)
    return out


def settings_xml(state: DataFrame, sources: DataFrame, groups: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """xml: one row.

    state: one row of source, group, timepoint, mode, interpolation. sources:
    source_id, active, cmin, cmax, color, fixed (a map). groups: group_id, name,
    active, members (source ids). bookmarks: key, model.
    """
    numbers = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    plain = lambda tag, c: _element(tag, F.coalesce(F.col(c).cast("string"), F.lit("")))
    shown = _listed(sources, ["source_id"], _element("Source", plain("active", "active")))
    grouped = _listed(groups, ["group_id"], _element("SourceGroup", plain("active", "active"), _element("name", _text(F.col("name"))), F.array_join(F.transform("members", lambda m: F.concat(F.lit("<id>"), m.cast("string"), F.lit("</id>"))), "")))
    ranges = _listed(sources, ["source_id"], _element("ConverterSetup", plain("id", "source_id"), plain("min", "cmin"), plain("max", "cmax"), plain("color", "color")))
    moved = _listed(sources, ["source_id"], _element("SourceTransform", _element("affine", numbers(F.col("fixed"))), type=F.lit("affine")))
    marks = _listed(bookmarks, ["key"], _element("BookmarkTransform", _element("Key", _text(F.col("key"))), _element("affine", numbers(F.col("model")))))
    one = state
    for name, part in (("a", shown), ("b", grouped), ("c", ranges), ("d", moved), ("e", marks)):
        one = one.join(part.withColumnRenamed("xml", f"__{name}"))
    view = _element(
        "ViewerState", _element("Sources", F.col("__a")), _element("SourceGroups", F.col("__b")), _element("DisplayMode", _code("mode", MODES)), _element("Interpolation", _code("interpolation", INTERPOLATIONS)),
        plain("CurrentSource", "source"), plain("CurrentGroup", "group"), plain("CurrentTimePoint", "timepoint"),
    )
    return one.select(_element("Settings", view, _element("SetupAssignments", F.col("__c")), _element("ManualSourceTransforms", F.col("__d")), _element("Bookmarks", F.col("__e"))).alias("xml"))


_SCHEMA = (
    "ViewerState struct<Sources:struct<Source:array<struct<active:boolean>>>,SourceGroups:struct<SourceGroup:array<struct<active:boolean,name:string,id:array<long>>>>,DisplayMode:string,Interpolation:string,CurrentSource:long,CurrentGroup:long,CurrentTimePoint:long>,"
    " SetupAssignments struct<ConverterSetup:array<struct<id:long,min:double,max:double,color:int>>>, ManualSourceTransforms struct<SourceTransform:array<struct<affine:string>>>, Bookmarks struct<BookmarkTransform:array<struct<Key:string,affine:string>>>"
)


def read_settings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of settings_xml(), from a file."""
    d = spark.read.text(path, wholetext=True).select(F.from_xml("value", _SCHEMA, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    numbers = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda v: v.cast("double"))
    back = lambda c, names: F.create_map(*[F.lit(x) for name, code in names.items() for x in (code, name)])[c]
    v = F.col("ViewerState")
    state = d.select(v["CurrentSource"].alias("source"), v["CurrentGroup"].alias("group"), v["CurrentTimePoint"].alias("timepoint"), back(v["DisplayMode"], MODES).alias("mode"), back(v["Interpolation"], INTERPOLATIONS).alias("interpolation"))
    zipped = d.select(F.posexplode(F.arrays_zip(v["Sources"]["Source"].alias("s"), F.col("SetupAssignments.ConverterSetup").alias("c"), F.col("ManualSourceTransforms.SourceTransform").alias("m"))).alias("i", "z"))
    sources = zipped.select(F.col("z.c.id").alias("source_id"), "z.s.active", F.col("z.c.min").alias("cmin"), F.col("z.c.max").alias("cmax"), "z.c.color", numbers(F.col("z.m.affine")).alias("fixed"))
    groups = d.select(F.posexplode(v["SourceGroups"]["SourceGroup"]).alias("i", "g")).select(F.col("i").cast("long").alias("group_id"), "g.name", "g.active", F.coalesce("g.id", F.array().cast("array<bigint>")).alias("members"))
    bookmarks = d.select(F.explode("Bookmarks.BookmarkTransform").alias("b")).select(F.col("b.Key").alias("key"), numbers(F.col("b.affine")).alias("model"))
    return {"state": state, "sources": sources, "groups": groups, "bookmarks": bookmarks}
