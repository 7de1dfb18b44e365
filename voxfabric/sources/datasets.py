"""Data set descriptions written and read, resaved and cropped; tiles and cutouts of image servers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import sampling
from voxfabric.operators.boxes import Image, chunks, downsample, image_of
from voxfabric.plans import pyramids
from voxfabric.sources import blocks, n5


def _text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _element(name: str, *content: Column, **attributes: Column) -> Column:
    head = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        head += [F.lit(f' {k}="'), _text(v), F.lit('"')]
    return F.concat(*head, F.lit(">"), *content, F.lit(f"</{name}>"))


def _listed(rows: DataFrame, order: Sequence[str], element: Column) -> DataFrame:
    """One row: the elements of all rows, in order, as text. A row per view or setup."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, element.alias("x")))), lambda e: e["x"]), "\n").alias("xml"))


def dataset_xml(tables: dict[str, DataFrame], loader: str, path: str, partitions: DataFrame | None = None) -> DataFrame:
    """xml: one row, the description of a data set whose tables are those of formats.read_dataset_xml().

    loader is the format of the image loader, path where it
    finds the images. A partition names its ids where they differ from the
    data set's.
    """
    numbers = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    setups = _listed(
        tables["setups"], ["setup_id"],
        _element("ViewSetup", _element("id", F.col("setup_id").cast("string")), _element("size", numbers(F.col("size"))), _element("voxelSize", _element("unit", _text(F.col("voxel.unit"))), _element("size", numbers(F.col("voxel.size"))))),
    )
    times = tables["timepoints"].agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_index", "timepoint_id"))), lambda t: t["timepoint_id"].cast("string")), ",").alias("times"))
    missing = _listed(tables["missing"], ["timepoint_id", "setup_id"], _element("MissingView", timepoint=F.col("timepoint_id"), setup=F.col("setup_id")))
    views = _listed(
        tables["registrations"], ["timepoint_id", "setup_id"],
        _element("ViewRegistration", _element("ViewTransform", _element("affine", numbers(F.col("model"))), type=F.lit("affine")), timepoint=F.col("timepoint_id"), setup=F.col("setup_id")),
    )
    parts = None
    if partitions is not None:
        ids = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), " ")
        differs = lambda m: F.exists(F.map_entries(m), lambda e: e["key"] != e["value"])
        mapped = lambda tag, m: F.when(differs(m), _element(tag, ids(m))).otherwise("")
        parts = _listed(partitions, ["path"], _element("partition", _element("path", _text(F.col("path"))), mapped("timepointsMapped", F.col("timepoint_map")), mapped("setupsMapped", F.col("setup_map"))))
    tag = loader.rpartition(".")[2]
    one = setups.withColumnRenamed("xml", "s").join(times).join(missing.withColumnRenamed("xml", "m")).join(views.withColumnRenamed("xml", "v"))
    one = one.join(parts.withColumnRenamed("xml", "p")) if parts is not None else one.withColumn("p", F.lit(""))
    image = _element("ImageLoader", _element(tag, _text(F.lit(path)), type=F.lit("relative")), F.col("p"), format=F.lit(loader), version=F.lit("1.1"))
    sequence = _element("SequenceDescription", image, _element("ViewSetups", F.col("s")), _element("Timepoints", _element("integerpattern", F.col("times")), type=F.lit("pattern")), _element("MissingViews", F.col("m")))
    return one.select(_element("SpimData", _element("BasePath", F.lit("."), type=F.lit("relative")), sequence, _element("ViewRegistrations", F.col("v")), version=F.lit("0.2")).alias("xml"))


def write_dataset_xml(tables: dict[str, DataFrame], loader: str, images: str, folder: str, partitions: DataFrame | None = None) -> None:
    """The description as one text file in a folder."""
    dataset_xml(tables, loader, images, partitions).coalesce(1).write.mode("overwrite").text(folder, lineSep="\n")


_LEGACY = "ViewSetup array<struct<id:int,angle:int,illumination:int,channel:int,width:long,height:long,depth:long,pixelWidth:double,pixelHeight:double,pixelDepth:double>>, Timepoints struct<_type:string,first:int,last:int>, ViewRegistrations struct<ViewRegistration:array<struct<timepoint:int,setup:int,affine:string>>>"


def read_legacy_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the older description: setups, timepoints (a range, counted from 0 whatever its first), registrations; it has no missing views."""
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.from_xml("value", _LEGACY, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    s = d.select(F.explode("ViewSetup").alias("s")).select("s.*")
    setups = s.select(
        F.col("id").alias("setup_id"), "angle", "illumination", "channel", F.array("width", "height", "depth").alias("size"),
        F.struct(F.lit("px").alias("unit"), F.array("pixelWidth", "pixelHeight", "pixelDepth").alias("size")).alias("voxel"),
    )
    kind = F.col("Timepoints._type")
    count = F.when(kind == "range", F.col("Timepoints.last") - F.col("Timepoints.first")).otherwise(F.raise_error(F.concat(F.lit("unknown timepoints of type "), kind)).cast("int"))
    timepoints = d.select(F.posexplode(F.sequence(F.lit(0), count)).alias("t_index", "timepoint_id"))
    v = d.select(F.explode("ViewRegistrations.ViewRegistration").alias("v")).select("v.*")
    model = F.transform(F.split(F.trim("affine"), r"\s+"), lambda x: x.cast("double"))
    registrations = v.select(F.col("timepoint").alias("timepoint_id"), F.col("setup").alias("setup_id"), model.alias("model"))
    return {"setups": setups, "timepoints": timepoints, "missing": registrations.select("timepoint_id", "setup_id").limit(0), "registrations": registrations}


def setup_source(views: DataFrame, registrations: DataFrame, levels: DataFrame, stored: DataFrame, setup_id: int) -> DataFrame:
    """A data set's setup as a source: its stored chunks at each timepoint and level, with the map to the world."""
    from voxfabric.operators.catalog import source_transforms

    maps = source_transforms(views, registrations, levels).where(F.col("setup_id") == setup_id)
    return stored.where(F.col("setup_id") == setup_id).join(F.broadcast(maps), ["setup_id", "timepoint_id", "level"])


def resave_n5(image: Image, voxel: Sequence[float], target: str, dtype: str = "uint16", plane_done: Callable[[int, int], None] | None = None, finer: Callable[[Sequence[Sequence[int]], int], int | None] = pyramids.source_level) -> list[dict]:
    """Write an image (keys setup_id, timepoint_id) as a chunk store with a proposed pyramid; returns the levels' plan.

    A level is read from the one that finer names (of all levels' factors, a
    level: its number, None for the original), out of the store, so nothing is
    computed twice. plane_done is told of each level that is written: its
    number, and how many there are.
    """
    spark = image.boxes.sparkSession
    n5.register(spark)
    levels = pyramids.propose(list(image.size), list(voxel))
    resolutions = [x["resolution"] for x in levels]
    options = {"path": target, "dimensions": str(list(image.size)), "downsamplingFactors": str([list(r) for r in resolutions]), "dataType": dtype}
    written: list[Image] = []
    for k, level in enumerate(levels):
        source = finer(resolutions, k) if k else None
        base = resolutions[source] if source is not None else [1, 1, 1]
        factors = [a // b for a, b in zip(level["resolution"], base)]
        made = written[source] if source is not None else image
        made = downsample(made, factors) if any(f > 1 for f in factors) else made
        write_level(made, k, level["subdivision"], options)
        stored = spark.read.format("n5").options(path=target, element="long").load().where(F.col("level") == k)
        written.append(image_of(stored, level["subdivision"], made.size, image.keys))
        if plane_done:
            plane_done(k, len(levels))
    return levels


def write_level(image: Image, level: int, cell: Sequence[int], options: dict[str, str]) -> None:
    """One level as chunks; those at the edge are cut to the image."""
    made = chunks(image, cell)
    rows = made.select(F.col("timepoint_id").cast("int"), F.col("setup_id").cast("int"), F.lit(level).alias("level"), "gx", "gy", "gz", "size", F.col("data").cast("array<double>").alias("data"))
    rows.write.format("n5").options(**options, blockSize=str(list(cell))).mode("append").save()


def export_crop(voxels: DataFrame, box: Sequence[tuple[int, int]], timepoints: tuple[int, int], registrations: DataFrame, target: str, dtype: str = "uint16") -> dict[str, DataFrame]:
    """Write the part of every image in a closed box and range of timepoints as a store of its own, one level of chunks of 64; returns its registrations, moved by the box's corner, timepoints counted from 0."""
    n5.register(voxels.sparkSession)
    first, last = timepoints
    some = voxels.where(F.col("timepoint_id").between(first, last)).withColumn("timepoint_id", F.col("timepoint_id") - first)
    size = [b - a + 1 for a, b in box]
    options = {"path": target, "dimensions": str(size), "downsamplingFactors": "[[1,1,1]]", "dataType": dtype}
    keys = ["setup_id", "timepoint_id"]
    chunked = blocks.collect_blocks(sampling.crop(some, box), (64, 64, 64), keys)
    write_level(image_of(chunked, (64, 64, 64), size, keys), 0, [64, 64, 64], options)
    shift = affine.affine([1, 0, 0, box[0][0], 0, 1, 0, box[1][0], 0, 0, 1, box[2][0]])
    kept = registrations.where(F.col("timepoint_id").between(first, last))
    return {"registrations": kept.select((F.col("timepoint_id") - first).alias("timepoint_id"), "setup_id", affine.compose("model", shift).alias("model"))}


def tile_path(pattern: str, level: Column, scale: Column, x: Column, y: Column, z: Column, width: int, height: int, row: Column, column: Column) -> Column:
    """The request for a tile: a format of level, scale, x, y, z, tile width and height, row and column by number ("%7$d")."""
    return F.format_string(pattern, level, scale, x, y, z, F.lit(width), F.lit(height), row, column)


def read_tiles(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Tiles of image files (PNG, JPEG): the named groups of pattern from their paths as longs, and px, py, r, g, b. A tile that can't be decoded is black at no pixel: it gives no row."""
    names = list(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    found = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    keys = [F.regexp_extract("origin", plain, i + 1).cast("long").alias(n) for i, n in enumerate(names)]
    # Bytes are blue, green, red (and alpha), row by row from the top.
    pixels = found.select(*keys, "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + F.least(F.lit(k), F.col("nChannels") - 1) + 1, F.lit(1))), 16, 10).cast("long")
    return pixels.select(*names, (F.col("i") % F.col("width")).cast("long").alias("px"), F.floor(F.col("i") / F.col("width")).cast("long").alias("py"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def cutout_path(base: str, level: Column, low: Sequence[Column], size: Sequence[Column], z_offset: int = 0, mode: str = "/neariso/") -> Column:
    """The request for a cutout of a volume service."""
    span = lambda a, n: F.concat_ws(",", a, a + n)
    return F.concat(F.concat_ws("/", F.lit(base), level, span(low[0], size[0]), span(low[1], size[1]), span(low[2] + z_offset, size[2])), F.lit(mode))


def cutouts(files: DataFrame, content: str = "content") -> DataFrame:
    """Cutouts as sent (zlib-packed bytes, one a voxel) to data arrays, by Arrow batches."""
    @F.pandas_udf("array<int>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: list(zlib.decompress(b)))

    return files.withColumn("data", unpack(content)).drop(content)


_REMOTE = "maxNumLevels int, perSetupMipmapInfo map<string,struct<resolutions:array<array<double>>,subdivisions:array<array<int>>>>, dimensions map<string,array<bigint>>"


def remote_levels(replies: DataFrame, column: str = "json") -> DataFrame:
    """setup_id, level, resolution, subdivision: levels from a chunk server's first reply."""
    info = replies.select(F.from_json(column, _REMOTE).alias("i")).select(F.explode("i.perSetupMipmapInfo").alias("setup_id", "m"))
    both = info.select("setup_id", F.posexplode(F.arrays_zip("m.resolutions", "m.subdivisions")).alias("level", "l"))
    return both.select(F.col("setup_id").cast("int").alias("setup_id"), "level", F.col("l.resolutions").alias("resolution"), F.col("l.subdivisions").alias("subdivision"))

