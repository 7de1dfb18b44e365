"""Display ranges from the data: histograms and cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the histogram and the greatest value of its range (fixed values).
BINS, TOP = 6535, 65535


def middle_slice(voxels: DataFrame, low: int, high: int) -> DataFrame:
    """Voxels of the z in the middle of a closed range."""
    return voxels.where(F.col("z") == (low + high + 1) // 2)


def histogram(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin, n of the values v of 0 to 65535."""
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.col("v") * BINS / TOP)).cast("long")
    return voxels.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def cut_offs(counts: DataFrame, low: float = 0.001, high: float = 0.999, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cmin, cmax: the end of the bin in which a histogram's running share reaches low and high. A histogram has BINS rows at most."""
    w = Window.partitionBy(*keys)
    running = counts.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    value = F.floor((F.col("bin") + 1) * TOP / BINS)
    passed = lambda share: F.min(F.when(F.col("upto") >= F.col("total") * share, value)).cast("long")
    return running.groupBy(*keys).agg(passed(low).alias("cmin"), passed(high).alias("cmax"))


def range_by_type(ranges: DataFrame) -> DataFrame:
    """cmin, cmax by pixel type: from the data for 16-bit images that are present, else the type's own or 0 to 65535."""
    estimated = (F.col("dtype") == "uint16") & F.col("present")
    low = F.when(estimated, F.col("cmin")).otherwise(0)
    high = F.when(estimated, F.col("cmax")).when(F.col("dtype") == "uint8", 255).otherwise(TOP)
    return ranges.withColumn("cmin", low.cast("long")).withColumn("cmax", high.cast("long"))


def share_range(converters: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the range of whole groups: converters (setup_id, group_id, cmin, cmax) with changes (group_id, cmin, cmax) put in."""
    new = changes.select("group_id", F.col("cmin").alias("new_min"), F.col("cmax").alias("new_max"))
    out = converters.join(new, "group_id", "left")
    return out.withColumns({"cmin": F.coalesce("new_min", "cmin"), "cmax": F.coalesce("new_max", "cmax")}).drop("new_min", "new_max")
