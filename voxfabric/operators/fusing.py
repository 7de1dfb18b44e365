"""Values to colours, and the colours of several sources to one pixel."""

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.functions.scalars import channels, to_color


def one_each(converters: DataFrame, key: str = "source_id") -> DataFrame:
    """converters, whose key must be unique: a source with two of them is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"two converters for {key} "), F.col(key).cast("string"))).cast(converters.schema[key].dataType)).otherwise(F.col(key))
    return converters.withColumn(key, checked)


def colored(samples: DataFrame, converters: DataFrame, key: str = "source_id") -> DataFrame:
    """Adds a, r, g, b of v in its source's display range (cmin, cmax) and colour. A row per source: where these are many, carry the settings along instead, as frame.render() does."""
    return samples.join(F.broadcast(one_each(converters, key)), key).withColumns(to_color(F.col("v"), F.col("cmin"), F.col("cmax"), F.col("color")))


def colored_by(samples: DataFrame, converter: Callable[[pd.Series], pd.Series], value: str = "v") -> DataFrame:
    """Adds a, r, g, b of a converter of one's own: a function of a series of values to one of packed ARGB colours, applied to Arrow batches."""

    def convert(values: pd.Series) -> pd.Series:
        return converter(values).astype("int64").astype("int32")

    argb = F.pandas_udf(convert, "int")(value)
    return samples.withColumn("argb", argb).withColumns({k: c.cast("long") for k, c in channels(F.col("argb")).items()}).drop("argb")


def masked(samples: DataFrame, mask: Column) -> DataFrame:
    """Alpha scaled by how much of the sample lies inside its source."""
    return samples.withColumn("a", F.floor(F.col("a") * mask).cast("long"))


def _channel(total: Column) -> Column:
    return F.least(F.lit(255), F.coalesce(total, F.lit(0))).cast("long")


def blend_sum(samples: DataFrame, keys: Sequence[str] = ("px", "py")) -> DataFrame:
    """Per pixel and channel the sum over sources, 255 at most."""
    return samples.groupBy(*keys).agg(*[_channel(F.sum(c)).alias(c) for c in "argb"])


def blend_average(samples: DataFrame, keys: Sequence[str] = ("px", "py")) -> DataFrame:
    """Per pixel the mean colour, weighted by alpha, rounded down; nothing where no source has any.

    The pixel of a single source is that source's own.
    """
    alpha, alone = F.sum("a"), F.count("*") == 1
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("a")) / F.nullif(alpha, F.lit(0)))
    color = [F.when(alone, F.max(c)).otherwise(_channel(mean(c))).cast("long").alias(c) for c in "rgb"]
    return samples.groupBy(*keys).agg(F.when(alone, F.max("a")).otherwise(_channel(alpha)).cast("long").alias("a"), *color)


def blend_custom(samples: DataFrame, aggregate: Callable[[str], Column], keys: Sequence[str] = ("px", "py")) -> DataFrame:
    """Another rule: aggregate(channel) is an aggregate expression that doesn't depend on the sources' order, as a pandas UDAF may be."""
    return samples.groupBy(*keys).agg(*[aggregate(c).alias(c) for c in "argb"])


def max_projection(samples: DataFrame, keys: Sequence[str] = ("t", "px", "py")) -> DataFrame:
    """Per pixel and channel the maximum over parallel slices, 0 at least."""
    return samples.groupBy(*keys).agg(*[F.greatest(F.max(c), F.lit(0)).cast("long").alias(c) for c in "argb"])


def slices(points: DataFrame, steps: int, step: float) -> DataFrame:
    """Each point at each of `steps` parallel planes: adds slice and its depth."""
    return points.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("depth", F.col("slice") * F.lit(float(step)))
