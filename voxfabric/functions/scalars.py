"""Scalar expressions: colours, ranges, grids, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Four channels of 0 to 255 as one INT."""
    a, r, g, b = (c.cast("int") for c in (a, r, g, b))
    return F.shiftleft(a, 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def channels(argb: Column) -> dict[str, Column]:
    """a, r, g, b of a packed colour."""
    return {k: F.shiftrightunsigned(argb, s).bitwiseAND(F.lit(255)) for k, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.least(F.greatest(v, as_column(low)), as_column(high))


def to_intensity(v: Column, low: Column, high: Column) -> Column:
    """A value's place in its display range, 0 to 255, rounded half up."""
    return clamp(F.floor((v - low) * 255 / (high - low) + 0.5), 0, 255).cast("long")


def to_color(v: Column, low: Column, high: Column, color: Column) -> dict[str, Column]:
    """a, r, g, b of a value in its display range, tinted by a packed colour; opaque."""
    i, tint = to_intensity(v, low, high), channels(color)
    return {"a": F.lit(255).cast("long"), **{k: F.floor(i * tint[k] / 255).cast("long") for k in "rgb"}}


def display_range(dtype: Column) -> tuple[Column, Column]:
    """The first display range of a pixel type: its own range inside 0 to 65535; 0 to 255 for colours."""
    low = F.lit(0).cast("long")
    high = F.when(dtype == "argb", 255).when(dtype == "uint8", 255).when(dtype == "int8", 127).when(dtype == "int16", 32767).when(dtype.isin("uint16", "int32", "uint32", "int64", "uint64", "float32", "float64"), 65535)
    return low, F.when(high.isNotNull(), high).otherwise(F.raise_error(F.concat(F.lit("no display range for pixel type "), dtype))).cast("long")


def default_bounds(dtype: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Outer bounds of a range slider: the type's range (0 to 1 for others), widened to hold the display range."""
    types = {"argb": (0, 255), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1)}
    lo, hi = F.lit(0.0), F.lit(1.0)
    for name, (a, b) in types.items():
        lo, hi = F.when(dtype == name, float(a)).otherwise(lo), F.when(dtype == name, float(b)).otherwise(hi)
    return F.least(lo, low), F.greatest(hi, high)


class BoundedRange:
    """A range inside bounds, as columns min_bound, max_bound, low, high; each step keeps min_bound <= low <= high <= max_bound."""

    def __init__(self, min_bound: Column, max_bound: Column, low: Column, high: Column):
        self.min_bound, self.max_bound, self.low, self.high = min_bound, max_bound, low, high

    def valid(self) -> Column:
        return (self.min_bound <= self.low) & (self.low <= self.high) & (self.high <= self.max_bound)

    def with_min(self, v: Column) -> BoundedRange:
        return BoundedRange(F.least(self.min_bound, v), F.greatest(self.max_bound, v), v, F.greatest(self.high, v))

    def with_max(self, v: Column) -> BoundedRange:
        return BoundedRange(F.least(self.min_bound, v), F.greatest(self.max_bound, v), F.least(self.low, v), v)

    def with_min_bound(self, v: Column) -> BoundedRange:
        return BoundedRange(v, F.greatest(self.max_bound, v), F.greatest(self.low, v), F.greatest(self.high, v))

    def with_max_bound(self, v: Column) -> BoundedRange:
        return BoundedRange(F.least(self.min_bound, v), v, F.least(self.low, v), F.least(self.high, v))

    def join(self, other: BoundedRange) -> BoundedRange:
        return BoundedRange(F.least(self.min_bound, other.min_bound), F.greatest(self.max_bound, other.max_bound), F.least(self.low, other.low), F.greatest(self.high, other.high))


class BoundedInterval:
    """An interval low to high of at least `least` inside range_min to range_max, as columns; each step keeps it so, moving the other end if need be."""

    def __init__(self, range_min: Column, range_max: Column, low: Column, high: Column, least: Column):
        self.range_min, self.range_max, self.low, self.high, self.least = range_min, range_max, low, high, least

    def with_low(self, v: Column) -> BoundedInterval:
        low = clamp(v, self.range_min, self.range_max - self.least)
        return BoundedInterval(self.range_min, self.range_max, low, F.greatest(self.high, low + self.least), self.least)

    def with_high(self, v: Column) -> BoundedInterval:
        high = clamp(v, self.range_min + self.least, self.range_max)
        return BoundedInterval(self.range_min, self.range_max, F.least(self.low, high - self.least), high, self.least)

    def with_range(self, lowest: Column, highest: Column) -> BoundedInterval:
        """Another range: ends are cut to it; if they come too near, the lower one gives way at the range's end, else the higher."""
        low, high = clamp(self.low, lowest, highest - self.least), clamp(self.high, lowest + self.least, highest)
        near = low > high - self.least
        at_end = near & (high == highest)
        return BoundedInterval(lowest, highest, F.when(at_end, high - self.least).otherwise(low), F.when(near & ~at_end, low + self.least).otherwise(high), self.least)


def cell_count(dim: Column, cell: Column) -> Column:
    """Cells of a size that cover a length."""
    return F.floor((dim + cell - 1) / cell).cast("long")


def cell_index(g: list[Column], counts: list[Column]) -> Column:
    """The flat number of a cell, x fastest."""
    return g[0] + counts[0] * (g[1] + counts[1] * g[2])


def n5_path(setup: Column, timepoint: Column, level: Column) -> Column:
    return F.format_string("setup%d/timepoint%d/s%d", setup, timepoint, level)


def hdf5_path(timepoint: Column, setup: Column, level: Column) -> Column:
    return F.format_string("t%05d/s%02d/%d/cells", timepoint, setup, level)


def setup_name(name: Column, angle: Column, channel: Column) -> Column:
    """A view setup's own name, or one made of its angle and channel."""
    made = F.concat_ws(" ", F.concat(F.lit("a "), angle), F.concat(F.lit("c "), channel))
    return F.coalesce(F.when(name != "", name), made)


#: Steps of the scale bar to a power of ten, and the units it is told in (fixed values).
SUBDIVISIONS = 4
LENGTH_UNITS = ("nm", "\u00b5m", "mm", "m", "km")


def scale_bar(pixel: Column, target: float = 100.0) -> Column:
    """The length of the bar nearest to target pixels, a pixel being so long: a power of ten, or a quarter, half, three quarters of the next."""
    wanted = pixel * target
    power = F.floor(F.log10(wanted))
    next_ = F.pow(F.lit(10.0), power + 1)
    quarters = F.floor(wanted / F.pow(F.lit(10.0), power) * 0.1 * SUBDIVISIONS)
    low = F.when(quarters > 0, next_ * quarters / SUBDIVISIONS).otherwise(F.pow(F.lit(10.0), power))
    high = next_ * (quarters + 1) / SUBDIVISIONS
    return F.when(F.abs(low / pixel - target) < F.abs(high / pixel - target), low).otherwise(high)


def in_short_unit(length: Column, unit: Column) -> tuple[Column, Column]:
    """A length in the unit in which it is shortest, and that unit; lengths in other than the known units stay."""
    named = F.when(unit == "um", LENGTH_UNITS[1]).otherwise(unit)
    units = F.array(*[F.lit(u) for u in LENGTH_UNITS])
    at = F.array_position(units, named)
    to = F.least(F.greatest(at + F.floor((F.log10(length) + 1) / 3), F.lit(1)), F.lit(len(LENGTH_UNITS)))
    known = at > 0
    return F.when(known, length / F.pow(F.lit(1000.0), to - at)).otherwise(length), F.when(known, F.get(units, (to - 1).cast("int"))).otherwise(unit)


def cosine_ease(t: Column) -> Column:
    """Eased time of an animation, 0 to 1."""
    return F.lit(0.5) - F.cos(t * F.pi()) * 0.5


def fade(t: Column, rise: float = 0.2, fall: float = 0.5) -> Column:
    """A highlight's strength: a sine ramp up over `rise`, full, and a ramp down over the last `fall` of the time."""
    up, down = F.sin(t / rise * F.pi() / 2), F.sin((F.lit(1.0) - t) / fall * F.pi() / 2)
    return F.when(t <= rise, up).when(t >= 1 - fall, down).otherwise(1.0)
