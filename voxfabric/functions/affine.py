"""Affine maps in three dimensions, as columns.

A map is an ARRAY<DOUBLE> of 12: three rows of four, the last column being the
translation. All functions return expressions, so Catalyst folds those of
literals and keeps the rest in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)

Affine = Column | str | Sequence[float]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def entries(m: Affine) -> list[Column]:
    """The 12 numbers of a map given as a column, a column's name or numbers."""
    if isinstance(m, str):
        m = F.col(m)
    if isinstance(m, Column):
        return [m[i] for i in range(12)]
    if len(m) != 12:
        raise ValueError("an affine map has 12 numbers")
    return [F.lit(float(v)) for v in m]


def affine(m: Affine) -> Column:
    return F.array(*entries(m))


def compose(a: Affine, b: Affine) -> Column:
    """a after b."""
    p, q = entries(a), entries(b)
    out = []
    for r in range(3):
        for c in range(4):
            v = p[4 * r] * q[c] + p[4 * r + 1] * q[4 + c] + p[4 * r + 2] * q[8 + c]
            out.append(v + p[4 * r + 3] if c == 3 else v)
    return F.array(*out)


def apply(m: Affine, x: Column, y: Column, z: Column) -> list[Column]:
    """The image of a point: three columns."""
    p = entries(m)
    return [p[4 * r] * x + p[4 * r + 1] * y + p[4 * r + 2] * z + p[4 * r + 3] for r in range(3)]


def inverse(m: Affine) -> Column:
    """The inverse map; null where there is none."""
    p = entries(m)
    a = [[p[4 * r + c] for c in range(3)] for r in range(3)]

    def minor(r: int, c: int) -> Column:
        rows, cols = [i for i in range(3) if i != r], [i for i in range(3) if i != c]
        v = a[rows[0]][cols[0]] * a[rows[1]][cols[1]] - a[rows[0]][cols[1]] * a[rows[1]][cols[0]]
        return -v if (r + c) % 2 else v

    det = a[0][0] * minor(0, 0) + a[0][1] * minor(0, 1) + a[0][2] * minor(0, 2)
    inv = [[minor(c, r) / F.nullif(det, F.lit(0.0)) for c in range(3)] for r in range(3)]
    out = []
    for r in range(3):
        shift = -(inv[r][0] * p[3] + inv[r][1] * p[7] + inv[r][2] * p[11])
        out += [*inv[r], shift]
    return F.when(det != 0, F.array(*out))


def scaling(factors: Sequence[Column | float], half_pixel: bool = False) -> Column:
    """A diagonal map; with half_pixel, shifted by (f-1)/2 so that a coarse voxel lies at the centre of those it covers."""
    f = [c if isinstance(c, Column) else F.lit(float(c)) for c in factors]
    zero, out = F.lit(0.0), []
    for r in range(3):
        out += [f[r] if c == r else zero for c in range(3)] + [(f[r] - 1) * 0.5 if half_pixel else zero]
    return F.array(*out)


def column_length(m: Affine, axis: int) -> Column:
    """The length of the image of a unit step along an axis."""
    p = entries(m)
    return F.sqrt(p[axis] * p[axis] + p[4 + axis] * p[4 + axis] + p[8 + axis] * p[8 + axis])


def screen_length(m: Affine, axis: int) -> Column:
    """The length on the screen, in x and y, of a unit step along an axis."""
    p = entries(m)
    return F.sqrt(p[axis] * p[axis] + p[4 + axis] * p[4 + axis])


def plane_rows(m: Affine) -> Column:
    """The two-dimensional map in the screen's plane: rows 0 and 1, columns 0, 1 and 3."""
    p = entries(m)
    return F.array(p[0], p[1], p[3], p[4], p[5], p[7])


def is_same(a: Affine, b: Affine) -> Column:
    same = F.lit(True)
    for x, y in zip(entries(a), entries(b)):
        same = same & (x == y)
    return same


def corner(minimum: Column, maximum: Column, number: Column, axis: int) -> Column:
    """Coordinate of a box's corner 0 to 7: bit `axis` of its number picks the maximum."""
    return F.when(F.getbit(number, F.lit(axis)) == 1, maximum).otherwise(minimum)


def box_bounds(m: Affine, low: Sequence[Column], high: Sequence[Column]) -> list[tuple[Column, Column]]:
    """Per axis the least and greatest coordinate of a box's transformed corners.

    An affine map's extremes along an axis are reached corner by corner, so
    the sums of each term's extremes are theirs.
    """
    p, out = entries(m), []
    for r in range(3):
        terms = [(p[4 * r + c] * low[c], p[4 * r + c] * high[c]) for c in range(3)]
        out.append((sum((F.least(*t) for t in terms), p[4 * r + 3]), sum((F.greatest(*t) for t in terms), p[4 * r + 3])))
    return out
