"""Viewer transforms: first views, aligned planes, navigation, animation.

All are expressions over affine maps (arrays of 12), so a table of sessions or
frames is moved in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxfabric.functions import affine
from voxfabric.functions.affine import let

#: Rotations from the xy plane to each plane, by rows, and the axis that is made orthogonal to it (fixed values).
PLANES = {"XY": ((1, 0, 0, 0, 1, 0, 0, 0, 1), 2), "ZY": ((0, 0, -1, 0, 1, 0, 1, 0, 0), 0), "XZ": ((1, 0, 0, 0, 0, -1, 0, 1, 0), 1)}
#: Zoom of a scroll step and of a key, and speeds: normal, fast, slow (fixed values).
SCROLL_ZOOM, KEY_ZOOM, SPEEDS = 1.05, 1.1, (1.0, 10.0, 0.1)

Vector = list[Column]


def _whole(m: affine.Affine) -> Column:
    """A map as one column."""
    return m if isinstance(m, Column) else F.col(m) if isinstance(m, str) else affine.affine(m)


def _cross(a: Sequence[Column], b: Sequence[Column]) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(a: Sequence[Column]) -> Column:
    return let(F.array(*a), lambda v: let(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), lambda n: F.array(v[0] / n, v[1] / n, v[2] / n)))


def _of_axes(axes: Sequence[Column]) -> Column:
    """The map whose unit axes go to three vectors."""
    return F.array(*[v for r in range(3) for v in (axes[0][r], axes[1][r], axes[2][r], F.lit(0.0))])


def _axes(m: affine.Affine) -> Column:
    """Where a map sends the unit axes, at unit length: three vectors."""
    return let(_whole(m), lambda p: F.array(*[_unit([p[c], p[4 + c], p[8 + c]]) for c in range(3)]))


def rotation(m: affine.Affine, axis: int = 2) -> Column:
    """The rotation nearest to a map's: its unit axes, of which `axis` is made orthogonal to the others' plane, the next one kept."""
    kept, last = (axis + 1) % 3, (axis + 2) % 3

    def straight(a: Column) -> Column:
        def whole(z: Column) -> Column:
            found = {axis: z, kept: a[kept], last: F.array(*_cross(z, a[kept]))}
            return let(found[last], lambda y: _of_axes([{**found, last: y}[i] for i in range(3)]))

        return let(_unit(_cross(a[kept], a[last])), whole)

    return let(_axes(m), straight)


def anisotropic_rotation(m: affine.Affine) -> Column:
    """The rotation of a map that scales each axis and rotates: its unit axes."""
    return let(_axes(m), lambda a: _of_axes([a[0], a[1], a[2]]))


def uniform_rotation(m: affine.Affine) -> Column:
    """The rotation of a map that scales all axes alike and rotates, by the length of its first row."""

    def part(p: Column) -> Column:
        return let(F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]), lambda n: F.array(*[F.lit(0.0) if c == 3 else p[4 * r + c] / n for r in range(3) for c in range(4)]))

    return let(_whole(m), part)


def transposed(r: affine.Affine) -> Column:
    """The inverse of a rotation."""
    return let(_whole(r), lambda p: F.array(*[F.lit(0.0) if c == 3 else p[4 * c + k] for k in range(3) for c in range(4)]))


def composed(a: affine.Affine, b: affine.Affine) -> Column:
    """a after b, each computed once."""
    return let(_whole(a), lambda p: let(_whole(b), lambda q: affine.compose(p, q)))


def applied(m: affine.Affine, v: Sequence[Column]) -> Column:
    """The image of a point, as an array of three."""
    return let(_whole(m), lambda p: let(F.array(*v), lambda x: F.array(*affine.apply(p, x[0], x[1], x[2]))))


def moved(m: affine.Affine, x: Column | float, y: Column | float, z: Column | float = 0.0) -> Column:
    """m, then a shift."""
    shift = [v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)]
    return let(_whole(m), lambda p: F.array(*[p[i] + shift[i // 4] if i % 4 == 3 else p[i] for i in range(12)]))


def zoomed(m: affine.Affine, factor: Column | float, x: Column | float, y: Column | float) -> Column:
    """m scaled about a point of the screen."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return moved(F.transform(moved(m, -x, -y), lambda v: v * f), x, y)


def turned(m: affine.Affine, axis: int, angle: Column, x: Column | float, y: Column | float) -> Column:
    """m rotated about an axis (0 to 2) through a point of the screen."""
    a, b = (axis + 1) % 3, (axis + 2) % 3
    r: list[Column] = [F.lit(1.0) if i in (0, 5, 10) else F.lit(0.0) for i in range(12)]
    r[4 * a + a], r[4 * a + b], r[4 * b + a], r[4 * b + b] = F.cos(angle), -F.sin(angle), F.sin(angle), F.cos(angle)
    return _about(m, F.array(*r), x, y)


def _about(m: affine.Affine, r: Column, x: Column | float, y: Column | float) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return moved(composed(r, moved(m, -x, -y)), x, y)


def initial_view(model: affine.Affine, low: Sequence[Column], high: Sequence[Column], width: int, height: int, fill: bool = False) -> Column:
    """The viewer's first map: a source's middle slice upright and centred, as large as fits the window (or fills it)."""
    middle = [(low[0] + high[0]) / 2, (low[1] + high[1]) / 2, F.floor((low[2] + high[2]) / 2 + 0.5)]
    cx, cy = width / 2, height / 2

    def placed(upright: Column) -> Column:
        centre = applied(upright, [applied(model, middle)[i] for i in range(3)])
        corner = applied(upright, [applied(model, [high[0] + 0.5, high[1] + 0.5, middle[2]])[i] for i in range(3)])

        def scaled(c: Column) -> Column:
            sides = [F.lit(cx) / (c[3] - c[0]), F.lit(cy) / (c[4] - c[1])]
            scale = F.greatest(*sides) if fill else F.least(*sides)
            return let(scale, lambda k: moved(F.transform(moved(upright, -c[0], -c[1], -c[2]), lambda v: v * k), cx - 0.5, cy - 0.5))

        return let(F.concat(centre, corner), scaled)

    return let(transposed(rotation(model, 2)), placed)


def aligned(viewer: affine.Affine, model: affine.Affine, plane: str, x: float, y: float) -> Column:
    """The viewer turned about a point of the screen so that a plane (XY, ZY, XZ) of a source lies in it."""
    by, axis = PLANES[plane]
    onto = F.array(*[F.lit(0.0) if c == 3 else F.lit(float(by[3 * r + c])) for r in range(3) for c in range(4)])
    target = transposed(composed(rotation(model, axis), onto))
    return _about(viewer, composed(target, transposed(uniform_rotation(viewer))), x, y)


def rotation_power(r: affine.Affine, t: Column) -> Column:
    """A rotation by the part t of its angle (less than a half turn), by its axis and angle."""
    zero = F.lit(0.0)

    def power(p: Column) -> Column:
        cos = F.least(F.greatest((p[0] + p[5] + p[10] - 1) / 2, F.lit(-1.0)), F.lit(1.0))

        def by(g: Column) -> Column:  # the angle, and twice its sine times the axis
            twice = F.nullif(2 * F.sin(g[0]), zero)
            turn = F.array(*[F.coalesce(g[i] / twice, zero) for i in (1, 2, 3)], F.cos(g[0] * t), F.sin(g[0] * t), F.when(twice.isNull(), 1.0).otherwise(0.0))
            return let(turn, whole)

        return let(F.array(F.acos(cos), p[9] - p[6], p[2] - p[8], p[4] - p[1]), by)

    def whole(w: Column) -> Column:
        u, c, s = [w[0], w[1], w[2]], w[3], w[4]
        cross = [[zero, -u[2], u[1]], [u[2], zero, -u[0]], [-u[1], u[0], zero]]
        out = []
        for i in range(3):
            for k in range(3):
                one = F.lit(1.0 if i == k else 0.0)
                out.append(F.when(w[5] == 1, one).otherwise(c * one + (1 - c) * u[i] * u[k] + s * cross[i][k]))
            out.append(zero)
        return F.array(*out)

    return let(_whole(r), power)


def rotating(start: affine.Affine, add: affine.Affine, x: float, y: float, t: Column) -> Column:
    """An animation at time t (0 to 1): start, turned by the part t of a rotation about a point of the screen."""
    return _about(start, rotation_power(add, t), x, y)


def translating(start: affine.Affine, to: Sequence[Column], t: Column) -> Column:
    """An animation at time t: start, its shift going straight to another one."""
    return let(_whole(start), lambda p: F.array(*[p[i] + t * (to[i // 4] - p[i]) if i % 4 == 3 else p[i] for i in range(12)]))


def similar(start: affine.Affine, end: affine.Affine, t: Column) -> Column:
    """An animation at time t between maps that rotate, scale alike and shift: angle and logarithm of the scale go evenly, what is looked at goes straight as seen."""

    def size(p: Column) -> Column:
        return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])

    def looked(m: Column, p: Column) -> Column:
        return let(size(p), lambda s: applied(transposed(uniform_rotation(m)), [p[i] / s for i in (3, 7, 11)]))

    def between(a: Column, b: Column) -> Column:
        def at(g: Column) -> Column:  # two sizes, then what both look at
            rate = g[1] / g[0]
            part = F.when(F.abs(rate - 1) < 0.0001, t).otherwise((g[1] / F.pow(rate, t) - g[1]) / F.nullif(g[0] - g[1], F.lit(0.0)))
            here = let(part, lambda k: F.array(*[g[2 + i] + k * (g[5 + i] - g[2 + i]) for i in range(3)]))
            turn = composed(uniform_rotation(a), rotation_power(composed(transposed(uniform_rotation(a)), uniform_rotation(b)), t))
            whole = lambda q: let(applied(q, [let(here, lambda h: h[i]) for i in range(3)]), lambda x: F.array(*[x[i // 4] if i % 4 == 3 else q[i] for i in range(12)]))  # noqa: E731,B023
            return let(g[0] * F.pow(rate, t), lambda k: F.transform(let(turn, whole), lambda v: v * k))

        return let(F.concat(F.array(size(a), size(b)), looked(a, a), looked(b, b)), at)

    return let(_whole(start), lambda a: let(_whole(end), lambda b: between(a, b)))


def stepped(m: affine.Affine, e: Column) -> Column:
    """m after an event (zoom, by, x, y, dx, dy): scaled by zoom / by about a point of the screen, then shifted.

    As the viewer does it, the shift is taken off, the map is multiplied and
    divided, and the shift put back; in doubles, the product of maps of steps
    would be another number.
    """
    scaled = lambda p: F.transform(moved(p, -e["x"], -e["y"]), lambda v: v * e["zoom"] / e["by"])
    return let(_whole(m), lambda p: F.when((e["zoom"] == 1) & (e["by"] == 1), moved(p, e["dx"], e["dy"])).otherwise(moved(moved(scaled(p), e["x"], e["y"]), e["dx"], e["dy"])))


def navigated(events: DataFrame, keys: Sequence[str], order: Sequence[str], start: affine.Affine) -> DataFrame:
    """keys, viewer: the map after all navigation events, one after the other. A group is one session's events.

    events: step, what each does: a map, or a struct of zoom, by, x, y, dx, dy (see stepped()).
    """
    steps = F.array_sort(F.collect_list(F.struct(*order, "step")))
    after = stepped if isinstance(events.schema["step"].dataType, StructType) else lambda m, e: affine.compose(e, m)
    whole = F.aggregate(steps, affine.affine(start), lambda m, e: after(m, e["step"]))
    return events.groupBy(*keys).agg(whole.alias("viewer"))


def fit_boxes(size: Column, target: tuple[int, int], area: tuple[int, int], ratio: float = 0.75) -> Column:
    """Scale at which an overview of boxes (the largest side of their bounds) and of the screen fits its part of the screen."""
    scale = min(ratio * area[0] / target[0], ratio * area[1] / target[1])
    over = size / max(target)
    return F.when(over > 1, F.lit(scale) / over).otherwise(scale)
