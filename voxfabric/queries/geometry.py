"""Affine maps and scalar functions."""

from pyspark.sql import functions as F

from voxfabric.functions import affine, scalars
from voxfabric.operators import bounds, catalog
from voxfabric.queries.registry import query
from voxfabric.sources import derived
from voxfabric.sources.derived import with_sql


def _mip(half_pixel):
    level = F.col("level")
    f = F.pow(F.lit(2.0), level)
    return affine.scaling([f, f, F.pow(F.lit(2.0), F.greatest(level - 1, F.lit(0)))], half_pixel)


def _levels(spark, sf_dir):
    return derived.views(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))


@query(with_sql("views sparse", """
SELECT setup, s.t AS t, x, y, z, model[1]*x + model[2]*y + model[3]*z + model[4] AS wx, model[5]*x + model[6]*y + model[7]*z + model[8] AS wy, model[9]*x + model[10]*y + model[11]*z + model[12] AS wz
FROM sparse s JOIN views w ON s.setup = w.setup_id AND s.t = w.t WHERE present"""))
def affine_apply(spark, sf_dir):
    views = derived.views(spark, sf_dir).where("present").select(F.col("setup_id").alias("setup"), "t", "model")
    vox = derived.sparse_voxels(spark, sf_dir).join(views, ["setup", "t"])
    at = affine.apply("model", F.col("x"), F.col("y"), F.col("z"))
    return vox.select("setup", "t", "x", "y", "z", *[c.alias(n) for c, n in zip(at, ("wx", "wy", "wz"))])


_COMPOSED = """levels AS (SELECT *, unnest(range(0, 4)) AS level FROM views),
mips AS (SELECT *, pow(2.0, level) AS f, pow(2.0, greatest(level - 1, 0)) AS fz FROM levels)
"""


@query(with_sql("views", ", " + _COMPOSED + """
SELECT setup_id, t, level, model[1]*f AS m00, model[6]*f AS m11, model[7]*fz AS m12, model[11]*fz AS m22,
       model[1]*(f-1)*0.5 + model[4] AS m03, model[6]*(f-1)*0.5 + model[7]*(fz-1)*0.5 + model[8] AS m13, model[11]*(fz-1)*0.5 + model[12] AS m23
FROM mips""").replace("\n, levels", ",\nlevels"))
def affine_compose(spark, sf_dir):
    m = F.col("m")
    rows = _levels(spark, sf_dir).withColumn("m", affine.compose("model", _mip(True)))
    names = {"m00": 0, "m03": 3, "m11": 5, "m12": 6, "m13": 7, "m22": 10, "m23": 11}
    return rows.select("setup_id", "t", F.col("level").cast("long").alias("level"), *[m[i].alias(n) for n, i in names.items()])


@query(with_sql("views", """
SELECT setup_id, t, CAST(floor(1e6 / model[1] + 0.5) AS BIGINT) AS i00, CAST(floor(1e6 / model[6] + 0.5) AS BIGINT) AS i11, CAST(floor(-1e6 * model[4] / model[1] + 0.5) AS BIGINT) AS i03,
       CAST(floor(-1e6 * model[12] / model[11] + 0.5) AS BIGINT) AS i23 FROM views"""))
def affine_invert(spark, sf_dir):
    back = F.col("back")
    rows = derived.views(spark, sf_dir).withColumn("back", affine.inverse("model"))
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return rows.select("setup_id", "t", micro(back[0]).alias("i00"), micro(back[5]).alias("i11"), micro(back[3]).alias("i03"), micro(back[11]).alias("i23"))


@query("""SELECT p_partkey, CAST(level AS BIGINT) AS level, half, fx, fy, fz, CASE WHEN half THEN (fx - 1) * 0.5 ELSE 0 END AS ox, CASE WHEN half THEN (fy - 1) * 0.5 ELSE 0 END AS oy, CASE WHEN half THEN (fz - 1) * 0.5 ELSE 0 END AS oz
FROM (SELECT *, pow(2.0, level) AS fx, pow(2.0, level) * (1 + p_partkey % 3) AS fy, pow(2.0, greatest(level - p_size % 3, 0)) AS fz FROM part, (SELECT unnest(range(0, 4)) AS level), (SELECT unnest([true, false]) AS half))""")
def mip_transform(spark, sf_dir):
    """Maps of the levels of images of different voxels, with and without the shift of half a pixel."""
    images = derived.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("level"))
    f = F.pow(F.lit(2.0), F.col("level"))
    factors = [f, f * (1 + F.col("p_partkey") % 3), F.pow(F.lit(2.0), F.greatest(F.col("level") - F.col("p_size") % 3, F.lit(0)))]
    both = [images.withColumns({"half": F.lit(half), "m": affine.scaling(factors, half)}) for half in (True, False)]
    m = affine.entries("m")
    return both[0].unionByName(both[1]).select("p_partkey", "level", "half", *[m[5 * i].alias(f"f{a}") for i, a in enumerate("xyz")], *[m[4 * i + 3].alias(f"o{a}") for i, a in enumerate("xyz")])


@query(with_sql("views", """
SELECT setup_id, t, CAST(floor(1e6 * sqrt(model[1]*model[1]) + 0.5) AS BIGINT) AS sx, CAST(floor(1e6 * sqrt(model[6]*model[6]) + 0.5) AS BIGINT) AS sy,
       CAST(floor(1e6 * sqrt(model[3]*model[3] + model[7]*model[7]) + 0.5) AS BIGINT) AS sz,
       CAST(floor(1e6 * greatest(sqrt(model[1]*model[1] + model[5]*model[5]), sqrt(model[2]*model[2] + model[6]*model[6]), sqrt(model[3]*model[3] + model[7]*model[7])) + 0.5) AS BIGINT) AS largest FROM views"""))
def voxel_screen_size(spark, sf_dir):
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    sides = [affine.screen_length("model", d) for d in range(3)]
    return derived.views(spark, sf_dir).select("setup_id", "t", *[micro(s).alias(n) for s, n in zip(sides, ("sx", "sy", "sz"))], micro(F.greatest(*sides)).alias("largest"))


@query(with_sql("views", """
SELECT a.setup_id AS setup_id, b.setup_id AS other_id, a.t AS t FROM views a JOIN views b ON a.t = b.t AND a.setup_id < b.setup_id AND a.model[1] = b.model[1]
AND a.model[6] = b.model[6] WHERE a.model = b.model OR (a.model[4] = b.model[4] AND a.model[8] + 12 = b.model[8] AND a.model[12] + 6 = b.model[12])"""))
def affine_equal(spark, sf_dir):
    """Pairs of views of one timepoint whose maps are the same but for the setups' own shifts."""
    v = derived.views(spark, sf_dir)
    a = v.select(F.col("setup_id"), "t", F.col("model").alias("p"))
    b = v.select(F.col("setup_id").alias("other_id"), "t", F.col("model").alias("q"))
    q = affine.entries("q")
    moved = [*q[:7], q[7] - 12, *q[8:11], q[11] - 6]
    same = F.lit(True)
    for x, y in zip(affine.entries("p"), moved):
        same = same & (x == y)
    return a.join(b, "t").where(F.col("setup_id") < F.col("other_id")).where(same | affine.is_same("p", "q")).select("setup_id", "other_id", "t")


@query("""SELECT p_partkey, p_size * 1.0 / least(p_size * 1.0, 3.0, 1.5) AS vx, 3.0::DOUBLE / least(p_size * 1.0, 3.0, 1.5) AS vy, 1.5::DOUBLE / least(p_size * 1.0, 3.0, 1.5) AS vz FROM part""")
def voxel_normalised(spark, sf_dir):
    voxel = F.array(F.col("p_size") * 1.0, F.lit(3.0), F.lit(1.5))
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", voxel.alias("voxel")).withColumn("n", F.transform("voxel", lambda v: v / F.array_min("voxel")))
    return rows.select("p_partkey", *[F.col("n")[i].alias(n) for i, n in enumerate(("vx", "vy", "vz"))])


_COLOR = "CAST(p_partkey * 2654435761 % 4294967296 AS BIGINT)"


@query(f"""SELECT p_partkey, {_COLOR} // 16777216 AS a, {_COLOR} // 65536 % 256 AS r, {_COLOR} // 256 % 256 AS g, {_COLOR} % 256 AS b,
CAST(CASE WHEN {_COLOR} >= 2147483648 THEN {_COLOR} - 4294967296 ELSE {_COLOR} END AS BIGINT) AS argb FROM part""")
def pack_argb(spark, sf_dir):
    c = (F.col("p_partkey") * 2654435761) % 4294967296
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", *[(F.shiftright(c, s) % 256).alias(n) for n, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))])
    rows = rows.withColumn("argb", scalars.pack_argb(*[F.col(n) for n in "argb"]))
    return rows.select("p_partkey", *[v.cast("long").alias(n) for n, v in scalars.channels(F.col("argb")).items()], F.col("argb").cast("long").alias("argb"))


_ARGB = "argb"


@query("""
WITH s AS (SELECT event_id, CAST(abs(floor(value)) % 9 AS BIGINT) AS lo, CAST(abs(floor(value)) % 9 + 1 + event_id % 5 AS BIGINT) AS hi, CAST(event_id % 13 - 2 AS BIGINT) AS v FROM events)
SELECT event_id, least(0, v) AS min_min_bound, greatest(20, v) AS min_max_bound, v AS min_low, greatest(hi, v) AS min_high,
       least(lo, v) AS max_low, v AS max_high,
       v AS mb_min_bound, greatest(20, v) AS mb_max_bound, greatest(lo, v) AS mb_low, greatest(hi, v) AS mb_high,
       least(0, v) AS xb_min_bound, v AS xb_max_bound, least(lo, v) AS xb_low, least(hi, v) AS xb_high,
       least(lo, 5) AS join_low, greatest(hi, 8) AS join_high, lo <= hi AND hi <= 20 AS ok FROM s""")
def bounded_range(spark, sf_dir):
    whole = F.abs(F.floor("value")) % 9
    rows = derived.table(spark, sf_dir, "events").select("event_id", whole.cast("long").alias("lo"), (whole + 1 + F.col("event_id") % 5).cast("long").alias("hi"), (F.col("event_id") % 13 - 2).cast("long").alias("v"))
    long = lambda n: F.lit(n).cast("long")
    r = scalars.BoundedRange(long(0), long(20), F.col("lo"), F.col("hi"))
    a, b, c, d = r.with_min(F.col("v")), r.with_max(F.col("v")), r.with_min_bound(F.col("v")), r.with_max_bound(F.col("v"))
    j = r.join(scalars.BoundedRange(long(5), long(8), long(5), long(8)))
    cols = {"min_min_bound": a.min_bound, "min_max_bound": a.max_bound, "min_low": a.low, "min_high": a.high, "max_low": b.low, "max_high": b.high, "join_low": j.low, "join_high": j.high, "ok": r.valid()}
    cols |= {f"{p}_{n}": getattr(x, n) for p, x in (("mb", c), ("xb", d)) for n in ("min_bound", "max_bound", "low", "high")}
    return rows.select("event_id", *[v.alias(k) for k, v in cols.items()])


@query("""
WITH p AS (SELECT p_partkey, 1.0::DOUBLE / (p_size * 0.75::DOUBLE) AS pixel, ['nm', 'um', 'mm', 'm', 'km', 'inch'][p_partkey % 6 + 1] AS unit FROM part),
w AS (SELECT *, floor(log10(100.0 * pixel)) AS pot FROM p),
f AS (SELECT *, CAST(trunc(0.4::DOUBLE * (100.0 * pixel / 10.0::DOUBLE ** pot)) AS BIGINT) AS fracs FROM w),
s AS (SELECT *, CASE WHEN fracs > 0 THEN 10.0::DOUBLE ** (pot + 1) * fracs / 4 ELSE 10.0::DOUBLE ** pot END AS low, 10.0::DOUBLE ** (pot + 1) * (fracs + 1) / 4 AS high FROM f),
b AS (SELECT *, CASE WHEN abs(low / pixel - 100.0) < abs(high / pixel - 100.0) THEN low ELSE high END AS length FROM s),
u AS (SELECT *, coalesce(list_position(['nm', 'um', 'mm', 'm', 'km'], unit), 0) AS place, CAST(floor((log10(length) + 1) / 3) AS BIGINT) AS wanted FROM b),
k AS (SELECT *, CASE WHEN place > 0 THEN least(greatest(place + wanted, 1), 5) - place ELSE 0 END AS shift FROM u)
SELECT p_partkey, CAST(floor(1e6 * length + 0.5) AS BIGINT) AS length, CAST(floor(1e6 * length / pixel + 0.5) AS BIGINT) AS pixels,
CAST(floor(1e6 * length / 1000.0::DOUBLE ** shift + 0.5) AS BIGINT) AS shown, CASE WHEN place > 0 THEN ['nm', '\u00b5m', 'mm', 'm', 'km'][place + shift] ELSE unit END AS unit FROM k""")
def scale_bar(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("nm", "um", "mm", "m", "km", "inch")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", (1.0 / (F.col("p_size") * 0.75)).alias("pixel"), unit.alias("unit"))
    rows = rows.withColumn("length", scalars.scale_bar(F.col("pixel")))
    shown, name = scalars.in_short_unit(F.col("length"), F.col("unit"))
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return rows.select("p_partkey", micro(F.col("length")).alias("length"), micro(F.col("length") / F.col("pixel")).alias("pixels"), micro(shown).alias("shown"), name.alias("unit"))


@query("""SELECT p_partkey, least(CASE d WHEN 'uint8' THEN 0 WHEN 'int8' THEN -128 WHEN 'float32' THEN 0 WHEN 'uint16' THEN 0 ELSE -32768 END::DOUBLE, p_size - 200.0) AS low,
greatest(CASE d WHEN 'uint8' THEN 255 WHEN 'int8' THEN 127 WHEN 'float32' THEN 1 WHEN 'uint16' THEN 65535 ELSE 32767 END::DOUBLE, p_size * 10.0) AS high
FROM (SELECT p_partkey, p_size, ['uint8', 'int8', 'float32', 'uint16', 'int16'][p_partkey % 5 + 1] AS d FROM part)""")
def default_bounds(spark, sf_dir):
    d = F.element_at(F.array(*[F.lit(x) for x in ("uint8", "int8", "float32", "uint16", "int16")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    low, high = scalars.default_bounds(d, F.col("p_size") - 200.0, F.col("p_size") * 10.0)
    return derived.table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('part ', p_partkey) WHEN p_size % 3 = 1 THEN concat('a ', p_size, ' c ', p_partkey % 4) ELSE concat('c ', p_partkey % 4) END AS name FROM part""")
def setup_name(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(s % 3 == 0, F.concat(F.lit("part "), k))
    angle = F.when(s % 3 == 1, s.cast("string"))
    return catalog.names_of(derived.table(spark, sf_dir, "part"), name, angle, (k % 4).cast("string")).select("p_partkey", "name")


@query("""SELECT p_partkey, printf('setup%d/timepoint%d/s%d', p_partkey % 7, p_size, p_partkey % 3) AS n5, printf('t%05d/s%02d/%d/cells', p_size, p_partkey % 7, p_partkey % 3) AS hdf5 FROM part""")
def chunk_paths(spark, sf_dir):
    s, t, level = F.col("p_partkey") % 7, F.col("p_size"), F.col("p_partkey") % 3
    return derived.table(spark, sf_dir, "part").select("p_partkey", scalars.n5_path(s, t, level).alias("n5"), scalars.hdf5_path(t, s, level).alias("hdf5"))


@query(with_sql("boxes", """
SELECT source_id, CAST(k AS BIGINT) AS corner, CASE WHEN k % 2 = 1 THEN max_x ELSE min_x END AS x, CASE WHEN k // 2 % 2 = 1 THEN max_y ELSE min_y END AS y, CASE WHEN k // 4 = 1 THEN max_z ELSE min_z END AS z
FROM boxes, (SELECT unnest(range(0, 8)) AS k)"""))
def box_corners(spark, sf_dir):
    out = bounds.corners(derived.boxes(spark, sf_dir))
    return out.select("source_id", F.col("corner").cast("long").alias("corner"), *[F.col(a).cast("long").alias(a) for a in "xyz"])


@query(with_sql("boxes", """
SELECT source_id, CAST(floor(min_x - 0.5 + 0.25 + 0.5) AS BIGINT) AS grown_min_x, CAST(floor(max_x + 0.5 - 0.25 + 0.5) AS BIGINT) AS grown_max_x, CAST(floor(min_y - 0.25 + 0.5) AS BIGINT) AS shrunk_min_y FROM boxes"""))
def box_model(spark, sf_dir):
    box = {k: F.col(k).cast("double") for k in ("min_x", "max_x", "min_y")}
    edges = bounds.rounded(bounds.grown(bounds.grown(box, 0.5), -0.25))
    return derived.boxes(spark, sf_dir).select("source_id", edges["min_x"].alias("grown_min_x"), edges["max_x"].alias("grown_max_x"), bounds.rounded(bounds.grown(box, 0.25))["min_y"].alias("shrunk_min_y"))


@query("""SELECT p_partkey, CAST(floor(1e6 * (0.5 - cos(p_size / 50.0 * pi()) * 0.5) + 0.5) AS BIGINT) AS eased,
CAST(floor(1e6 * CASE WHEN p_size / 50.0 <= 0.2 THEN sin(p_size / 50.0 / 0.2 * pi() / 2) WHEN p_size / 50.0 >= 0.5 THEN sin((1.0 - p_size / 50.0) / 0.5 * pi() / 2) ELSE 1.0 END + 0.5) AS BIGINT) AS faded FROM part""")
def animation_time(spark, sf_dir):
    t = F.col("p_size") / 50.0
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return derived.table(spark, sf_dir, "part").select("p_partkey", micro(scalars.cosine_ease(t)).alias("eased"), micro(scalars.fade(t)).alias("faded"))


@query("""
WITH s AS (SELECT event_id, CAST(event_id % 40 AS BIGINT) AS lo, CAST(event_id % 40 + 5 + event_id % 11 AS BIGINT) AS hi, CAST(event_id % 77 - 8 AS BIGINT) AS v FROM events),
r AS (SELECT *, least(greatest(lo, 10), 25) AS l, least(greatest(hi, 15), 30) AS h FROM s)
SELECT event_id, least(greatest(v, 0), 55) AS low_low, greatest(hi, least(greatest(v, 0), 55) + 5) AS low_high, least(lo, least(greatest(v, 5), 60) - 5) AS high_low, least(greatest(v, 5), 60) AS high_high,
CASE WHEN l > h - 5 AND h = 30 THEN h - 5 ELSE l END AS range_low, CASE WHEN l > h - 5 AND h <> 30 THEN l + 5 ELSE h END AS range_high FROM r""")
def bounded_interval(spark, sf_dir):
    k = F.col("event_id")
    rows = derived.table(spark, sf_dir, "events").select("event_id", (k % 40).alias("lo"), (k % 40 + 5 + k % 11).alias("hi"), (k % 77 - 8).alias("v"))
    long = lambda n: F.lit(n).cast("long")
    i = scalars.BoundedInterval(long(0), long(60), F.col("lo"), F.col("hi"), long(5))
    steps = {"low": i.with_low(F.col("v")), "high": i.with_high(F.col("v")), "range": i.with_range(long(10), long(30))}
    return rows.select("event_id", *[c.alias(f"{n}_{e}") for n, x in steps.items() for e, c in (("low", x.low), ("high", x.high))])
