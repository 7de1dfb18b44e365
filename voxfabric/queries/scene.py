"""What is shown, how the viewer moves, and adaptive tiles."""

from pyspark.sql import functions as F

from voxfabric.functions import affine
from voxfabric.operators import camera, overlays, scene, screen, tiling
from voxfabric.operators import navigation as moves
from voxfabric.queries.registry import query
from voxfabric.queries.screen import HEIGHT, VIEW, WIDTH
from voxfabric.sources import derived
from voxfabric.sources.derived import with_sql


def _micro(c):
    return F.floor(c * 1e6 + 0.5).cast("long")


_M = "floor(1e6 * ({}) + 0.5)::BIGINT"
_TYPES = ("uint8", "uint16", "argb", "int16")
_TYPE_SQL = "['uint8', 'uint16', 'argb', 'int16'][CAST(n_nationkey % 4 + 1 AS INT)]"
_TOP_SQL = f"CASE {_TYPE_SQL} WHEN 'uint8' THEN 255 WHEN 'argb' THEN 255 WHEN 'int16' THEN 32767 ELSE 65535 END::DOUBLE"


def _display(spark, sf_dir):
    """The first ten sources shown, then the others."""
    dtype = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("source_id") % 4 + 1).cast("int"))
    rows = derived.sources(spark, sf_dir).select(F.col("source_id").alias("ord"), "name", dtype.alias("dtype"))
    empty = spark.createDataFrame([], "source_id long, name string, dtype string, color int, cmin double, cmax double, active boolean, current boolean")
    return scene.show(scene.show(empty, rows.where("ord < 10")), rows.where("ord >= 10"))


_SHOWN = f"""shown AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS name, {_TYPE_SQL} AS dtype, -1 AS color, 0.0::DOUBLE AS cmin, {_TOP_SQL} AS cmax, true AS active, n_nationkey = 0 AS current FROM nation)"""


@query(f"WITH {_SHOWN} SELECT * FROM shown")
def show_sources(spark, sf_dir):
    return _display(spark, sf_dir)


@query(f"""WITH {_SHOWN}, n AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN cmax / 2 ELSE cmax END AS c2, CASE WHEN source_id % 3 = 0 AND dtype <> 'argb' THEN -256 ELSE color END AS k2 FROM shown)
SELECT source_id, name, dtype, k2 AS color, cmin, c2 AS cmax, active, current, c2 <> cmax OR k2 <> color AS differs FROM n""")
def handle_changes(spark, sf_dir):
    """Display range and colour set for every third source."""
    s = _display(spark, sf_dir)
    changes = s.where("source_id % 3 = 0").select("source_id", (F.col("cmax") / 2).alias("cmax"), scene.colored_where(F.col("dtype"), F.col("color"), F.lit(-256)).alias("color"))
    return scene.changed(s, changes)


@query(f"""WITH {_SHOWN} SELECT source_id, name, source_id = 2 AS current, active, CASE WHEN dtype = 'argb' THEN NULL ELSE color END AS color FROM shown WHERE source_id NOT IN (0, 1)
UNION ALL SELECT 100, 'waiting', false, false, NULL""")
def source_table(spark, sf_dir):
    """The table of sources after the current one and another were removed and a placeholder was added."""
    s = scene.set_current(_display(spark, sf_dir), 1)
    left = scene.removed(s, spark.range(2).withColumnRenamed("id", "source_id"))
    return scene.source_table(scene.with_placeholders(left, spark.createDataFrame([(100, "waiting")], "source_id long, name string")))


@query(f"WITH {_SHOWN} SELECT source_id AS ord, name, dtype, t FROM shown, (SELECT unnest(range(0, 5))::INT AS t)")
def channel_views(spark, sf_dir):
    return scene.channels_of(_display(spark, sf_dir).withColumnRenamed("source_id", "ord"), 5)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 't = tp' || p_size ELSE 't = ' || p_size END AS timepoint, p_name AS source, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS "group" FROM part""")
def info_text(spark, sf_dir):
    k = F.col("p_size")
    texts = scene.info_text(k, F.when(k % 2 == 0, F.concat(F.lit("tp"), k)), F.col("p_name"), F.col("p_brand"), k % 3 == 0)
    return derived.table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in texts.items()])


@query(with_sql("views", f"""SELECT setup_id, t, CASE WHEN setup_id % 2 = 0 THEN 2 * model[1] ELSE model[1] END AS fx, CASE WHEN setup_id % 2 = 0 THEN 2 * (model[4] + 3 * model[1]) + 8 ELSE model[4] END AS ftx,
CASE WHEN setup_id % 2 = 0 THEN {_M.format('-(2 * (model[4] + 3 * model[1]) + 8) / (2 * model[1])')} ELSE 0 END AS back FROM views"""))
def manual_transform(spark, sf_dir):
    """Maps dragged by 3, then doubled and moved by 8, made lasting for every other source; and how to undo them."""
    one = (1.0, 0.0, 0.0, 3.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    live = (2.0, 0.0, 0.0, 8.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0)
    rows = derived.views(spark, sf_dir).select("setup_id", "t", F.col("model").alias("fixed"), affine.affine(one).alias("incremental"), (F.col("setup_id") % 2 == 0).alias("chosen"))
    out = scene.applied(rows, live)
    back = scene.reset(out)
    f, b = affine.entries("fixed"), affine.entries("incremental")
    return back.select("setup_id", "t", f[0].alias("fx"), f[3].alias("ftx"), _micro(b[3]).alias("back"))


@query(with_sql("views", """, v AS (SELECT t AS source_id, setup_id, model[4] AS tx FROM views), ok AS (SELECT setup_id % 2 = 0 AS same, setup_id, source_id, tx FROM v)
SELECT setup_id, source_id, CASE WHEN same THEN tx + 1 ELSE tx END AS tx FROM ok""").replace("AS t))\n,", "AS t)),"))
def restored_transforms(spark, sf_dir):
    """Transforms saved and restored: for even setups as many as there are sources, for odd ones too few, which changes nothing."""
    v = derived.views(spark, sf_dir).select("setup_id", F.col("t").alias("source_id"), F.col("model").alias("fixed"))
    out = None
    for k in (0, 1):
        # The lists of one setup each; a setup's number is in its ids here, so that all are restored at once.
        own = v.where(F.col("setup_id") % 2 == k).withColumn("source_id", F.col("setup_id") * 100 + F.col("source_id"))
        kept = scene.saved_transforms(own).withColumn("fixed", camera.moved("fixed", 1.0, 0.0))
        got = scene.restored_transforms(own, kept if k == 0 else kept.where("index > 0"))
        out = got if out is None else out.unionByName(got)
    return out.select("setup_id", (F.col("source_id") % 100).alias("source_id"), F.col("fixed")[3].alias("tx"))


@query(with_sql("sparse", "SELECT CAST(setup AS BIGINT) AS setup, CAST(t AS BIGINT) AS t, x, y, z, v FROM sparse WHERE t BETWEEN 2 AND 4 AND x BETWEEN 10 AND 50 AND y BETWEEN 5 AND 40 AND z BETWEEN 1 AND 3"))
def box_query(spark, sf_dir):
    found = scene.box_query(derived.sparse_voxels(spark, sf_dir), (10, 5, 1), (50, 40, 3), (2, 4))
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("setup", "t")], "x", "y", "z", "v")


@query("""SELECT CAST(CASE WHEN n_nationkey = 3 THEN 90 ELSE n_nationkey END AS BIGINT) AS source_id, n_name AS name FROM nation""")
def single_id_change(spark, sf_dir):
    return scene.renumbered(derived.sources(spark, sf_dir).select("source_id", "name"), "source_id", 3, 90)


@query("""
WITH taken AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE 'style' || n_regionkey || ' (' || (n_nationkey % 7 + 1) || ')' END AS name, n_regionkey FROM nation),
ask AS (SELECT r_regionkey, 'style' || r_regionkey AS stem, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 2 END AS after FROM region)
SELECT CAST(r_regionkey AS BIGINT) AS key, stem || ' (' || min(n) || ')' AS free FROM ask, (SELECT unnest(range(2, 40)) AS n)
WHERE n > after AND stem || ' (' || n || ')' NOT IN (SELECT name FROM taken) GROUP BY r_regionkey, stem""")
def free_names(spark, sf_dir):
    """The next free name of copied styles."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    made = F.concat(F.lit("style"), r, F.lit(" ("), k % 7 + 1, F.lit(")"))
    taken = derived.table(spark, sf_dir, "nation").select(F.when(k % 5 == 0, F.col("n_name")).otherwise(made).alias("name"))
    key = F.col("r_regionkey").cast("long")
    name = F.concat(F.lit("style"), key, F.when(key % 2 == 0, "").otherwise(" (2)"))
    rows = derived.table(spark, sf_dir, "region").select(key.alias("key"), name.alias("copied"))
    return scene.free_name(F.col("copied"), taken, rows, ["key"])


@query(with_sql("views", """SELECT 0 AS part, setup_id, t AS timepoint_id, model[4] AS tx FROM views WHERE setup_id < 10 UNION ALL SELECT 1, setup_id - 10 + 10, t, model[4] + 5 FROM views WHERE setup_id >= 10"""))
def merge_new_setups(spark, sf_dir):
    """A data set of setups 0 to 14 put after one of setups 0 to 9, its maps moved by 5."""
    v = derived.views(spark, sf_dir)
    second = F.col("setup_id") >= 10
    parts = v.select(second.cast("int").alias("part"), F.when(second, F.col("setup_id") - 10).otherwise(F.col("setup_id")).alias("setup_id"), F.col("t").alias("timepoint_id"), "model")
    extra = (1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return scene.merged_setups(parts, extra).select("part", "setup_id", "timepoint_id", F.col("model")[3].alias("tx"))


@query(with_sql("views", """SELECT 'all.h5' AS path, count(DISTINCT t) AS timepoints, count(DISTINCT setup_id) AS setups, max(setup_id) AS last FROM views UNION ALL SELECT 'part-0', 2, 3, 2"""))
def partition_union(spark, sf_dir):
    """The partitions of two data sets: one without any, and one with a partition of its own."""
    v = derived.views(spark, sf_dir).select(F.col("t").alias("timepoint_id"), "setup_id")
    ids = lambda n: F.map_from_arrays(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = spark.range(1).select(F.lit("part-0").alias("path"), ids(2).alias("timepoint_map"), ids(3).alias("setup_map"))
    both = scene.partitions_or_whole(own.limit(0), v, "all.h5").unionByName(scene.partitions_or_whole(own, v, "never"))
    last = F.array_max(F.map_keys("setup_map"))
    return both.select("path", F.size("timepoint_map").cast("long").alias("timepoints"), F.size("setup_map").cast("long").alias("setups"), last.alias("last"))


@query("""SELECT p_partkey, '{ {1,1,1}, {' || p_size || ',' || p_size || ',' || p_partkey % 5 || '} }' AS resolutions, p_partkey % 5 AS first, trunc(p_size * 0.5 - 10)::INT AS cut FROM part""")
def axis_order(spark, sf_dir):
    """Resolutions as text, coordinates of the other axis order, numbers cut to whole ones."""
    k, s = (F.col("p_partkey") % 5).cast("int"), F.col("p_size").cast("int")
    three = lambda *v: F.array(*[x if hasattr(x, "alias") else F.lit(x) for x in v])
    return derived.table(spark, sf_dir, "part").select(
        "p_partkey", scene.resolution_text(F.array(three(1, 1, 1), three(s, s, k))).alias("resolutions"), scene.column_major(three(s, s, k))[0].cast("long").alias("first"), scene.truncated(F.array(s * 0.5 - 10))[0].alias("cut")
    )


@query(with_sql("boxes views", f""", b AS (SELECT *, (min_x + max_x) / 2.0 AS sx, (min_y + max_y) / 2.0 AS sy, floor((min_z + max_z) / 2.0 + 0.5) AS sz FROM boxes),
j AS (SELECT b.*, model AS m FROM b JOIN views v ON v.setup_id = b.source_id % 25 AND v.t = b.source_id % 7),
c AS (SELECT source_id, m[1]*sx + m[4] AS cx, m[6]*sy + m[7]*sz + m[8] AS cy, m[11]*sz + m[12] AS cz, m[1]*(max_x + 0.5) + m[4] AS px, m[6]*(max_y + 0.5) + m[7]*sz + m[8] AS py FROM j),
s AS (SELECT *, least(840 / (px - cx), 498.5 / (py - cy)) AS k, greatest(840 / (px - cx), 498.5 / (py - cy)) AS big FROM c)
SELECT source_id, {_M.format('k')} AS scale, {_M.format('839.5 - cx * k')} AS tx, {_M.format('498.0 - cy * k')} AS ty, {_M.format('-cz * k')} AS tz, {_M.format('big')} AS fill FROM s""").replace("AS t))\n,", "AS t)),"))
def initial_view(spark, sf_dir):
    """The first view of each source, were it the current one."""
    v = derived.views(spark, sf_dir).select(F.col("setup_id").alias("s"), F.col("t").alias("tt"), "model")
    rows = derived.boxes(spark, sf_dir).join(v, (F.col("source_id") % 25 == F.col("s")) & (F.col("source_id") % 7 == F.col("tt")))
    low, high = ([F.col(f"{m}_{a}") for a in "xyz"] for m in ("min", "max"))
    fit, fill = (camera.initial_view("model", low, high, WIDTH, HEIGHT, f) for f in (False, True))
    p, q = affine.entries(fit), affine.entries(fill)
    return rows.select("source_id", _micro(p[0]).alias("scale"), _micro(p[3]).alias("tx"), _micro(p[7]).alias("ty"), _micro(p[11]).alias("tz"), _micro(q[0]).alias("fill"))


@query(with_sql("log", f""", e AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i, CASE WHEN kind = 'source' THEN 'zoom' WHEN kind = 'mode' THEN 'unzoom' ELSE 'drag' END AS what, arg FROM log),
r AS (WITH RECURSIVE r AS (
  SELECT session, 0::BIGINT AS i, 1.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM e GROUP BY session
  UNION ALL SELECT r.session, e.i, CASE what WHEN 'zoom' THEN s * 1.1 WHEN 'unzoom' THEN s / 1.1 ELSE s END,
    CASE what WHEN 'zoom' THEN (x - 840) * 1.1 + 840 WHEN 'unzoom' THEN (x - 840) / 1.1 + 840 ELSE x + arg * 10 END,
    CASE what WHEN 'zoom' THEN (y - 498) * 1.1 + 498 WHEN 'unzoom' THEN (y - 498) / 1.1 + 498 ELSE y - arg END
  FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1) SELECT * FROM r)
SELECT session, {_M.format('arg_max(s, i) / 7e3')} AS scale, {_M.format('arg_max(x, i) / 7e3')} AS tx, {_M.format('arg_max(y, i) / 7e3')} AS ty FROM r GROUP BY session""").replace("FROM events)\n,", "FROM events),"))
def navigation(spark, sf_dir):
    """Where each session's viewer ends: zooms by keys about the centre, and drags."""
    log = derived.event_log(spark, sf_dir)
    is_in, is_out = F.coalesce(F.col("kind") == "source", F.lit(False)), F.coalesce(F.col("kind") == "mode", F.lit(False))
    about = lambda v: F.when(is_in | is_out, v).otherwise(0.0)
    shift = lambda c: F.when(is_in | is_out, 0.0).otherwise(c)
    fields = {
        "zoom": F.when(is_in, camera.KEY_ZOOM).otherwise(1.0), "by": F.when(is_out, camera.KEY_ZOOM).otherwise(1.0),
        "x": about(840.0), "y": about(498.0), "dx": shift(F.col("arg") * 10.0), "dy": shift(-F.col("arg") * 1.0),
    }
    step = F.struct(*[c.alias(k) for k, c in fields.items()])
    out = camera.navigated(log.withColumn("step", step), ["session"], ["ts", "event_id"], affine.IDENTITY)
    p = affine.entries("viewer")
    return out.select("session", *[_micro(c / 7e3).alias(n) for c, n in ((p[0], "scale"), (p[3], "tx"), (p[7], "ty"))])


def _turn_sql(angle, axis, x, y):
    """Entries of a rotation about an axis (0 to 2) through a point of the screen."""
    a, b = (axis + 1) % 3, (axis + 2) % 3
    m = [["1" if i == k else "0" for k in range(3)] for i in range(3)]
    m[a][a], m[a][b], m[b][a], m[b][b] = f"cos({angle})", f"-sin({angle})", f"sin({angle})", f"cos({angle})"
    return _list_sql(m, [f"{x} - ({m[0][0]}) * {x} - ({m[0][1]}) * {y}", f"{y} - ({m[1][0]}) * {x} - ({m[1][1]}) * {y}", f"-({m[2][0]}) * {x} - ({m[2][1]}) * {y}"])


def _zoom_sql(s, x, y):
    return _list_sql([[s if i == k else "0" for k in range(3)] for i in range(3)], [f"{x} - ({s}) * {x}", f"{y} - ({s}) * {y}", "0"])


def _list_sql(m, shift):
    return "[" + ", ".join(f"({v})::DOUBLE" for row, t in zip(m, shift) for v in (*row, t)) + "]"


def _compose_sql(a, b):
    """a after b, lists of 12."""
    return "[" + ", ".join(" + ".join([f"{a}[{4 * r + k + 1}] * {b}[{4 * k + c + 1}]" for k in range(3)] + [f"{a}[{4 * r + 4}]"] * (c == 3)) for r in range(3) for c in range(4)) + "]"


_ONE = [["1" if i == k else "0" for k in range(3)] for i in range(3)]
_ACTIONS = """acts AS (SELECT session, ts, event_id, arg,
  CASE kind WHEN 'timepoint' THEN ['zoom in', 'zoom out', 'scroll zoom', 'resize'][CAST(arg % 4 + 1 AS INT)] WHEN 'source' THEN ['select axis x', 'select axis y', 'select axis z'][CAST(arg % 3 + 1 AS INT)]
    WHEN 'mode' THEN ['rotate left', 'rotate right'][CAST(arg % 2 + 1 AS INT)] WHEN 'add' THEN ['drag translate', 'drag rotate'][CAST(arg % 2 + 1 AS INT)] ELSE ['scroll z', 'backward z'][CAST(arg % 2 + 1 AS INT)] END AS action
  FROM log)"""


def _axis_turn_sql(angle):
    return "CASE axis WHEN 0 THEN " + _turn_sql(angle, 0, "cx", "cy") + " WHEN 1 THEN " + _turn_sql(angle, 1, "cx", "cy") + " ELSE " + _turn_sql(angle, 2, "cx", "cy") + " END"


_NAVIGATED = f"""placed AS (SELECT *, row_number() OVER w AS i,
    coalesce(last_value(CASE action WHEN 'select axis x' THEN 0 WHEN 'select axis y' THEN 1 WHEN 'select axis z' THEN 2 END IGNORE NULLS) OVER p, 0) AS axis,
    coalesce(last_value(CASE WHEN action = 'resize' THEN 1000 + 7 * arg END IGNORE NULLS) OVER p, 1680) AS ow, coalesce(last_value(CASE WHEN action = 'resize' THEN 800 - arg END IGNORE NULLS) OVER p, 997) AS oh
  FROM acts WINDOW w AS (PARTITION BY session ORDER BY ts, event_id), p AS (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, ow // 2 AS cx, oh // 2 AS cy, (1000 + 7 * arg) / ow::DOUBLE AS k FROM placed),
st AS (SELECT session, ts, event_id, i, CASE action WHEN 'zoom in' THEN {_zoom_sql('1.1', 'cx', 'cy')} WHEN 'zoom out' THEN {_zoom_sql('1 / 1.1', 'cx', 'cy')}
  WHEN 'scroll zoom' THEN CASE WHEN arg > 5 THEN {_zoom_sql('1 / 1.05', 'arg * 100', 'arg * 50')} ELSE {_zoom_sql('1.05', 'arg * 100', 'arg * 50')} END
  WHEN 'resize' THEN {_list_sql([["k" if i == j else "0" for j in range(3)] for i in range(3)], ["(1000 + 7 * arg) // 2 - k * cx", "(800 - arg) // 2 - k * cy", "0"])}
  WHEN 'rotate left' THEN {_axis_turn_sql('radians(10.0)')} WHEN 'rotate right' THEN {_axis_turn_sql('-radians(0.1)')}
  WHEN 'drag translate' THEN {_list_sql(_ONE, ["arg * 10", "-arg", "0"])}
  WHEN 'drag rotate' THEN {_compose_sql("(" + _turn_sql('radians(-arg)', 1, '100', '90') + ")", "(" + _turn_sql('-radians(2 * arg)', 0, '100', '90') + ")")}
  WHEN 'scroll z' THEN {_list_sql(_ONE, ["0", "0", "arg - 4"])} WHEN 'backward z' THEN {_list_sql(_ONE, ["0", "0", "-1"])}
  ELSE {_list_sql(_ONE, ["0", "0", "0"])} END AS s FROM c),
r AS (WITH RECURSIVE r AS (SELECT session, ts, event_id, i, s AS m FROM st WHERE i = 1
  UNION ALL SELECT r.session, e.ts, e.event_id, e.i, {_compose_sql('s', 'm')} FROM r JOIN st e ON e.session = r.session AND e.i = r.i + 1) SELECT * FROM r)
SELECT session, event_id, {", ".join(_M.format(f"m[{j + 1}] / 7e3") + f" AS m{j}" for j in range(12))} FROM r"""


@query(with_sql("log", ", " + _ACTIONS + ",\n" + _NAVIGATED).replace("FROM events)\n,", "FROM events),"))
def navigation_events(spark, sf_dir):
    """The viewer after each event of three-dimensional navigation: zooms, turns about chosen axes, drags, scrolls and new window sizes."""
    log, arg = derived.event_log(spark, sf_dir), F.col("arg")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (arg % n + 1).cast("int"))
    action = (
        F.when(F.col("kind") == "timepoint", pick(("zoom in", "zoom out", "scroll zoom", "resize"), 4)).when(F.col("kind") == "source", pick(("select axis x", "select axis y", "select axis z"), 3))
        .when(F.col("kind") == "mode", pick(("rotate left", "rotate right"), 2)).when(F.col("kind") == "add", pick(("drag translate", "drag rotate"), 2)).otherwise(pick(("scroll z", "backward z"), 2))
    )
    e = log.select("session", "ts", "event_id", "arg", action.alias("action"))
    is_ = lambda name: F.col("action") == name
    e = e.withColumns({
        "speed": F.when(is_("rotate left"), 10.0).when(is_("rotate right"), 0.1).otherwise(1.0), "wheel": F.when(is_("scroll z"), arg - 4.0).otherwise(arg - 5.0),
        "from_x": F.when(is_("drag rotate"), 100.0).otherwise(0.0), "from_y": F.when(is_("drag rotate"), 90.0).otherwise(0.0),
        "x": F.when(is_("scroll zoom"), arg * 100.0).when(is_("drag rotate"), 100.0 + arg).otherwise(arg * 10.0), "y": F.when(is_("scroll zoom"), arg * 50.0).when(is_("drag rotate"), 90.0 - 2 * arg).otherwise(-1.0 * arg),
        "width": (1000 + 7 * arg).cast("int"), "height": (800 - arg).cast("int"),
    })
    out = moves.viewers(e, ["session"], ["ts", "event_id"], affine.IDENTITY, (1680, 997))
    return out.select("session", "event_id", *[_micro(F.col("viewer")[j] / 7e3).alias(f"m{j}") for j in range(12)])


@query(f"""WITH a AS (SELECT p_partkey, (p_size - 1) / 50.0 AS t, radians(p_partkey % 170 + 1) AS w FROM part)
SELECT p_partkey, {_M.format('cos(w * t)')} AS r00, {_M.format('-sin(w * t)')} AS r01, {_M.format('100 + cos(w * t) * (7 - 100) - sin(w * t) * (9 - 50)')} AS tx, {_M.format('7 + t * 20')} AS shifted,
{_M.format('pow(4.0, t) * cos(w * t)')} AS similar FROM a""")
def animations(spark, sf_dir):
    """A turn about a point, a shift, and a zooming turn, each at some time of its way."""
    w, t = F.radians(F.col("p_partkey") % 170 + 1), (F.col("p_size") - 1) / 50.0
    start = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 7.0, 0.0, 1.0, 0.0, 9.0, 0.0, 0.0, 1.0, 0.0)])
    turn = camera.turned(affine.IDENTITY, 2, w, 0.0, 0.0)
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", t.alias("at"), start.alias("start"), turn.alias("turn"))
    end = F.transform("turn", lambda v: v * 4.0)
    r = affine.entries(camera.rotating("start", "turn", 100.0, 50.0, F.col("at")))
    s = affine.entries(camera.translating("start", [F.lit(27.0), F.lit(9.0), F.lit(0.0)], F.col("at")))
    rows = rows.withColumn("end", end)
    z = affine.entries(camera.similar("start", "end", F.col("at")))
    return rows.select("p_partkey", _micro(r[0]).alias("r00"), _micro(r[1]).alias("r01"), _micro(r[3]).alias("tx"), _micro(s[3]).alias("shifted"), _micro(z[0]).alias("similar"))


_ALIGNED = "CASE plane WHEN 'XY' THEN [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[] WHEN 'ZY' THEN [0, 0, 1, 0, 1, 0, -1, 0, 0]::DOUBLE[] ELSE [1, 0, 0, 0, s, c, 0, -c, s] END"


@query(with_sql("views", f""", a AS (SELECT setup_id, t, plane, 2 / sqrt(model[7] * model[7] + 4) AS c, model[7] / sqrt(model[7] * model[7] + 4) AS s FROM views, (SELECT unnest(['XY', 'ZY', 'XZ']) AS plane)),
m AS (SELECT setup_id, t, plane, {_ALIGNED} AS m FROM a)
SELECT setup_id, t, plane, {", ".join(_M.format(f"m[{3 * r + c + 1}]") + f" AS m{4 * r + c}" for r in range(3) for c in range(3))}, {", ".join(_M.format(f"{(100, 50, 0)[r]} - m[{3 * r + 1}] * 100 - m[{3 * r + 2}] * 50") + f" AS m{4 * r + 3}" for r in range(3))} FROM m""").replace("AS t))\n,", "AS t)),"))
def align_planes(spark, sf_dir):
    """The viewer turned about a point of the screen to each plane of each view: all entries."""
    out = None
    for plane in ("XY", "ZY", "XZ"):
        rows = derived.views(spark, sf_dir).withColumn("aligned", camera.aligned(affine.IDENTITY, "model", plane, 100.0, 50.0))
        one = rows.select("setup_id", "t", F.lit(plane).alias("plane"), *[_micro(F.col("aligned")[i]).alias(f"m{i}") for i in range(12)])
        out = one if out is None else out.unionByName(one)
    return out


@query(with_sql("boxes", f"""SELECT culled, {_M.format("CASE WHEN w / 1680 > 1 THEN 0.75 * 0.1 / (w / 1680) ELSE 0.75 * 0.1 END")} AS scale FROM (SELECT culled, greatest(max(max_x) - min(min_x), max(max_y) - min(min_y), max(max_z) - min(min_z))::DOUBLE AS w FROM boxes GROUP BY culled)"""))
def overview_scale(spark, sf_dir):
    """Scale of the overview of boxes in a tenth of the screen."""
    size = F.greatest(*[F.max(f"max_{a}") - F.min(f"min_{a}") for a in "xyz"]).cast("double")
    rows = derived.boxes(spark, sf_dir).groupBy("culled").agg(size.alias("size"))
    return rows.select("culled", _micro(camera.fit_boxes(F.col("size"), (WIDTH, HEIGHT), (168, 100))).alias("scale"))


@query(with_sql("boxes", """
SELECT p.source_id AS source_id, floor(1e3 * ((min_x + max_x) * 0.25 + 64) + 0.5)::BIGINT AS cx, floor(1e3 * ((min_y + max_y) * 0.25 + 32) + 0.5)::BIGINT AS cy FROM boxes p WHERE min_z <= 0 AND max_z > 0"""))
def polygon_centre(spark, sf_dir):
    """Centres of the polygons in which boxes meet the screen."""
    found = overlays.section_polygons(overlays.box_edges(derived.boxes(spark, sf_dir), "source_id", VIEW), "source_id")
    return found.groupBy("source_id").agg(F.floor(F.first("cx") * 1e3 + 0.5).cast("long").alias("cx"), F.floor(F.first("cy") * 1e3 + 0.5).cast("long").alias("cy"))


@query()
def adaptive_tiles(spark, sf_dir):
    """Tiles of frames that show a part of the sources each, split at the sources' edges."""
    seen = screen.cull(derived.boxes(spark, sf_dir), VIEW, WIDTH, HEIGHT)
    rects = screen.screen_rectangle(seen, WIDTH, HEIGHT).select((F.col("source_id") % 16).alias("frame"), "source_id", "culled", "x0", "y0", "x1", "y1")
    return tiling.adaptive_tiles(rects, ["frame"], WIDTH, HEIGHT)


def _split_sql(tiles, members, out):
    """One level of splitting, as relations out_t (tiles) and out_m (members)."""
    return f"""
{out}_e AS (SELECT DISTINCT frame, path, x0, y0, x1, y1, axis, cut FROM (SELECT frame, path, x0, y0, x1, y1, unnest([0, 0, 1, 1]) AS axis, unnest([rx0, rx1 + 1, ry0, ry1 + 1]) AS cut FROM {members})
  WHERE CASE axis WHEN 0 THEN cut > x0 AND cut <= x1 ELSE cut > y0 AND cut <= y1 END),
{out}_l AS (SELECT frame, path, coalesce(list(cut ORDER BY cut) FILTER (axis = 0), []) AS ex, coalesce(list(cut ORDER BY cut) FILTER (axis = 1), []) AS ey FROM {out}_e GROUP BY frame, path),
{out}_p AS (SELECT t.*, CASE WHEN y1 - y0 >= x1 - x0 THEN CASE WHEN len(ey) > 0 THEN 1 ELSE 0 END ELSE CASE WHEN len(ex) > 0 THEN 0 ELSE 1 END END AS axis, ex, ey FROM {tiles} t JOIN {out}_l USING (frame, path) WHERE (x1 - x0 + 1) * (y1 - y0 + 1) > 64),
{out}_a AS (SELECT *, CASE axis WHEN 0 THEN ex[len(ex) // 2 + 1] ELSE ey[len(ey) // 2 + 1] END AS cut FROM {out}_p),
{out}_t AS (SELECT frame, path || side AS path, CASE WHEN axis = 0 AND side = 1 THEN cut ELSE x0 END AS x0, CASE WHEN axis = 1 AND side = 1 THEN cut ELSE y0 END AS y0, CASE WHEN axis = 0 AND side = 0 THEN cut - 1 ELSE x1 END AS x1,
    CASE WHEN axis = 1 AND side = 0 THEN cut - 1 ELSE y1 END AS y1 FROM {out}_a, (SELECT unnest([0, 1]) AS side)
  UNION ALL SELECT frame, path, x0, y0, x1, y1 FROM {tiles} WHERE (frame, path) NOT IN (SELECT (frame, path) FROM {out}_p)),
{out}_m AS (SELECT t.*, source_id, rx0, ry0, rx1, ry1 FROM {out}_t t JOIN r USING (frame) WHERE rx0 <= x1 AND rx1 >= x0 AND ry0 <= y1 AND ry1 >= y0)"""


@query(with_sql("boxes", f""",
bounded AS (SELECT *, 0.5*(min_x-0.5) + 64 AS sx0, 0.5*(max_x+0.5) + 64 AS sx1, 0.5*(min_y-0.5) + 0.25*(min_z-0.5) + 32 AS sy0, 0.5*(max_y+0.5) + 0.25*(max_z+0.5) + 32 AS sy1, min_z-0.5 AS sz0, max_z+0.5 AS sz1 FROM boxes),
seen AS (SELECT * FROM bounded WHERE culled AND sx1 >= 0 AND sx0 <= 1679 AND sy1 >= 0 AND sy0 <= 996 AND sz0 <= 0 AND sz1 >= 0),
r AS (SELECT * FROM (SELECT source_id % 16 AS frame, source_id, CAST(greatest(floor(sx0), 0) AS BIGINT) AS rx0, CAST(greatest(floor(sy0), 0) AS BIGINT) AS ry0, CAST(least(ceil(sx1), 1679) AS BIGINT) AS rx1, CAST(least(ceil(sy1), 996) AS BIGINT) AS ry1 FROM seen) WHERE rx0 <= rx1 AND ry0 <= ry1),
a_t AS (SELECT DISTINCT frame, '' AS path, 0::BIGINT AS x0, 0::BIGINT AS y0, 1679::BIGINT AS x1, 996::BIGINT AS y1 FROM r), a_m AS (SELECT t.*, source_id, rx0, ry0, rx1, ry1 FROM a_t t JOIN r USING (frame)),
{_split_sql('a_t', 'a_m', 'b')}, {_split_sql('b_t', 'b_m', 'c')}, {_split_sql('c_t', 'c_m', 'd')}
SELECT frame, t.x0 AS x0, t.y0 AS y0, t.x1 AS x1, t.y1 AS y1, source_id FROM d_t t LEFT JOIN d_m m USING (frame, path)""").replace("FROM part)\n,", "FROM part),"))
def adaptive_tiles_levels(spark, sf_dir):
    """Three levels of splitting of all frames at once, and the sources of each tile."""
    seen = screen.cull(derived.boxes(spark, sf_dir), VIEW, WIDTH, HEIGHT)
    rects = screen.screen_rectangle(seen, WIDTH, HEIGHT).where("culled").select((F.col("source_id") % 16).alias("frame"), "source_id", "culled", "x0", "y0", "x1", "y1")
    return tiling.adaptive_tiles(rects, ["frame"], WIDTH, HEIGHT, most=1 << 40, depth=3).drop("tile_id")
