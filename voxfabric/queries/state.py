"""The viewer's state over the action log."""

from pyspark.sql import functions as F

from voxfabric.queries.registry import query
from voxfabric.sources import derived
from voxfabric.sources.derived import with_sql
from voxfabric.streaming import state

TIMEPOINTS = 7

_STATE = """st AS (
  SELECT session, ts, event_id, kind, arg,
         coalesce(last_value(CASE WHEN kind = 'timepoint' THEN least(arg, 6) END IGNORE NULLS) OVER w, 0) AS timepoint,
         last_value(CASE WHEN kind = 'source' THEN arg END IGNORE NULLS) OVER w AS source,
         ['SINGLE', 'GROUP', 'FUSED', 'FUSEDGROUP'][count(CASE WHEN kind = 'mode' THEN 1 END) OVER w % 4 + 1] AS mode
  FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def _sql(body):
    return with_sql("log", ",\n" + _STATE + "\n" + body).replace("FROM events)\n,", "FROM events),")


@query(_sql("SELECT session, event_id, timepoint, source, mode FROM st"))
def state_log(spark, sf_dir):
    return state.with_state(derived.event_log(spark, sf_dir), TIMEPOINTS).select("session", "event_id", "timepoint", "source", "mode")


@query(_sql("SELECT session, arg_max(timepoint, (ts, event_id)) AS timepoint, arg_max({'s': source}, (ts, event_id)).s AS source, arg_max(mode, (ts, event_id)) AS mode FROM st GROUP BY session"))
def state_at_end(spark, sf_dir):
    return state.final_state(derived.event_log(spark, sf_dir), TIMEPOINTS)


@query(_sql("SELECT * FROM (SELECT session, event_id, lag(timepoint, 1, 0) OVER (PARTITION BY session ORDER BY ts, event_id) AS old, timepoint AS new FROM st) WHERE old <> new"))
def change_events(spark, sf_dir):
    return state.timepoint_changes(derived.event_log(spark, sf_dir), TIMEPOINTS)


@query(with_sql("log", "SELECT session, arg AS source_id FROM log WHERE kind IN ('add', 'remove') GROUP BY session, arg HAVING arg_max(kind, (ts, event_id)) = 'add'"))
def sources_present(spark, sf_dir):
    return state.sources_present(derived.event_log(spark, sf_dir))


@query(with_sql("log", "SELECT session, event_id FROM (SELECT *, lag(kind, 1, 'remove') OVER (PARTITION BY session, arg ORDER BY ts, event_id) AS before FROM log WHERE kind IN ('add', 'remove')) WHERE kind <> before"))
def visibility_changes(spark, sf_dir):
    return state.visibility_changes(derived.event_log(spark, sf_dir))


@query(with_sql("log", "SELECT session, arg AS bookmark, arg_max(event_id, (ts, event_id)) AS event_id FROM log WHERE kind = 'source' GROUP BY session, arg"))
def bookmarks(spark, sf_dir):
    """The last setting of each bookmark."""
    log = derived.event_log(spark, sf_dir).where("kind = 'source'")
    return log.groupBy("session", F.col("arg").alias("bookmark")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_FOLD = """e AS (SELECT session, kind, arg, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i FROM log),
r AS (WITH RECURSIVE r AS (
  SELECT DISTINCT session, 0::BIGINT AS i, []::BIGINT[] AS sources, NULL::BIGINT AS source, 0::BIGINT AS turns, 0::BIGINT AS timepoint, 0::BIGINT AS changes FROM e
  UNION ALL SELECT session, i, now, src, turns + m, tp, changes + m + (tp <> timepoint)::INT + (len(now) <> len(sources))::INT + (src IS DISTINCT FROM source)::INT FROM (
    SELECT *, CASE WHEN kind = 'source' AND list_contains(sources, arg) THEN arg WHEN len(now) > len(sources) AND source IS NULL THEN arg WHEN len(now) < len(sources) AND source = arg THEN now[1] ELSE source END AS src FROM (
      SELECT r.session, e.i, e.kind, e.arg, r.sources, r.source, r.turns, r.timepoint, r.changes, (e.kind = 'mode')::INT AS m, CASE e.kind WHEN 'timepoint' THEN least(greatest(e.arg, 0), 6) ELSE r.timepoint END AS tp,
        CASE WHEN e.kind = 'add' AND NOT list_contains(r.sources, e.arg) THEN list_append(r.sources, e.arg) WHEN e.kind = 'remove' THEN list_filter(r.sources, lambda x: x <> e.arg) ELSE r.sources END AS now
      FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1))) SELECT * FROM r)
SELECT session, array_to_string(arg_max(sources, i), ',') AS sources, arg_max({'s': source}, i).s AS source, ['SINGLE', 'GROUP', 'FUSED', 'FUSEDGROUP'][CAST(arg_max(turns, i) % 4 + 1 AS INT)] AS mode, arg_max(timepoint, i) AS timepoint, arg_max(changes, i) AS changes FROM r GROUP BY session"""


@query(with_sql("log", ",\n" + _FOLD).replace("FROM events)\n,", "FROM events),"))
def state_fold(spark, sf_dir):
    """Sources in order of arrival, the current one, mode, timepoint and the number of changes at the end of each session."""
    end = state.fold(derived.event_log(spark, sf_dir), TIMEPOINTS)
    return end.select("session", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"), "source", "mode", "timepoint", "changes")


@query(with_sql("log", """, s AS (SELECT *, last_value(CASE WHEN kind IN ('add', 'remove') THEN kind END IGNORE NULLS) OVER (PARTITION BY session, arg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM log)
SELECT session, event_id, CASE WHEN kind = 'timepoint' THEN 'no such timepoint' ELSE 'no such source' END AS reason FROM s WHERE kind = 'timepoint' AND arg >= 7 OR kind = 'source' AND coalesce(was, 'remove') = 'remove'""").replace("FROM events)\n,", "FROM events),"))
def rejected_actions(spark, sf_dir):
    """Actions that name timepoints and sources that there are none of."""
    return state.rejected(derived.event_log(spark, sf_dir), TIMEPOINTS)
