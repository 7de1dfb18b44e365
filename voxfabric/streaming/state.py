"""Viewer state from a log of actions (session, ts, event_id, kind, arg).

Kinds: timepoint (go to arg), next and previous (timepoint), source (make arg
current), mode (next display mode), fused and grouping (switch that half of
the mode), interpolation (the other one), add and remove (a source), activate
and deactivate (a source), add_group and remove_group, group (make arg
current), select and toggle (by place: make current, or switch on and off, the
arg-th group if the mode has groups, else the arg-th source), bookmark (set
bookmark arg to this action) and recall (go to bookmark arg; in a stream it is
reached RECALL_MS later).

fold() and change_stream() apply the same rules to whole logs and to streams:
a session's state, and a change event only where an action changes something.
What doesn't depend on the list of sources (with_state() and what follows) is
a matter of windows: the last value that was set, by whom it may.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxfabric.operators.visibility import toggle_mode

MODES = ("SINGLE", "GROUP", "FUSED", "FUSEDGROUP")


def _by_time() -> object:
    return Window.partitionBy("session").orderBy("ts", "event_id")


def with_state(log: DataFrame, num_timepoints: int) -> DataFrame:
    """Each action with what was set last: timepoint (clamped to the last one), the source asked for (null before the first, whether it is listed or not), mode."""
    upto = _by_time().rowsBetween(Window.unboundedPreceding, 0)
    set_t = F.when(F.col("kind") == "timepoint", F.least(F.greatest("arg", F.lit(0)), F.lit(num_timepoints - 1)))
    set_s = F.when(F.col("kind") == "source", F.col("arg"))
    turns = F.count(F.when(F.col("kind") == "mode", 1)).over(upto)
    return log.withColumns(
        {
            "timepoint": F.coalesce(F.last(set_t, True).over(upto), F.lit(0)).cast("long"),
            "source": F.last(set_s, True).over(upto),
            "mode": F.element_at(F.array(*[F.lit(m) for m in MODES]), (turns % len(MODES) + 1).cast("int")),
        }
    )


def modes_after(log: DataFrame) -> DataFrame:
    """Each action with the display mode after it, where "fused" and "grouping" each switch one half of the mode on and off."""
    upto = _by_time().rowsBetween(Window.unboundedPreceding, 0)
    on = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(upto) % 2 == 1
    mode = F.when(on("fused"), F.when(on("grouping"), "FUSEDGROUP").otherwise("FUSED")).otherwise(F.when(on("grouping"), "GROUP").otherwise("SINGLE"))
    return log.withColumn("mode", mode)


def final_state(log: DataFrame, num_timepoints: int) -> DataFrame:
    """session, timepoint, source, mode after the last action."""
    place = F.struct("ts", "event_id")
    last = with_state(log, num_timepoints).groupBy("session").agg(F.max_by(F.struct("timepoint", "source", "mode"), place).alias("s"))
    return last.select("session", "s.timepoint", "s.source", "s.mode")


def timepoint_changes(log: DataFrame, num_timepoints: int) -> DataFrame:
    """session, event_id, old, new: actions that changed the timepoint."""
    moves = with_state(log, num_timepoints)
    old = F.lag("timepoint", 1, 0).over(_by_time())
    return moves.select("session", "event_id", old.cast("long").alias("old"), F.col("timepoint").alias("new")).where("old <> new")


def sources_present(log: DataFrame) -> DataFrame:
    """session, source_id: sources whose last action was to be added."""
    place = F.struct("ts", "event_id")
    last = log.where(F.col("kind").isin("add", "remove")).groupBy("session", F.col("arg").alias("source_id")).agg(F.max_by("kind", place).alias("kind"))
    return last.where("kind = 'add'").select("session", "source_id")


def visibility_changes(log: DataFrame) -> DataFrame:
    """session, event_id: adds and removes that change the set of sources (adding one that is there changes nothing)."""
    per_source = Window.partitionBy("session", "arg").orderBy("ts", "event_id")
    acts = log.where(F.col("kind").isin("add", "remove"))
    before = F.lag("kind", 1, "remove").over(per_source)
    return acts.withColumn("before", before).where("kind <> before").select("session", "event_id")


def rejected(log: DataFrame, num_timepoints: int) -> DataFrame:
    """session, event_id, reason: actions that a viewer refuses, which the folds pass over or clamp.

    Timepoints that there are none of, sources and groups that aren't listed
    when they are made current or switched, and actions without a number.
    """
    if num_timepoints < 1:
        raise ValueError("there must be at least one timepoint")
    before = Window.partitionBy("session", "arg").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    was = lambda *kinds: F.coalesce(F.last(F.when(F.col("kind").isin(*kinds), F.col("kind")), True).over(before), F.lit(kinds[1])) == kinds[0]
    kind, number = F.col("kind"), F.col("arg")
    needs = kind.isin("timepoint", "source", "group", "add", "remove", "activate", "deactivate", "add_group", "remove_group", "select", "toggle", "bookmark", "recall")
    reason = (
        F.when(kind.isNull() | needs & number.isNull(), "no number")
        .when((kind == "timepoint") & ((number < 0) | (number >= num_timepoints)), "no such timepoint")
        .when(kind.isin("source", "activate", "deactivate") & ~was("add", "remove"), "no such source")
        .when((kind == "group") & ~was("add_group", "remove_group"), "no such group")
    )
    return log.withColumn("reason", reason).where("reason is not null").select("session", "event_id", "reason")


def checked(log: DataFrame, num_timepoints: int) -> DataFrame:
    """log, which is an error if it has an action that rejected() gives."""
    bad = rejected(log, num_timepoints).select(F.col("session").alias("s"), F.col("event_id").alias("e"), "reason")
    both = log.join(bad, F.col("session").eqNullSafe(F.col("s")) & (F.col("event_id") == F.col("e")), "left")
    wrong = F.raise_error(F.format_string("action %s of session %s: %s", F.col("event_id").cast("string"), F.col("session").cast("string"), "reason")).cast("string")
    return both.withColumn("kind", F.when(F.col("reason").isNotNull(), wrong).otherwise(F.col("kind"))).select(log.columns)


#: Fixed value: how long the way to a bookmark takes.
RECALL_MS = 300


def _apply(state: dict, kind: str, arg: int, num_timepoints: int, event_id: int = 0) -> list[tuple[str, str]]:
    """Put one action into a state; the changes it makes, in order, with their new values."""
    out: list[tuple[str, str]] = []

    def put(name: str, change: str, value) -> None:
        if state[name] != value:
            state[name] = value
            out.append((change, json.dumps(value)))

    def listed(names: str, name: str, current: str, change: str, now: str, there: bool) -> None:
        """Put arg into a list or take it out; the first to come becomes current, and the first left where the current one goes."""
        if (arg in state[names]) == there:
            return
        put(names, change, [*state[names], arg] if there else [s for s in state[names] if s != arg])
        if there and state[name] is None or not there and state[name] == arg:
            put(name, now, state[names][0] if state[names] else None)
        if not there and arg in state[current]:
            put(current, "VISIBILITY_CHANGED", [s for s in state[current] if s != arg])

    def switched(active: str, which: int, on: bool) -> None:
        rest = [s for s in state[active] if s != which]
        put(active, "VISIBILITY_CHANGED", sorted([*rest, which]) if on else rest)

    last = num_timepoints - 1
    mode = "DISPLAY_MODE_CHANGED"
    by_group = state["mode"].endswith("GROUP")
    names, current, active = ("groups", "group", "active_groups") if by_group else ("sources", "source", "active")
    if kind in ("timepoint", "next", "previous"):
        to = arg if kind == "timepoint" else state["timepoint"] + (1 if kind == "next" else -1)
        put("timepoint", "CURRENT_TIMEPOINT_CHANGED", min(max(to, 0), last))
    elif kind == "source" and arg in state["sources"]:
        put("source", "CURRENT_SOURCE_CHANGED", arg)
    elif kind == "group" and arg in state["groups"]:
        put("group", "CURRENT_GROUP_CHANGED", arg)
    elif kind == "select" and 0 <= arg < len(state[names]):
        put(current, f"CURRENT_{current.upper()}_CHANGED", state[names][arg])
    elif kind == "toggle" and 0 <= arg < len(state[names]):
        which = state[names][arg]
        switched(active, which, which not in state[active])
    elif kind == "mode":
        put("mode", mode, MODES[(MODES.index(state["mode"]) + 1) % len(MODES)])
    elif kind in ("fused", "grouping"):
        put("mode", mode, toggle_mode(state["mode"], kind))
    elif kind == "interpolation":
        put("interpolation", "INTERPOLATION_CHANGED", "LINEAR" if state["interpolation"] == "NEAREST" else "NEAREST")
    elif kind in ("add", "remove"):
        listed("sources", "source", "active", "NUM_SOURCES_CHANGED", "CURRENT_SOURCE_CHANGED", kind == "add")
    elif kind in ("add_group", "remove_group"):
        listed("groups", "group", "active_groups", "NUM_GROUPS_CHANGED", "CURRENT_GROUP_CHANGED", kind == "add_group")
    elif kind in ("activate", "deactivate") and arg in state["sources"]:
        switched("active", arg, kind == "activate")
    elif kind == "bookmark":
        state["bookmarks"] = state["bookmarks"] | {arg: event_id}
    elif kind == "recall" and arg in state["bookmarks"]:
        out.append(("BOOKMARK_RECALLED", json.dumps(state["bookmarks"][arg])))
    return out


_LISTS = ("sources", "active", "groups", "active_groups")


def _first_state() -> dict:
    return {"timepoint": 0, "source": None, "mode": MODES[0], "interpolation": "NEAREST", "group": None, **{k: [] for k in _LISTS}, "bookmarks": {}}


#: A session's state as a row; also what change_stream() takes to start from.
STATE = "session long, timepoint long, source long, mode string, interpolation string, group long, sources array<long>, active array<long>, groups array<long>, active_groups array<long>, bookmarks map<long, long>"


def fold(log: DataFrame, num_timepoints: int) -> DataFrame:
    """STATE and changes (how many) at the end of each session's log, by the rules of the stream.

    A group is one session's actions.
    """

    def run(actions: pd.DataFrame) -> pd.DataFrame:
        state, changes = _first_state(), 0
        actions = actions.sort_values(["ts", "event_id"], kind="stable")
        for event_id, kind, arg in zip(actions["event_id"], actions["kind"], actions["arg"]):
            changes += len(_apply(state, kind, arg, num_timepoints, event_id))
        return pd.DataFrame([{"session": actions["session"].iloc[0], **state, "changes": changes}]).astype({"source": "Int64", "group": "Int64"})

    return log.select("session", "ts", "event_id", "kind", "arg").groupBy("session").applyInPandas(run, STATE + ", changes long")


class _Session(StatefulProcessor):
    """One session's state in typed parts: a value, lists, a map of bookmarks; a timer for each bookmark on its way."""

    def __init__(self, num_timepoints: int, timers: bool):
        self.num_timepoints, self.timers = num_timepoints, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "timepoint long, source long, mode string, interpolation string, group long")
        self.lists = {k: handle.getListState(k, "id long") for k in _LISTS}
        self.bookmarks = handle.getMapState("bookmarks", "key long", "event_id long")
        self.ways = handle.getMapState("ways", "due long", "event_id long")

    def _read(self) -> dict:
        state = _first_state()
        if self.now.exists():
            state |= dict(zip(("timepoint", "source", "mode", "interpolation", "group"), self.now.get()))
        state |= {k: [int(x[0]) for x in v.get()] if v.exists() else [] for k, v in self.lists.items()}
        return state | {"bookmarks": {int(k[0]): int(v[0]) for k, v in self.bookmarks.iterator()}}

    def _write(self, state: dict) -> None:
        self.now.update(tuple(state[k] for k in ("timepoint", "source", "mode", "interpolation", "group")))
        for k, v in self.lists.items():
            v.put([(x,) for x in state[k]]) if state[k] else v.clear()
        for key, event_id in state["bookmarks"].items():
            self.bookmarks.updateValue((key,), (event_id,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.iloc[0]
        none = lambda v: None if pd.isna(v) else int(v)
        lists = {k: [] if row[k] is None else [int(x) for x in row[k]] for k in _LISTS}
        marks = row["bookmarks"] or {}
        self._write({"timepoint": int(row["timepoint"]), "source": none(row["source"]), "mode": row["mode"], "interpolation": row["interpolation"], "group": none(row["group"]), **lists, "bookmarks": {int(k): int(v) for k, v in dict(marks).items()}})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, out = self._read(), []
        actions = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")  # one trigger's actions of a session
        for event_id, kind, arg in zip(actions["event_id"], actions["kind"], actions["arg"]):
            found = _apply(state, kind, int(arg), self.num_timepoints, int(event_id))
            out += [(key[0], int(event_id), change, value) for change, value in found]
            if found and kind == "recall" and self.timers:
                due = timerValues.getCurrentProcessingTimeInMs() + RECALL_MS
                self.ways.updateValue((due,), (state["bookmarks"][int(arg)],))
                self.handle.registerTimer(due)
        self._write(state)
        yield pd.DataFrame(out, columns=["session", "event_id", "change", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        event_id = int(self.ways.getValue((due,))[0])
        self.ways.removeKey((due,))
        yield pd.DataFrame([(key[0], event_id, "BOOKMARK_REACHED", json.dumps(event_id))], columns=["session", "event_id", "change", "value"])

    def close(self) -> None:
        pass


def change_stream(log: DataFrame, num_timepoints: int, first: DataFrame | None = None, timers: bool = False) -> DataFrame:
    """A stream of actions to one of changes: session, event_id, change, value (JSON).

    Removing the current source makes the first one left current, adding to
    an empty list the new one; other sources can be made current only while
    they are listed. Actions of a micro-batch are taken in order of ts and
    event_id; state lives as long as the stream, in typed parts, of which a
    session's trigger reads and writes its own. first: sessions' states
    (STATE) to start from, such as fold() gives. With timers, a recalled
    bookmark is reached in the first trigger after its way; such a stream has
    batches without actions too, so it doesn't end by itself when it has read
    what is available.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = None if first is None else first.select(*[c.strip().split()[0] for c in re.sub(r"map<[^>]*>", "map", STATE).split(",")]).groupBy("session")
    rows = log.select("session", "ts", "event_id", "kind", "arg").groupBy("session")
    return rows.transformWithStateInPandas(_Session(num_timepoints, timers), "session long, event_id long, change string, value string", "append", "processingTime" if timers else "none", start)


def best_so_far(samples: DataFrame) -> DataFrame:
    """A stream of rendered samples (px, py, level, v) to the finest valid value of each pixel; run it in update mode."""
    return samples.where("v is not null").groupBy("px", "py").agg(F.min_by("v", "level").alias("v"), F.min("level").alias("level"))
