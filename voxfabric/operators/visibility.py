"""Which sources are seen: display modes over active sources and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("SINGLE", "GROUP", "FUSED", "FUSEDGROUP")


def visible(sources: DataFrame, members: DataFrame, groups: DataFrame, mode: str, current_source: int | None = None, current_group: int | None = None) -> DataFrame:
    """The sources (source_id, active) that a display mode shows.

    SINGLE: the current one. GROUP: members (group_id, source_id) of the
    current group. FUSED: active ones. FUSEDGROUP: members of any active
    group (group_id, active). Without a current source or group, none.
    """
    if mode == "SINGLE":
        return sources.where(F.col("source_id") == F.lit(current_source))
    if mode == "GROUP":
        return sources.join(members.where(F.col("group_id") == F.lit(current_group)), "source_id", "left_semi")
    if mode == "FUSED":
        return sources.where("active")
    if mode == "FUSEDGROUP":
        return sources.join(members.join(groups.where("active"), "group_id", "left_semi"), "source_id", "left_semi")
    raise ValueError(f"display mode {mode} is none of {', '.join(MODES)}")


def visible_and_present(shown: DataFrame, views: DataFrame, t: int) -> DataFrame:
    """Of the sources shown, those whose view at timepoint t is present."""
    here = views.where((F.col("timepoint_id") == t) & F.col("present")).select(F.col("setup_id").alias("source_id"))
    return shown.join(here, "source_id", "left_semi")


def toggle_mode(mode: str, what: str) -> str:
    """The mode after `fused` or `grouping` has been switched."""
    fused, grouping = mode.startswith("FUSED"), mode.endswith("GROUP")
    fused, grouping = fused ^ (what == "fused"), grouping ^ (what == "grouping")
    return ("FUSED" if fused else "") + ("GROUP" if grouping else "") or "SINGLE"


def virtual_channels(channels: DataFrame) -> DataFrame:
    """Channels (image_id, source_id, ord, visible) that share an image: only the first visible one is present and draws it."""
    first = channels.where("visible").groupBy("image_id").agg(F.min_by("source_id", "ord").alias("drawing"))
    return channels.join(first, "image_id", "left").withColumn("present", F.coalesce(F.col("source_id") == F.col("drawing"), F.lit(False))).drop("drawing")


def first_of_group(members: DataFrame, order: DataFrame) -> DataFrame:
    """group_id, source_id: each group's source that comes first in the list order (source_id, ord)."""
    return members.join(order, "source_id").groupBy("group_id").agg(F.min_by("source_id", "ord").alias("source_id"))


def group_tree(members: DataFrame, groups: DataFrame, order: DataFrame) -> DataFrame:
    """group_id, name, sources: the names' list of each group in list order; groups without sources have an empty one."""
    listed = members.join(order, "source_id").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id"))).alias("l"))
    return groups.join(listed, "group_id", "left").select("group_id", "name", F.coalesce(F.transform("l", lambda s: s["source_id"]), F.array().cast("array<bigint>")).alias("sources"))
