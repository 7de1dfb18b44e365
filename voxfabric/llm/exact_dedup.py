"""Exact deduplication by a 128-bit content hash, with a comparison of bytes inside groups.

DataFrame functions only. Two scans of the text column; what is shuffled is
the hashes and the id of every row, and the texts whose key a bitmap of the
repeated keys has, copies once per map task. The bitmap's size is bounded
(common.marked), so beyond some 100 million repeated keys single texts move
too, once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import SPACE, cut, hot_lookup, marked, once, text_column, without


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white
    space has become one space; null counts as empty, so nulls and empty texts
    form one group. The smallest id stays; of rows that repeat id and text, one
    is kept. Null ids count as larger than any other. Texts of any length are
    compared whole. An empty table gives an empty result; further columns of
    docs are ignored, whatever their names.
    """
    norm = F.regexp_replace(text_column(text), SPACE, " ")
    base = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    hashed = cut(base.select("doc_id", F.md5("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    hashed = hashed.withColumn("place", F.monotonically_increasing_id())

    # Keys of two or more rows; the partial aggregation leaves one row per key and map task.
    groups = hashed.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups)
    rows = hashed.count()

    # Compare bytes: grouping the texts of such keys by the text itself does it, copies collapsing before the shuffle.
    keyed = base.withColumn("key", F.md5("norm"))
    repeated = marked(keyed, F.xxhash64("key"), groups.select(F.xxhash64("key").alias("key")), "repeated").where("repeated")
    classes = repeated.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    classes = classes.drop("norm").groupBy("key").agg(F.count("*").alias("texts"))
    collided = cut(classes.where("texts > 1").select("key"))

    found = hot_lookup(hashed, groups, "key", "n", rows, "g_", hint="merge")
    # Rows that repeat id and text: all but the first in place go.
    again = marked(hashed, F.xxhash64("key"), groups.select(F.xxhash64("key").alias("key")), "repeated").where("repeated")
    pair = lambda df: df.withColumn("pair", F.concat_ws("-", F.hex("sha"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null "))))
    twins = cut(pair(again).groupBy("pair").agg(F.count("*").alias("rows"), F.min("place").alias("first")).where("rows > 1"))
    later = F.lit(False)
    if not twins.isEmpty():
        found = hot_lookup(pair(found), twins, "pair", "rows", rows, "t_", spread="place")
        later = F.coalesce(F.col("place") > F.col("t_first"), F.lit(False))
    by_key = _result(found, "g_keep_id", "g_n", later)
    if collided.isEmpty():
        return by_key
    # Different texts under one 128-bit hash: the text itself is the key of these few groups.
    clean = _result(found.join(collided, "key", "left_anti"), "g_keep_id", "g_n", later)
    mixed = found.join(collided, "key", "left_semi").drop("g_keep_id", "g_n")
    texts = keyed.join(collided, "key", "left_semi").groupBy("norm").agg(F.min("doc_id").alias("g_keep_id"), F.count("*").alias("g_n"))
    texts = texts.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "g_keep_id", "g_n")
    return clean.unionByName(_result(mixed.join(texts, "sha"), "g_keep_id", "g_n", later))


def _result(df: DataFrame, keep_id: str, n: str, later: Column) -> DataFrame:
    stays = F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(F.col(keep_id))
    return df.select(
        "doc_id",
        stays.alias("keep_id"),
        F.coalesce(F.col(n), F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(stays) & ~later).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without exact copies, columns unchanged, whatever their names.

    A row goes if its own text, not another row's of the same id, equals that
    of a row with a smaller id; a null id counts as larger than any other. Of
    rows that repeat both id and text the first by content stays. Null and
    empty texts are equal; texts of any length are compared whole. An empty
    table gives an empty result.
    """
    goes = exact_groups(docs, doc_id, text).where("not kept").groupBy("doc_id", "text_sha256").agg(F.any_value(F.expr("doc_id <=> keep_id")).alias("twin"))
    goes = cut(goes)
    own = {"doc_id": F.col(f"`{doc_id}`"), "text_sha256": F.sha2(F.regexp_replace(text_column(text), SPACE, " "), 256)}
    stay = without(docs, own, goes.where("not twin"))
    twins = goes.where("twin")
    return stay if twins.isEmpty() else once(stay, own, twins)
