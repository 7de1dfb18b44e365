"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and words, as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all tasks run in this process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed in the shared folder. Spark removes the files with the last plan that reads them if spark.cleaner.referenceTracking.cleanCheckpoints is set, as it should be on a cluster."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a compressed table in the shared folder, for what is as large as the input; it goes by drop_stored(), or when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    atexit.register(drop_stored, out)
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the table that stored() returned as df; plans that read it fail from then on."""
    sc = df.sparkSession.sparkContext
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the JVM may have gone first
        pass


def text_column(name: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Returns memory that this process has freed but holds to the machine: workers wait for their next task with what they once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches cut small: a text's words take many times its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
        del batch
    give_back()


def as_long(docs: DataFrame, doc_id: str) -> Column:
    """An id column as a long; null where an id is none."""
    whole_numbers = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    at = F.col("`" + doc_id.replace("`", "``") + "`")
    return at.cast("long") if whole_numbers else at.cast("string").try_cast("long")


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


#: Bits of the largest map that marked() sends to the tasks: 64 MB.
MOST_BITS = 1 << 29


def marked(df: DataFrame, column: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with boolean column name: false only where the long in column is surely none of those in keys' only column.

    What goes to the tasks is a bitmap of 16 bits a key, in pieces of 4 KB;
    it never exceeds MOST_BITS, beyond which more rows are true than need be.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    at = lambda c: F.pmod(c, F.lit(bits)) + 1  # noqa: E731  the functions count positions from 1
    key = at(F.col(keys.columns[0]))
    pieces = keys.groupBy(F.bitmap_bucket_number(key).alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("__bits"))
    found = df.withColumn("__at", at(column)).join(F.broadcast(pieces), F.bitmap_bucket_number("__at") == F.col("__piece"), "left")
    byte = F.substring("__bits", F.floor(F.bitmap_bit_position("__at") / 8).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (F.bitmap_bit_position("__at") % 8).cast("int")).bitwiseAND(F.lit(1))
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__at", "__piece", "__bits")


def whole(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, whatever their names: operators that add columns of their own carry rows in it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias(name)


def _matched(docs: DataFrame, same: dict[str, Column], keys: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """row, s_..., maybe of docs; keys with names g_...; the conditions of equality. maybe is false only where no key is equal."""
    names = list(same)
    keys = keys.select([F.col(c).alias(f"g_{c}") for c in names])
    rows = docs.select(whole(docs), *[e.alias(f"s_{c}") for c, e in same.items()])
    rows = marked(rows, F.xxhash64(*[F.col(f"s_{c}") for c in names]), keys.select(F.xxhash64(*keys.columns).alias("key")), "maybe")
    return rows, keys, [F.col(f"s_{c}").eqNullSafe(F.col(f"g_{c}")) for c in names]


def without(docs: DataFrame, same: dict[str, Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose values of same (name -> expression over docs) stand in a row of gone (columns of those names; nulls are equal).

    Most rows are none of gone's by a bitmap and stay where they lie; only the
    others are shuffled to be compared. Columns of docs may have any names.
    """
    rows, gone, equal = _matched(docs, same, gone)
    stay = rows.where("not maybe").select("row")
    return stay.unionByName(rows.where("maybe").join(gone.hint("merge"), equal, "left_anti").select("row")).select("row.*")


def once(docs: DataFrame, same: dict[str, Column], repeated: DataFrame) -> DataFrame:
    """docs with one row of those whose values of same stand in one row of repeated: the first by its content. Others stay; names as in without()."""
    rows, repeated, equal = _matched(docs, same, repeated)
    stay = rows.where("not maybe").select("row")
    other = rows.where("maybe")
    stay = stay.unionByName(other.join(repeated.hint("merge"), equal, "left_anti").select("row"))
    # Rows are told apart by content in each task first, so that a frequent one is no hot key.
    groups = other.join(repeated.hint("merge"), equal, "left_semi").groupBy(*[f"s_{c}" for c in same])
    return stay.unionByName(groups.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")).select("row.*")


def hot_lookup(left: DataFrame, table: DataFrame, key: str, weight: str, rows: int, prefix: str, spread: str = "doc_id", hint: str | None = None) -> DataFrame:
    """Left join with table (unique in key, a string) where some keys may hold a large part of left's rows.

    Keys with weight above rows/1000 are fewer than 1000, so they are looked
    up by broadcast. All others go through a shuffled join, in which the rows
    already found carry a key made of the column spread, so that they lie
    evenly and match nothing; hint names that join's strategy. Columns of table
    other than key come out with prefix.
    """
    others = [c for c in table.columns if c != key]
    bound = max(rows // 1000, 1)
    hot = table.where(F.col(weight) > bound).select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in others])
    cold = table.where(F.col(weight) <= bound).select(F.col(key).alias("__ck"), *[F.col(c).alias(f"__c_{c}") for c in others])
    found = left.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    own = F.concat(F.lit("#"), F.coalesce(F.col(spread).cast("string"), F.lit("")))
    found = found.withColumn("__k", F.when(F.col("__hk").isNotNull(), own).otherwise(F.col(key)))
    found = found.join(cold.hint(hint) if hint else cold, F.col("__k") == F.col("__ck"), "left")
    return found.select(*left.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(prefix + c) for c in others])
