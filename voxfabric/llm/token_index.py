"""Token-id files with constant-time keyed access.

A shard is one record of a Parquet data set: raw ids, and a minimal perfect
hash index from document keys to offsets, with fingerprints that reject keys
of other shards. Spark writes and reads the shards, so they can lie in any
store that it reaches.

Columns of a shard: bucket, shard (its place in the bucket), local_start (ids
of the bucket before it), first_id, last_id, n_keys, n_ids, width (bytes an
id), doc_ids (int64 of each record, in order; the number of leading null ids
in n_null), displacement (int32), slots (per slot: uint32 fingerprint, uint32
first record, uint32 records), offsets (uint64, one more than records),
payload. All little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import as_long, cut, stored
from voxfabric.llm.tokens import default_tokenizer, encoder

SHARD = "bucket int, shard int, local_start long, first_id long, last_id long, n_keys int, n_ids long, n_null int, width int, doc_ids binary, displacement binary, slots binary, offsets binary, payload binary"
_SLOT = np.dtype([("print", "<u4"), ("record", "<u4"), ("records", "<u4")])
_NULL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit finalizer of each value, another for each seed."""
    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(seed, np.uint64) * _NULL)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _group(keys: np.ndarray, n: int) -> np.ndarray:
    return (_mix(keys, 1) % np.uint64(n // 4 + 1)).astype(np.int64)


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 2) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct uint64 keys: hash, displace, largest groups first.

    A displacement d of 0 or more rehashes a group's keys; -1-s sends a group
    of one key straight to slot s.
    """
    n = len(keys)
    members: dict[int, list[int]] = {}
    for i, g in enumerate(_group(keys, n).tolist()):
        members.setdefault(g, []).append(i)
    out, taken = np.zeros(n // 4 + 1, np.int32), np.zeros(n, bool)
    order = sorted(members, key=lambda g: -len(members[g]))
    for at, g in enumerate(order):
        own = keys[members[g]]
        if len(own) == 1:
            free = iter(np.flatnonzero(~taken).tolist())
            for rest in order[at:]:
                out[rest] = -1 - next(free)
            break
        d = 0
        while True:  # 128 displacements at a time
            tried = _mix(own[:, None], np.arange(d, d + 128)[None, :] + 3) % np.uint64(n)
            good = ~taken[tried].any(0)
            inner = np.sort(tried, 0)
            good &= (inner[1:] != inner[:-1]).all(0)
            if good.any():
                d += int(np.argmax(good))
                slots = tried[:, np.argmax(good)]
                break
            d += 128
        taken[slots] = True
        out[g] = d
    return out


def locate(keys: np.ndarray, n: int, displacement: np.ndarray) -> np.ndarray:
    """The slot of each key."""
    d = displacement[_group(keys, n)].astype(np.int64)
    return np.where(d < 0, -1 - d, (_mix(keys, np.maximum(d, 0) + 3) % np.uint64(n)).astype(np.int64))


def _as_keys(ids: list[int | None]) -> np.ndarray:
    return np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64) ^ np.where([x is None for x in ids], _NULL, np.uint64(0))


def _shard(bucket: int, number: int, start: int, rows: list[tuple[int | None, bytes]], width: int) -> dict:
    ids = [r[0] for r in rows]
    keys, first, times = np.unique(_as_keys(ids), return_index=True, return_counts=True)
    displacement = build(keys)
    slots = np.zeros(len(keys), _SLOT)
    at = locate(keys, len(keys), displacement)
    slots["print"][at], slots["record"][at], slots["records"][at] = _print(keys), first, times
    offsets = np.concatenate([[0], np.cumsum([len(r[1]) // width for r in rows])]).astype("<u8")
    known = [x for x in ids if x is not None]
    return {
        "bucket": bucket, "shard": number, "local_start": start, "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
        "n_keys": len(keys), "n_ids": int(offsets[-1]), "n_null": len(ids) - len(known), "width": width, "doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes(),
        "displacement": displacement.astype("<i4").tobytes(), "slots": slots.tobytes(), "offsets": offsets.tobytes(), "payload": b"".join(r[1] for r in rows),
    }


class Shard:
    """A shard's record, opened for lookups."""

    def __init__(self, row: dict):
        self.n, self.dtype = row["n_keys"], np.dtype(f"<u{row['width']}")
        self.displacement = np.frombuffer(row["displacement"], "<i4")
        self.slots = np.frombuffer(row["slots"], _SLOT)
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self.payload = row["payload"]
        self.doc_ids = [None if i < row["n_null"] else x for i, x in enumerate(np.frombuffer(row["doc_ids"], "<i8").tolist())]

    def find(self, ids: list[int | None]) -> list[tuple[int, int]]:
        """First record and number of records of each id; (0, 0) where the fingerprint differs."""
        keys = _as_keys(ids)
        slot = self.slots[locate(keys, self.n, self.displacement)]
        there = slot["print"] == _print(keys)
        return list(zip(slot["record"].tolist(), np.where(there, slot["records"], 0).tolist()))

    def ids(self, record: int) -> np.ndarray:
        return np.frombuffer(self.payload, self.dtype, self.offsets[record + 1] - self.offsets[record], self.offsets[record] * self.dtype.itemsize)


def write(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, shard_ids: int = 1 << 21, shard_keys: int = 1 << 16, bucket_bytes: int = 1 << 25, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode docs and write shards in ascending doc_id order (nulls first); returns the table as read back.

    A shard takes at most shard_ids ids (or one document) and shard_keys
    documents. Documents are dealt by ranges of their id and, within an id, of
    a hash of the text, to parts of about bucket_bytes of text, so that an id
    of any number of rows, nulls too, is spread over parts and shards; within
    a part shards follow each other. Ids are compared as longs, and those that
    are none count as null. Rows that
    repeat an id follow each other in the order of that hash. Null and empty
    texts are the end id alone; a text of any length is one record. An empty
    table gives an empty index; further columns of docs are ignored, whatever
    their names.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(as_long(docs, doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    dtype = encoder(path).dtype
    dealt = rows.withColumn("salt", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = dealt.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "salt")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = number = start = 0
        enc, bucket = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(bucket, number, start, held, dtype.itemsize)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = enc.encode([t or "" for t in part.column(1).to_pylist()])
                for key, ids in zip(part.column(0).to_pylist(), codes):
                    k = len(ids) // dtype.itemsize + 1
                    if held and (size + k > shard_ids or len(held) >= shard_keys):
                        yield out()
                        number, start, held, size = number + 1, start + size, [], 0
                    held.append((key, ids + end))
                    size += k
        if held:
            yield out()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SHARD.split(", "))])
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "salt", "text")
    return stored(ordered.select("doc_id", "text").mapInArrow(shards, SHARD), "zstd")


def read_all(index: DataFrame) -> DataFrame:
    """Every document of an index, each found by its key: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    sums = index.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect()  # a row per part of bucket_bytes of text
    base, total = [], 0
    for r in sums:
        base.append((r.bucket, total))
        total += r.n
    bases = index.sparkSession.createDataFrame(base, "bucket int, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, start = Shard(row), row["base"] + row["local_start"]
                found = [at + k for (at, times), key, before in zip(shard.find(shard.doc_ids), shard.doc_ids, [object(), *shard.doc_ids]) if key != before for k in range(times)]
                for at in range(0, len(found), 512):
                    some = found[at : at + 512]
                    ids = [shard.ids(r).astype("<u4") for r in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.doc_ids[r] for r in some], pa.int64()), pa.array(start + shard.offsets[some]), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return index.join(F.broadcast(bases), "bucket").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


#: Runs of parts in a lookup's directory, 16 bytes each.
DIRECTORY = 10_000
#: Parts to which a lookup's reads are narrowed by their numbers; keys in more of them read all parts' directories.
FEW_PARTS = 1000


def lookup(index: DataFrame, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The ids of given documents: doc_id, ids. Keys that the index lacks give no row.

    A null key (or one that is no long) asks for the documents with null ids;
    a key that is asked for twice is answered once, one that several documents
    have by all of them. An empty index or table of keys gives an empty
    result.

    Parts are taken together in at most DIRECTORY runs, whose first and last
    ids go to the tasks and lead a key to its run, nearly always one; in the
    run, shards are told by their ids' range, and in a shard a key costs one
    probe. Where the keys lie in few parts, only those are read: their numbers
    are pushed down to the scan.
    """
    low = -(1 << 63)
    ranged = index.select("bucket", "shard", F.when(F.col("n_null") > 0, low).otherwise(F.col("first_id")).alias("low"), F.coalesce("last_id", F.lit(low)).alias("high"))
    together = (ranged.agg(F.max("bucket")).first()[0] or 0) // DIRECTORY + 1
    ranged = ranged.withColumn("run", F.floor(F.col("bucket") / together).cast("int"))
    runs = ranged.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("run").collect()
    lows, highs = (np.array([r[c] for r in runs], np.int64) for c in ("low", "high"))
    numbers_ = np.array([r.run for r in runs], np.int32)
    wanted = keys.select(F.coalesce(as_long(keys, doc_id), F.lit(low)).alias("key"), as_long(keys, doc_id).alias("asked")).distinct()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            first, last = np.searchsorted(highs, key, "left"), np.searchsorted(lows, key, "right")
            n = np.maximum(last - first, 0)
            row = np.repeat(np.arange(len(key)), n)
            run = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns], pa.array(numbers_[run])], names=["key", "asked", "run"])

    led = wanted.mapInArrow(lead, "key long, asked long, run int")
    inside = (F.col("low") <= F.col("key")) & (F.col("key") <= F.col("high"))
    asked = cut(led.join(ranged, "run").where(inside).groupBy("bucket", "shard").agg(F.collect_list("asked").alias("asked"), F.max(F.col("asked").isNull()).alias("null_too")))
    numbers = [r.bucket for r in asked.select("bucket").distinct().limit(FEW_PARTS + 1).collect()]
    some = index.where(F.col("bucket").isin(numbers)) if len(numbers) <= FEW_PARTS else index

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, want = Shard(row), row["asked"] + [None] * row["null_too"]
                got = [(key, shard.ids(at + k).astype("<u4").tobytes()) for key, (at, times) in zip(want, shard.find(want)) for k in range(times) if shard.doc_ids[at] == key]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], names=["doc_id", "ids"])

    return some.join(asked, ["bucket", "shard"]).mapInArrow(probe, "doc_id long, ids binary")
