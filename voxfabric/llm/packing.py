"""Packing: concatenate and cut.

Pass one encodes every document where it lies and stores ids with the running
token count of its partition. Prefix sums over the partitions' totals then
give each document its global offset, and pass two cuts the stream at fixed
windows, so neither texts nor ids are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import give_back, stored
from voxfabric.llm.tokens import default_tokenizer, encoder


def encoded(docs: DataFrame, end_id: int, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (bytes), doc_tokens, and the row's place: part, local_start. Stored, so that a place is fixed once."""
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end, part, start = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                ids = [x + end for x in enc.encode([t or "" for t in texts.slice(at, 256).to_pylist()])]
                n = np.array([len(x) // enc.width for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "local_start", "doc_tokens", "ids"],
                )
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(encode, f"doc_id {kind}, part int, local_start long, doc_tokens long, ids binary"))


def pack(docs: DataFrame, length: int = 1024, end_id: int = 0, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, a part of one document in one sequence.

    doc_id, start (the document's ids before the piece), length, doc_tokens
    (with the end id), sequence_id, offset (in the sequence), padding (pad ids
    at the end of its sequence: 0 but in the last one), ids (little-endian
    unsigned 32-bit).

    Documents follow each other in the order of the input's partitions; each
    is followed by end_id, and every length ids make a sequence. Null and
    empty texts give a piece of the end id alone. Rows that repeat an id or a
    text are packed like any other. An empty table gives no pieces.
    A text of any length is encoded whole and cut wherever a sequence ends;
    further columns of docs are ignored, whatever their names.
    """
    table = encoded(docs, end_id, tokenizer, doc_id, text)
    # One total per partition of the input: small whatever the partitions hold.
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    base, total = [], 0
    for r in totals:
        base.append((r.part, total))
        total += r.n
    bases = docs.sparkSession.createDataFrame(base, "part int, base long")
    pad = -total % length
    width = encoder(tokenizer or default_tokenizer()).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                first, n = (rows.column(i).to_numpy() for i in (1, 2))
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] // length + k
                begin = np.maximum(first[row], sequence * length)
                stop = np.minimum(first[row] + n[row], (sequence + 1) * length)
                ids = [np.frombuffer(x, width).astype("<u4") for x in rows.column(3).to_pylist()]
                cuts = zip(row.tolist(), (begin - first[row]).tolist(), (stop - first[row]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(row)), pa.array(begin - first[row]), pa.array(stop - begin), pa.array(n[row]), pa.array(sequence),
                        pa.array(begin - sequence * length), pa.array(np.where(sequence == (total - 1) // length, pad, 0)), pa.array([ids[r][a:b].tobytes() for r, a, b in cuts], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padding", "ids"],
                )

    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "doc_tokens", "ids")
    kind = table.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, padding long, ids binary")


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to length, from the pieces of pack()."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # A sequence holds at most length pieces.
    joined = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.max("padding").alias("padding"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    one = F.lit(pad_id.to_bytes(4, "little"))
    pads = F.aggregate(F.array_repeat(one, F.col("padding").cast("int")), F.lit(b""), lambda a, x: F.concat(a, x))
    return joined.select("sequence_id", F.concat(whole, pads).alias("ids"))
