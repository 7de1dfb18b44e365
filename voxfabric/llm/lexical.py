"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into segments as they are read, each in a task of its own.
A segment has, for each of its terms, the bitmaps of its documents' impacts:
bit b of a term's slices says for which documents bit b of the impact is set.
Only 64-document words that hold a document of the term are kept, and where
those hold few documents each, their ordinals and impacts stand for the
bitmaps and are spread out when a search reads them. Texts and postings are
never shuffled to build the index.

A search adds the slices of an item's terms by carry arithmetic, 64 documents
at a time, and finds the best documents from the most significant slice down.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.llm.common import cut, hot_lookup, stored, text_column

#: Terms are the maximal runs of these characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most documents, and most places of terms in documents, of one segment (the latter but for its last document).
SEGMENT_DOCS, SEGMENT_PLACES = 32_768, 4_000_000
#: Items whose sums are held by one task at a time.
ITEM_BLOCK = 64
#: A term's impact within a document, before its weight, is below SCALE / 1000.
SCALE = 1_000_000_000
IMPACT_BITS = (SCALE // 1000).bit_length()
#: Words of this many documents of a term, on average, are kept as bitmaps.
DENSE = 8
#: Most pairs of an item and a term that are sent to all tasks (about 100 bytes a pair).
BROADCAST_PAIRS = 200_000

_U64 = np.uint64
_POWERS = _U64(1) << np.arange(64, dtype=_U64)
#: Lower case for A-Z, blanks for what is in no term; bytes from 0x80 on belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z in lower case, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Index:
    """rows: a stored table of (segment, term, ordinals, slices, df), one row a term and segment, and (segment, doc_ids) with null term, one row a segment."""

    rows: DataFrame
    documents: int
    terms: int


# Slices: arrays of shape (bits, words), slices[b] the bitmap of bit b.


def to_slices(ordinals: np.ndarray, impacts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that ascending ordinals lie in, and the slices of impacts over those words."""
    word = ordinals >> 6
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    place = _POWERS[ordinals & 63]
    set_ = (impacts.astype(_U64)[None, :] >> np.arange(bits, dtype=_U64)[:, None]) & _U64(1)
    return word[starts], np.bitwise_or.reduceat(set_ * place, starts, axis=1)


def add(total: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """total += slices << shift, in place: a ripple-carry addition in each column of bits."""
    carry = np.zeros(total.shape[1], _U64)
    for b in range(shift, len(total)):
        if b - shift < len(slices):
            x, a = slices[b - shift], total[b]
            half = a ^ x
            total[b], carry = half ^ carry, (a & x) | (carry & half)
        elif carry.any():
            total[b], carry = total[b] ^ carry, total[b] & carry
        else:
            break


def times(slices: np.ndarray, factor: int) -> np.ndarray:
    """Slices of factor times the numbers: shifted copies, added by carry."""
    out = np.zeros((len(slices) + factor.bit_length(), slices.shape[1]), _U64)
    for b in range(factor.bit_length()):
        if factor >> b & 1:
            add(out, slices, b)
    return out


def _size(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def _places(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


def best(slices: np.ndarray, k: int) -> np.ndarray:
    """Ordinals of the k highest numbers above 0 (all, if fewer); of equal ones, the smallest ordinals."""
    sure = np.zeros(slices.shape[1], _U64)
    open_ = np.bitwise_or.reduce(slices, axis=0)
    if _size(open_) > k:
        for b in reversed(range(len(slices))):  # sure: above the k-th highest; open_: equal to it so far
            higher = open_ & slices[b]
            if _size(sure) + _size(higher) > k:
                open_ = higher
            else:
                sure |= higher
                open_ &= ~slices[b]
    ties = _places(open_)[: k - _size(sure)]
    return np.sort(np.concatenate([_places(sure), ties]))


def _numbers(slices: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    bits = (slices[:, ordinals >> 6] >> (ordinals & 63).astype(_U64)) & _U64(1)
    return (bits.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(0)


class _Segment:
    """Documents of one task on their way into the index."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[int] = []
        self.names: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.held: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.places = 0

    def put(self, text: str | None) -> None:
        found = Counter(terms_of(text))
        self.sizes.append(found.total())
        self.held.append(np.fromiter(map(self.names.__getitem__, found), np.int64, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int64, len(found)))
        self.places += len(found)

    def rows(self, segment: int, documents: int, terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.chunked_array(self.ids, schema.field("doc_ids").type.value_type).combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        one = pa.array([segment], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([one, *(pa.nulls(1, schema.field(i).type) for i in range(1, 5)), lists.cast(schema.field("doc_ids").type)], schema=schema)
        if not self.places:
            return
        term, tf = np.concatenate(self.held), np.concatenate(self.tf)
        n = np.array(self.sizes, np.int64)
        doc = np.repeat(np.arange(len(n)), [len(h) for h in self.held])
        m = 75 + (25 * n * documents) // max(terms, 1)
        impact = (SCALE * tf) // (1000 * tf + 12 * m[doc])
        by = np.lexsort((rank[doc], term))
        term, ordinal, impact = term[by], rank[doc][by], impact[by]
        df = np.bincount(term, minlength=len(self.names))
        first = np.concatenate([[0], np.cumsum(df)])
        names = list(self.names)
        words = np.add.reduceat(np.diff((term << 32) | (ordinal >> 6), prepend=-1) != 0, first[:-1])
        dense = df >= DENSE * words
        for a in range(0, len(names), 20_000):
            here = range(a, min(a + 20_000, len(names)))
            slices: list[bytes] = []
            for t in here:
                x, y = first[t], first[t + 1]
                slices.append(to_slices(ordinal[x:y], impact[x:y], IMPACT_BITS)[1].tobytes() if dense[t] else impact[x:y].astype("<u4").tobytes())
            placed = [ordinal[first[t] : first[t + 1]].astype("<u2").tobytes() for t in here]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(placed), segment)), pa.array([names[t] for t in here], pa.binary()).cast(pa.string()), pa.array(placed, pa.binary()), pa.array(slices, pa.binary()), pa.array(df[a : a + len(placed)]), pa.nulls(len(placed), schema.field("doc_ids").type)],
                schema=schema,
            )


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all terms of whole texts. Texts with no term, nulls and rows that repeat an id are documents like any other; further columns of docs are ignored, whatever their names."""
    counted = docs.select(F.regexp_count(text_column(text), F.lit(TERM)).cast("long").alias("n"))
    documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, segment, schema = TaskContext.get().partitionId(), 0, _Segment(), None
        for batch in batches:
            schema = schema or pa.schema([("segment", pa.int64()), ("term", pa.string()), ("ordinals", pa.binary()), ("slices", pa.binary()), ("df", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type))])
            at = 0
            for i in range(batch.num_rows):
                segment.put(batch.column(1)[i].as_py())
                if segment.places >= SEGMENT_PLACES or len(segment.sizes) >= SEGMENT_DOCS:
                    segment.ids.append(batch.column(0).slice(at, i + 1 - at))
                    yield from segment.rows((part << 32) + made, documents, terms, schema)
                    at, made, segment = i + 1, made + 1, _Segment()
            if at < batch.num_rows:
                segment.ids.append(batch.column(0).slice(at))
        if segment.sizes:
            yield from segment.rows((part << 32) + made, documents, terms, schema)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    built = rows.mapInArrow(build, f"segment long, term string, ordinals binary, slices binary, df long, doc_ids array<{kind}>")
    return Index(stored(built), documents, terms)


def weight(documents: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(found: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest-scoring documents of each item.

    Only documents with a score above 0 are returned, equal scores by
    ascending doc_id, null ids last; rows that repeat an id are documents of
    their own. Repeated terms of an item count as often. Rows that share an
    item_id are one item of all their terms; an item without known terms,
    with null or empty text too, has no rows. Without documents or items the
    result is empty. A text of any length is an item.
    """
    kind = items.schema[item_id].dataType.simpleString()
    id_kind = found.rows.schema["doc_ids"].dataType.elementType.simpleString()
    lower = F.translate(text_column(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    wanted = words.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    ids = wanted.select("item_id").distinct()
    blocks = max(1, math.ceil(ids.count() / ITEM_BLOCK))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    asked = cut(wanted.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("item_id", "times")).alias("items")))
    terms = cut(asked.groupBy("term").agg(F.sum(F.size("items")).alias("pairs")))
    few = (terms.agg(F.sum("pairs")).first()[0] or 0) <= BROADCAST_PAIRS

    lists = found.rows.where("term is not null")
    hits = cut(lists.join(F.broadcast(terms.select("term")) if few else terms.select("term"), "term", "left_semi").select("segment", "term", "ordinals", "slices", "df"))
    dfs = hits.groupBy("term").agg(F.sum("df").alias("all_df"))
    if few:
        weighed = asked.join(dfs, "term")
        rows = hits.drop("df").join(F.broadcast(weighed), "term")
    else:  # terms that many segments hold are looked up apart
        rows = hot_lookup(hits.withColumn("one", F.lit(1)), dfs.join(asked.groupBy("term").agg(F.collect_list(F.struct("block", "items")).alias("blocks")), "term"), "term", "all_df", found.documents, "t_", spread="segment")
        rows = rows.select("segment", "term", "ordinals", "slices", F.col("t_all_df").alias("all_df"), F.inline("t_blocks"))
    rows = rows.select("segment", "block", "ordinals", "slices", "all_df", "items", F.lit(None).cast(f"array<{id_kind}>").alias("doc_ids"))
    segments = found.rows.where("term is null").select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[2:6]], "doc_ids")
    documents = found.documents

    def rank(group: tuple, table: pa.Table) -> pa.Table:
        """The k best documents of one segment for each item of a block."""
        filled = table["doc_ids"].is_valid()
        doc_ids = table.filter(filled)["doc_ids"].combine_chunks().flatten()
        lists = table.filter(pc.invert(filled))
        width = (len(doc_ids) + 63) // 64
        sums: dict[object, np.ndarray] = {}
        for at in range(0, lists.num_rows, 256):
            for r in lists.slice(at, 256).to_pylist():
                w = weight(documents, r["all_df"])
                if w == 0:
                    continue
                ordinals = np.frombuffer(r["ordinals"], "<u2").astype(np.int64)
                if len(r["slices"]) == 4 * len(ordinals):
                    words, slices = to_slices(ordinals, np.frombuffer(r["slices"], "<u4").astype(np.int64) * w, IMPACT_BITS + w.bit_length())
                else:
                    words = np.unique(ordinals >> 6)
                    slices = times(np.frombuffer(r["slices"], "<u8").reshape(IMPACT_BITS, -1), w)
                for x in r["items"]:
                    mine = slices if x["times"] == 1 else times(slices, x["times"])
                    total = sums.get(x["item_id"])
                    need = max(len(mine), 0 if total is None else len(total)) + 1
                    if total is None:
                        total = np.zeros((need, width), _U64)
                    elif total[-1].any() or len(total) < need:
                        total = np.concatenate([total, np.zeros((need - len(total) + 1, width), _U64)])
                    if len(words) == width:
                        add(total, mine)
                    else:
                        part = total[:, words]
                        add(part, mine)
                        total[:, words] = part
                    sums[x["item_id"]] = total
        out = []
        for item, total in sums.items():
            top = best(total, k)
            score = _numbers(total, top)
            out.append(pa.table([pa.array([item] * len(top), lists.schema.field("items").type.value_type.field("item_id").type), doc_ids.take(pa.array(top)), pa.array(top), pa.array(score)], names=["item_id", "doc_id", "ordinal", "score"]))
        if not out:
            return pa.table([pa.nulls(0, lists.schema.field("items").type.value_type.field("item_id").type), pa.nulls(0, doc_ids.type), pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64())], names=["item_id", "doc_id", "ordinal", "score"])
        return pa.concat_tables(out)

    tops = rows.unionByName(segments).groupBy("segment", "block").applyInArrow(rank, f"item_id {kind}, doc_id {id_kind}, ordinal long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "ordinal")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
