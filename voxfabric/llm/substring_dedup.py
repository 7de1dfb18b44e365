"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is all of the corpus. Its index, from each phrase of `window`
words to the smallest document that has it and the place there, is dealt by
hash into blocks, and every document is looked up in every block that one of
its phrases falls into. The answers are parsed from left to right: a factor
is a run of places whose phrases all have their smallest document in one, and
stand in one stretch there. So a factor ends where the next phrase has a
smaller document, even if a longer stretch could be copied from another one:
which words repeat doesn't depend on it. Where a factor ends, the phrases that
straddle its end are looked up like all others and begin factors of their own,
so nothing is lost at a boundary.

Phrases are found by 64-bit hashes. Every factor is then checked: the 128-bit
digests of its words and of the words it copies must agree, and for the
phrases of a factor that fails, the smallest document is found anew by
digests alone. Factors make duplicate spans.

A task first settles repeats among its own documents. Of each phrase only the
task's smallest document has to ask the phrase's block, so a phrase that a
third of all documents share sends a block one entry per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import as_long, cut, hot_lookup, marked, stored
from voxfabric.llm.shingles import Words, mix

#: Phrases that a task holds at a time (about 60 bytes each while it sorts).
TASK_PHRASES = 1 << 21
#: Phrases that a block is planned for.
BLOCK_PHRASES = 1 << 21
#: Factors are checked in pieces that end at multiples of so many places of the reference: requests for one reference stay in proportion to its text.
PIECE = 256

#: A row: its id, and where ids repeat a hash of its text, which tells rows of one id apart.
_DOC = np.dtype([("id", "<i8"), ("tag", "<i8")])
_PARTS = np.dtype([("doc", "<u4"), ("place", "<u4"), ("n", "<u4"), ("ref", "<u4"), ("at", "<u4")])
_REQUEST = "block int, docs binary, phrases binary, rows binary, places binary"
_HITS = "part int, docs binary, hits binary"
_FACTOR = "doc_id long, tag long, place int, n int, ref_id long, ref_tag long, ref_place int"


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte significance, high bytes together, compressed: what varies little takes little."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def _unplanes(data: bytes, kind: np.dtype | str) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return flat.T.copy().view(kind).reshape(-1)


def _listed(docs: np.ndarray) -> bytes:
    """Sorted rows, their ids as differences."""
    out = docs.copy()
    out["id"] = np.diff(docs["id"], prepend=np.zeros(1, np.int64))
    return _planes(out)


def _unlisted(data: bytes) -> np.ndarray:
    out = _unplanes(data, _DOC)
    out["id"] = np.cumsum(out["id"])
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs(hits: np.ndarray) -> np.ndarray:
    """Hits (doc, place, n places, ref, place there) in order of doc and place, joined where one continues the other."""
    hits = hits[np.lexsort((hits["place"], hits["doc"]))]
    if not len(hits):
        return hits
    a, b = hits[:-1], hits[1:]
    goes_on = (a["doc"] == b["doc"]) & (a["ref"] == b["ref"]) & (a["place"] + a["n"] == b["place"]) & (a["at"] + a["n"] == b["at"])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    out = hits[first]
    out["n"] = np.add.reduceat(hits["n"], first)
    return out


def _dealt(docs: np.ndarray, hits: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Hits by part of their documents; the numbers of documents begin anew in each."""
    hits = runs(hits)
    part = (mix(docs["id"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)[hits["doc"]]
    order = np.argsort(part, kind="stable")
    part, hits = part[order], hits[order]
    begin = _starts(part)
    for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
        some = hits[x:y].copy()
        used, number = np.unique(np.concatenate([some["doc"], some["ref"]]), return_inverse=True)
        some["doc"], some["ref"] = number[: len(some)], number[len(some) :]
        yield int(part[x]), _listed(docs[used]), _planes(some)


def _as_hits(doc: np.ndarray, place: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), _PARTS)
    out["doc"], out["place"], out["n"], out["ref"], out["at"] = doc, place, 1, ref, at
    return out


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(name, types[t]) for name, t in (x.split() for x in kind.split(", "))]
    return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(fields)}, schema=pa.schema(fields))


def factors(docs: DataFrame, window: int, blocks: int, seed_bits: int = 64) -> DataFrame:
    """The factors of docs (doc_id long, tag, text): n places from place on, whose phrases stand in the row ref from ref_place on.

    seed_bits: how many bits of the phrases' hashes are used.
    """
    shift = np.uint64(64 - (blocks - 1).bit_length()) if blocks > 1 else None
    mask = ~np.uint64(0) << np.uint64(64 - seed_bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            own, by_key = np.unique(np.array(keys, _DOC), return_inverse=True)
            n = [len(h) for h in held]
            phrase, row = np.concatenate(held) & mask, np.repeat(by_key.reshape(-1), n).astype(np.uint32)
            place = np.concatenate([np.arange(k, dtype=np.uint32) for k in n])
            order = np.lexsort((place, row, phrase))
            phrase, row, place = phrase[order], row[order], place[order]
            first = _starts(phrase)
            least = np.repeat(first, np.diff(np.append(first, len(phrase))))
            here = own["id"][row] > own["id"][row[least]]  # repeats of a smaller document of this task
            for hit in _dealt(own, _as_hits(row[here], place[here], row[least[here]], place[least[here]]), blocks):  # settled: blocks pass them on
                yield from _table(_REQUEST, [(hit[0], hit[1], None, hit[2], None)]).to_batches()
            phrase, row, place = phrase[~here], row[~here], place[~here]
            cuts = np.searchsorted(phrase, np.arange(1, blocks, dtype=np.uint64) << shift) if blocks > 1 else []
            for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(phrase)])):
                if y > x:
                    some, local = np.unique(row[x:y], return_inverse=True)
                    steps = np.diff(phrase[x:y], prepend=np.zeros(1, np.uint64))
                    yield from _table(_REQUEST, [(b, _listed(own[some]), _planes(steps), _planes(local.astype("<u4")), _planes(place[x:y]))]).to_batches()

        total = 0
        for batch in batches:
            for i, tag, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = Words(t).runs(window)
                if len(found):
                    keys.append((i, tag))
                    held.append(found)
                    total += len(found)
                if total >= TASK_PHRASES:
                    yield from flush()
                    keys, held, total = [], [], 0
        yield from flush()

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        settled = pc.is_null(rows["phrases"])
        passed = rows.filter(settled).select(["block", "docs", "rows"]).rename_columns(["part", "docs", "hits"])
        asked = rows.filter(pc.invert(settled)).to_pylist()
        if not asked:
            return passed
        phrase = np.concatenate([np.cumsum(_unplanes(p["phrases"], "<u8"), dtype=np.uint64) for p in asked])
        lists = [_unlisted(p["docs"]) for p in asked]
        place = np.concatenate([_unplanes(p["places"], "<u4") for p in asked])
        own, number = np.unique(np.concatenate(lists), return_inverse=True)
        before = np.cumsum([0, *map(len, lists)])
        row = number.reshape(-1)[np.concatenate([_unplanes(p["rows"], "<u4") + b for p, b in zip(asked, before[:-1])])]
        order = np.lexsort((place, row, phrase))
        phrase, row, place = phrase[order], row[order], place[order]
        first = _starts(phrase)
        least = np.repeat(first, np.diff(np.append(first, len(phrase))))
        there = own["id"][row] > own["id"][row[least]]
        found = _table(_HITS, list(_dealt(own, _as_hits(row[there], place[there], row[least[there]], place[least[there]]), blocks)))
        return pa.concat_tables([passed.cast(found.schema), found])

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        got = [(_unlisted(p["docs"]), _unplanes(p["hits"], _PARTS)) for p in rows.to_pylist()]
        own, number = np.unique(np.concatenate([d for d, _ in got]), return_inverse=True)
        number, before = number.reshape(-1), 0
        for d, h in got:
            h["doc"], h["ref"] = number[h["doc"] + before], number[h["ref"] + before]
            before += len(d)
        found = runs(np.concatenate([h for _, h in got]))
        doc, ref = own[found["doc"]], own[found["ref"]]
        columns = [doc["id"], doc["tag"], found["place"], found["n"], ref["id"], ref["tag"], found["at"]]
        return pa.table([pa.array(np.ascontiguousarray(c), pa.int32() if c.itemsize == 4 else pa.int64(), safe=False) for c in columns], names=[x.split()[0] for x in _FACTOR.split(", ")])

    asked = docs.mapInArrow(ask, _REQUEST).repartition(blocks, "block")
    answered = asked.groupBy("block").applyInArrow(answer, _HITS).repartition(blocks, "part")
    return answered.groupBy("part").applyInArrow(gather, _FACTOR)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def digests(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """name, digest of the words of n places from place on, for the rows of wanted (doc_id, tag, place, n, name; distinct)."""
    per_row = cut(wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "n", "name")).alias("wants")))  # in proportion to the row's text
    rows = marked(docs, F.xxhash64("doc_id", "tag"), per_row.select(F.xxhash64("doc_id", "tag").alias("key")), "asked").where("asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, wants in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(t).words
                out = [_digest(words[w["place"] : w["place"] + w["n"] + window - 1]) for w in wants]
                yield pa.RecordBatch.from_arrays([pa.array([w["name"] for w in wants], pa.int64()), pa.array(out, pa.binary())], names=["name", "digest"])

    return rows.join(per_row, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("text", "wants").mapInArrow(read, "name long, digest binary")


def exact_places(docs: DataFrame, doubted: DataFrame, window: int, seed_bits: int = 64) -> DataFrame:
    """doc_id, tag, place, n (1): of all phrases whose hash doubted (phrase long) has, those that a smaller document has too, by digests."""
    mask = ~np.uint64(0) << np.uint64(64 - seed_bits)

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tag, t in zip(*(c.to_pylist() for c in batch.columns)):
                w = Words(t)
                found = w.runs(window) & mask
                if len(found):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * n, pa.int64()), pa.array([tag] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(found.view(np.int64)), pa.array([_digest(w.words[k : k + window]) for k in range(n)], pa.binary())],
                        names=["doc_id", "tag", "place", "phrase", "digest"],
                    )

    every = docs.mapInArrow(list_, "doc_id long, tag long, place int, phrase long, digest binary")
    some = cut(every.join(doubted, "phrase", "left_semi").select("doc_id", "tag", "place", "digest"))
    first = some.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return some.join(first, "digest").where("doc_id > first").select("doc_id", "tag", "place", F.lit(1).alias("n"))


def spans(places: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of words [a, b) of factors; those that meet or overlap join."""
    order = np.argsort(places, kind="stable")
    first, last = places[order], np.maximum.accumulate(places[order] + n[order] + window - 1)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]])) if len(first) else []
    return [(int(first[a]), int(last[b - 1])) for a, b in zip(new, [*new[1:], len(first)])]


def cut_pieces(found: DataFrame) -> DataFrame:
    """Factors in pieces that end at multiples of PIECE of the reference: doc_id, tag, place, n, ref_id, ref_tag, ref_place, ref (the hash that names what is copied)."""
    ends = F.expr(f"transform(sequence(ref_place div {PIECE}, (ref_place + n - 1) div {PIECE}), b -> struct(greatest(b * {PIECE}, ref_place) - ref_place as k, least((b + 1) * {PIECE}, ref_place + n) - ref_place as e))")
    pieces = found.withColumn("piece", F.explode(ends)).select(
        "doc_id", "tag", (F.col("place") + F.col("piece.k")).cast("int").alias("place"), (F.col("piece.e") - F.col("piece.k")).cast("int").alias("n"),
        "ref_id", "ref_tag", (F.col("ref_place") + F.col("piece.k")).cast("int").alias("ref_place"),
    )
    # Should two references share a name, their pieces come with either's digest too, fail the check and are found anew.
    return pieces.withColumn("ref", F.xxhash64("ref_id", "ref_tag", "ref_place", "n"))


def with_digests(docs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, place, n, digest: pieces with the digests of the words they copy."""
    total = pieces.count()
    weights = pieces.groupBy("ref").agg(F.count("*").alias("times"), F.first(F.struct("ref_id", "ref_tag", "ref_place", "n")).alias("at"))
    weights = cut(weights.select("ref", "times", F.col("at.ref_id").alias("doc_id"), F.col("at.ref_tag").alias("tag"), F.col("at.ref_place").alias("place"), F.col("at.n").alias("n")))
    known = digests(docs, weights.select("doc_id", "tag", "place", "n", F.col("ref").alias("name")), window)
    table = known.join(weights.select(F.col("ref").alias("name"), "times"), "name").select(F.col("name").cast("string").alias("ref"), "times", "digest")
    named = pieces.select("doc_id", "tag", "place", "n", F.col("ref").cast("string").alias("ref"))
    out = hot_lookup(named, cut(table), "ref", "times", total, "r_", spread="place")
    return out.select("doc_id", "tag", "place", "n", F.coalesce("r_digest", F.lit(b"")).alias("digest"))


def doubted_phrases(docs: DataFrame, wrong: DataFrame, window: int, seed_bits: int) -> DataFrame:
    """phrase: the hashes of the phrases of pieces that failed (doc_id, tag, wrong: places and lengths)."""
    mask = ~np.uint64(0) << np.uint64(64 - seed_bits)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = (Words(t).runs(window) & mask).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([every[w["place"] : w["place"] + w["n"]] for w in wants]))], names=["phrase"])

    return docs.join(wrong, ["doc_id", "tag"]).select("text", "wrong").mapInArrow(phrases, "phrase long").distinct()


def _parsed(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """given, doc_id, tag, text, places (place, n, digest of what they copy; null: known to be right) to the result and the pieces whose own digest is another."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "spans": [], "wrong": []}
            for t, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words = Words(t).words
                right, wrong = [], []
                for x in p or []:
                    same = x["digest"] is None or x["digest"] == _digest(words[x["place"] : x["place"] + x["n"] + window - 1])
                    (right if same else wrong).append(x)
                gone = spans(np.array([x["place"] for x in right], np.int64), np.array([x["n"] for x in right], np.int64), window)
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
                out["spans"].append([{"first": a, "last": b} for a, b in gone])
                out["wrong"].append([{"place": x["place"], "n": x["n"]} for x in wrong])
            pair = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pair("first", "last"), pair("place", "n")]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["given", "doc_id", "tag", *out])

    return rows.select("given", "doc_id", "tag", "text", "places").mapInArrow(
        parse, f"given {kind}, doc_id long, tag long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>, wrong array<struct<place:long,n:long>>"
    )


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", seed_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text left: words joined by one space), spans (of removed words).

    Words are runs other than ASCII white space. A word goes if a window of
    `window` words that covers it also starts in a row with a smaller id, in
    the input as given. Ids are compared as longs, and those that are none count
    as null. Null texts have no words;
    texts shorter than a window stay whole; texts of any length are parsed
    whole by one task. Rows that share an id don't remove each other's words,
    and each loses its own repeats alone; rows that repeat both id and text
    get the same result. Rows with a null id are neither reference nor parsed.
    An empty table gives an empty result; further columns of docs are ignored,
    whatever their names.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // 6 // BLOCK_PHRASES)
    blocks = 1 << (blocks - 1).bit_length()
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("given"), as_long(docs, doc_id).alias("doc_id"), F.col(text).alias("text"))
    repeated = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    rows = marked(rows, F.coalesce("doc_id", F.lit(0)), repeated.where("doc_id is not null"), "again")
    rows = rows.select("given", "doc_id", "text", F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("tag"))
    known = rows.where("doc_id is not null").select("doc_id", "tag", "text")
    pieces = cut(cut_pieces(factors(known, window, blocks, seed_bits)))

    def result(places: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with places, stored, and the others, which go through as they are."""
        per_row = cut(places.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "n", "digest")).alias("places")))  # in proportion to the row's text
        held = marked(rows, F.xxhash64("doc_id", "tag"), per_row.select(F.xxhash64("doc_id", "tag").alias("key")), "hit")
        some = stored(_parsed(held.where("hit").join(per_row.hint("merge"), ["doc_id", "tag"], "left"), kind, window))
        none = F.lit(None).cast("array<struct<place:int,n:int,digest:binary>>")
        return some, _parsed(held.where("not hit").withColumn("places", none), kind, window)

    some, others = result(with_digests(known, pieces, window))
    wrong = some.where(F.size("wrong") > 0)
    if not wrong.isEmpty():
        doubted = cut(doubted_phrases(known, wrong.select("doc_id", "tag", "wrong").dropDuplicates(["doc_id", "tag"]), window, seed_bits))
        failed = wrong.select("doc_id", "tag", F.explode("wrong").alias("w")).select("doc_id", "tag", F.col("w.place").cast("int").alias("place"), F.col("w.n").cast("int").alias("n"))
        right = pieces.select("doc_id", "tag", "place", "n").join(failed, ["doc_id", "tag", "place", "n"], "left_anti")
        some, others = result(right.unionByName(exact_places(known, doubted, window, seed_bits)).withColumn("digest", F.lit(None).cast("binary")))
    return some.unionByName(others).select(F.col("given").alias("doc_id"), "n_words", "n_removed", "kept", "spans")
