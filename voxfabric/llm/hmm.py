"""A hidden Markov language model over words.

Latent states are trained by Baum-Welch: each pass runs the scaled forward and
backward recursions over all training documents where they lie, and Spark sums
the expected counts of the tasks. Frequent words are symbols of their own. All
others belong to classes by their last bytes: a state emits the class, and the
class emits the word by its smoothed corpus frequency, so the probability of
a text is exact over an open vocabulary, and what the model sends to the tasks
is bounded while the word counts grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import cut, stored, text_column

#: Tokens that a task runs at a time (about 30 bytes each and state).
GROUP_TOKENS = 1 << 19
#: Distinct words a task counts before it passes the counts on.
TASK_WORDS = 1 << 19
#: Rare words that a task tells apart at a time, and pairs of word and document that it holds.
RARE_WORDS = 300_000
RARE_PAIRS = 1 << 21
#: Training tokens to each part in which the rows' sums meet.
PART_TOKENS = 1 << 22


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case. bytes.lower() changes these alone, bytes.split() parts at \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes, classes: int) -> int:
    """The class of a rare word: by its last four bytes."""
    return zlib.crc32(word[-4:]) % classes


@dataclass
class Model:
    """symbols: word -> number; then come the classes, then the end. start, move, emit: probabilities."""

    symbols: dict[bytes, int]
    classes: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state

    @property
    def end(self) -> int:
        return len(self.symbols) + self.classes


def _random(n_symbols: int, states: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    move = np.full((states, states), 0.2 / max(states - 1, 1)) + (0.8 - 0.2 / max(states - 1, 1)) * np.eye(states)
    emit = 1 + r.random((n_symbols, states))
    return np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def _sequences(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Longest first: order, the symbols step by step, where each step begins, and how many documents each step has."""
    n = np.array([len(d) for d in docs])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    steps = np.searchsorted(-n, -np.arange(n[0]), "left")  # documents longer than the step
    begin = np.concatenate([[0], np.cumsum(steps)])
    flat = np.empty(begin[-1], np.int32)
    for rank, i in enumerate(order):
        flat[begin[: n[rank]] + rank] = docs[i]
    return order, flat, begin, steps.tolist()


def forward(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = False):
    """log10 likelihood of each document; with keep, also what expected() needs. Scaled: each step's state weights sum to 1."""
    order, flat, begin, steps = _sequences(docs)
    seen = np.ascontiguousarray(emit.T)[:, flat]  # a row per state; with keep overwritten by the state weights
    scale = np.empty(len(flat))
    step = np.ascontiguousarray(move.T)
    a = start[:, None]
    for t, m in enumerate(steps):
        x = slice(begin[t], begin[t] + m)
        a = (a if t == 0 else step @ a[:, :m]) * seen[:, x]
        s = a.sum(0)
        a /= s
        scale[x] = s
        if keep:
            seen[:, x] = a
    logs = np.log10(scale)
    score = np.zeros(len(docs))
    for t, m in enumerate(steps):
        score[:m] += logs[begin[t] : begin[t] + m]
    out = np.empty(len(docs))
    out[order] = score
    return (out, flat, begin, steps, seen, scale) if keep else out


def expected(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of some documents: starts, moves, emissions, and the log10 likelihood."""
    score, flat, begin, steps, alpha, scale = forward(docs, start, move, emit, keep=True)
    states = len(start)
    table = np.ascontiguousarray(emit.T)
    moves = np.zeros_like(move)
    after = np.ones((states, 0))
    for t in range(len(steps) - 1, -1, -1):
        m, k = steps[t], after.shape[1]  # k documents go on; after: emission times beta of the next step, scaled
        x = slice(begin[t], begin[t] + m)
        beta = np.ones((states, m))
        if k:
            beta[:, :k] = move @ after
            moves += (alpha[:, begin[t] : begin[t] + k] @ after.T) * move
        after = table[:, flat[x]] * beta / scale[x]
        alpha[:, x] *= beta
    emitted = np.stack([np.bincount(flat, alpha[s], len(emit)) for s in range(states)], 1)
    return alpha[:, : steps[0]].sum(1), moves, emitted, float(score.sum())


class _Reader:
    """Texts to numbers of words: the model's symbols, then rare words as they come; `symbol` has each number's symbol."""

    def __init__(self, symbols: dict[bytes, int], classes: int):
        self.symbols, self.classes, self.head = symbols, classes, len(symbols)
        self.reset()

    def reset(self) -> None:
        self.known = dict(self.symbols)
        self.rare: list[bytes] = []
        self.symbol = np.arange(self.head + 1000, dtype=np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in known]
            n = len(known)
            known.update(zip(new, range(n, n + len(new))))
            self.rare += new
            if len(known) > len(self.symbol):
                self.symbol = np.concatenate([self.symbol, np.zeros(len(known) + 50_000, np.int32)])
            self.symbol[n : n + len(new)] = [self.head + word_class(w, self.classes) for w in new]
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _groups(batches: Iterator[pa.RecordBatch], at: int, read: _Reader) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row's first column, numbers of words) of documents, some GROUP_TOKENS at a time. The reader starts anew after a group that fills it."""
    held: list = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist()):
            ids = read(text)
            held.append((key, ids))
            size += len(ids) + 1
            if size >= GROUP_TOKENS or len(read.rare) >= RARE_WORDS:
                yield held
                held, size = [], 0
                if len(read.rare) >= RARE_WORDS:
                    read.reset()
    if held:
        yield held


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, as many as fit into `most` with all their equals in rank (64 ranks to each doubling of the count), and their counts."""
    rank = F.floor(F.log2("n") * 64)
    ranks = {r.rank: r["count"] for r in counts.groupBy(rank.alias("rank")).count().collect()}  # 64 a doubling
    least, total = None, 0
    for r in sorted(ranks, reverse=True):
        total += ranks[r]
        if total > most:
            break
        least = r
    if least is None:
        return {}
    return {bytes(r.word): r.n for r in sorted(counts.where(rank >= least).collect(), key=lambda r: (-r.n, bytes(r.word)))}


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n: how often each occurs in docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > TASK_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame, names: dict[bytes, int], classes: int, text: str = "text") -> DataFrame:
    """symbols: each text's symbols and its end, little-endian, 2 or 4 bytes each. Stored, so that texts are taken apart once for all passes."""
    sent = docs.sparkSession.sparkContext.broadcast(names)
    kind = _symbol_kind(len(names) + classes + 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(sent.value, classes)
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                ids = read(t)
                out.append(np.append(read.symbol[ids], len(sent.value) + classes).astype(kind).tobytes())
                if len(read.rare) >= RARE_WORDS:
                    read.reset()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["symbols"])

    return stored(docs.select(text).mapInArrow(code, "symbols binary"))


def _symbol_kind(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def train(docs: DataFrame, counts: DataFrame, states: int = 6, symbols: int = 16_384, classes: int = 512, passes: int = 4, piece: int = 512, seed: int = 11, text: str = "text") -> Model:
    """Fit to all of docs; counts are its word counts.

    Documents are trained whole, as pieces of at most `piece` tokens that each
    begin anew (scoring never cuts). Without documents every symbol is as
    likely as another.
    """
    top = _frequent(counts, symbols)
    names = {w: i for i, w in enumerate(top)}
    n = len(names) + classes + 1
    start, move, emit = _random(n, states, seed)
    # Frequencies first, states a little apart: the passes then separate them.
    frequency = np.full(n, 1.0)
    frequency[: len(top)] += list(top.values())
    emit = emit * frequency[:, None]
    emit /= emit.sum(0)
    schema = "symbol int, " + ", ".join(f"s{k} double" for k in range(states))
    numbers, kind = coded(docs, names, classes, text), _symbol_kind(n)
    for _ in range(passes):
        sent = docs.sparkSession.sparkContext.broadcast((start, move, emit))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            held: list[np.ndarray] = []
            size = 0

            def add() -> np.ndarray:
                starts, moves, emitted, _ = expected(held, *sent.value)
                more = np.concatenate([emitted, moves, starts[None, :]])
                return more if total is None else total + more

            for batch in batches:
                for x in batch.column(0):
                    d = np.frombuffer(x.as_buffer(), kind).astype(np.int32)
                    held += [d[i : i + piece] for i in range(0, len(d), piece)]
                    size += len(d)
                    if size >= GROUP_TOKENS:
                        total = add()
                        held, size = [], 0
            if held:
                total = add()
            if total is not None:
                some = np.flatnonzero(total.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, k]) for k in range(states)]], names=["symbol", *[f"s{k}" for k in range(states)]])

        sums = numbers.mapInArrow(step, schema).groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
        got = np.zeros((n + states + 1, states))
        for r in sums.collect():  # one row a symbol
            got[r.symbol] = r[1:]
        sent.unpersist()
        emitted, moves, starts = got[:n], got[n : n + states], got[-1]
        start = (starts + 1) / (starts + 1).sum()
        move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        prior = 0.05 + emitted.sum(1, keepdims=True) / max(emitted.sum(), 1)
        emit = (emitted + prior) / (emitted + prior).sum(0)
    return Model(names, classes, start, move, emit)


def score(docs: DataFrame, training: Column, symbols: int = 16_384, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: every row of docs, learning from those where training holds.

    Tokens are the words (A-Z in lower case) and one end. score is the model's
    log10 probability of the text, base_score that of single tokens:
    log10((c+0.5)/(N+0.5(V+1))) each. Null texts are empty: an end alone. In
    a class, a word has (c+0.5)/(sum of these+0.5), and unseen words together
    0.5 in place of c+0.5. Rows that repeat an id are scored one by one; null
    ids are scored like others. Without training rows N and V are 0; an empty
    table gives an empty result. A text of any length is scored whole by one
    task (about 30 bytes a token and state). Further columns of docs are
    ignored, whatever their names. A row's sums meet under a 64-bit hash of
    its id and text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = rows.where("training").select("text")
    ends = learn.count()
    counts = cut(count_words(learn))
    model = train(learn, counts, symbols=symbols, **options)
    names, classes = model.symbols, model.classes

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [-1 if w in names else word_class(w, classes) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column(1)], names=["class", "n"])

    sums = counts.mapInArrow(classify, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n_all, v_all = sum(r.n for r in sums) + ends, sum(r.v for r in sums) + (ends > 0)
    room = np.full(classes, 0.5)
    for r in sums:
        if r["class"] >= 0:
            room[r["class"]] += r.n + 0.5 * r.v
    log_all = float(np.log10(n_all + 0.5 * (v_all + 1)))
    base = np.zeros(model.end + 1)
    for w, n in _frequent(counts, symbols).items():
        base[names[w]] = np.log10(n + 0.5) - log_all
    base[model.end] = np.log10(ends + 0.5) - log_all
    sent = docs.sparkSession.sparkContext.broadcast((model, base, np.log10(room)))
    schema = pa.schema([("word", pa.binary()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("keys", pa.binary()), ("times", pa.binary())])
    # Sums of a part lie in one task's memory: parts follow the corpus.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_all // PART_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document what needs no counts, under a word that no text has; and per rare word the documents that have it."""
        m, logs, log_room = sent.value
        head, end = len(m.symbols), m.end
        read = _Reader(m.symbols, m.classes)
        words: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def rare(names_: list[bytes]) -> Iterator[pa.RecordBatch]:
            if not words:
                return
            word, key = np.concatenate(words), np.concatenate(owners)
            order = np.lexsort((key, word))
            word, key = word[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (key[1:] != key[:-1])]))
            times = np.diff(np.append(first, len(word))).astype("<u4")
            word, key = word[first], key[first].astype("<i8")
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(starts[1:], len(word))
            for a in range(0, len(starts), 50_000):
                x, y = starts[a : a + 50_000], ends[a : a + 50_000]
                offsets = np.append(x, y[-1]) - x[0]
                data = [(key[x[0] : y[-1]], 8), (times[x[0] : y[-1]], 4)]
                blobs = [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((offsets * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(d))]) for d, w in data]
                none = [pa.nulls(len(x), f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([pa.array([names_[i] for i in word[x].tolist()], pa.binary()), *none[1:6], *blobs], schema=schema)
            words.clear()
            owners.clear()

        for group in _groups(batches, 1, read):
            ids = [x[1] for x in group]
            symbols_ = [np.append(read.symbol[d], end) for d in ids]
            scores = forward(symbols_, m.start, m.move, m.emit)
            size = np.array([len(d) for d in ids])
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), size)
            uncommon = flat >= head
            classes_ = read.symbol[flat[uncommon]] - head
            scores = scores - np.bincount(owner[uncommon], log_room[classes_], len(ids))
            base_ = np.bincount(owner[~uncommon], logs[flat[~uncommon]], len(ids)) + logs[end]
            known = np.bincount(owner[~uncommon], minlength=len(ids)) + (ends > 0)
            keys = np.array([x[0] for x in group], np.int64)
            none = pa.nulls(len(group), pa.binary())
            own = pa.array([b" " + k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([own, pa.array(keys), pa.array(size + 1), pa.array(known), pa.array(base_), pa.array(scores), none, none], schema=schema)
            words.append(flat[uncommon] - head)
            owners.append(keys[owner[uncommon]])
            if len(read.rare) >= RARE_WORDS or sum(map(len, words)) >= RARE_PAIRS:
                yield from rare(read.rare)
        yield from rare(read.rare)

    def blob(c: pa.Array, kind: str) -> np.ndarray:
        """All values of a binary column, one after the other."""
        if not len(c):
            return np.zeros(0, kind)
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        return np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words' shares of the scores, summed by document as far as this task sees them and packed by part of the keys."""
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            x = _summed(np.concatenate(held))
            part = (x["key"].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, x = part[order], x[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [x[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "sums"])

        for batch in batches:
            doc = pc.is_valid(batch.column("key"))
            docs_ = batch.filter(doc)
            x = np.zeros(docs_.num_rows, _SUMS)
            x["docs"] = 1
            for name in ("key", "n_tokens", "n_known", "base", "score"):
                x[name] = docs_.column(name).to_numpy(zero_copy_only=False)
            held.append(x)
            words = batch.filter(pc.invert(doc))
            keys, times = blob(words.column("keys"), "<i8"), blob(words.column("times"), "<u4")
            each = pc.divide(pc.binary_length(words.column("keys")), 8).to_numpy(zero_copy_only=False)
            c = np.repeat(words.column("n").fill_null(0).to_numpy(), each)
            log = np.log10(c + 0.5)
            y = np.zeros(len(keys), _SUMS)
            y["key"], y["n_known"], y["base"], y["score"] = keys, times * (c > 0), times * (log - log_all), times * log
            held.append(y)
            size += len(x) + len(y)
            if size > RARE_PAIRS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def sum_up(group: tuple, table: pa.Table) -> pa.Table:
        x = _summed(np.frombuffer(b"".join(table["sums"].to_pylist()), _SUMS))
        # Rows of equal id and text share a key and have summed up alike.
        n = x["docs"]
        return pa.table([pa.array(x["key"]), pa.array(x["n_tokens"] // n), pa.array(x["n_known"] // n), pa.array(x["base"] / n), pa.array(x["score"] / n)], names=["key", "n_tokens", "n_known", "base_score", "score"])

    pairs = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "word binary, key long, n_tokens long, n_known long, base double, score double, keys binary, times binary")
    counted = pairs.join(counts, "word", "left").select("key", "n_tokens", "n_known", "base", "score", "keys", "times", "n")
    shares = counted.mapInArrow(add, "part int, sums binary").repartition(parts, "part").groupBy("part")
    per_row = shares.applyInArrow(sum_up, "key long, n_tokens long, n_known long, base_score double, score double")
    ids = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id")
    return ids.join(per_row, "key").select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


_SUMS = np.dtype([("key", "<i8"), ("docs", "<i8"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def _summed(x: np.ndarray) -> np.ndarray:
    """One entry per key."""
    keys, at = np.unique(x["key"], return_inverse=True)
    out = np.zeros(len(keys), _SUMS)
    out["key"] = keys
    for name in _SUMS.names[1:]:
        out[name] = np.bincount(at, x[name], len(keys))
    return out
