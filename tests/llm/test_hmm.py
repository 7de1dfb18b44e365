import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfabric.llm import hmm
from voxfabric.llm.common import fold


def brute_likelihood(seq, start, move, emit):
    total = 0
    for path in product(range(len(start)), repeat=len(seq)):
        p = start[path[0]] * emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
        total += p
    return math.log10(total)


def brute_counts(seq, start, move, emit):
    starts, moves, emitted, total = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit), 0
    for path in product(range(len(start)), repeat=len(seq)):
        p = start[path[0]] * emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
        total += p
        starts[path[0]] += p
        for t, s in enumerate(path):
            emitted[seq[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    return starts / total, moves / total, emitted / total


def test_forward_and_counts_against_all_paths():
    r = np.random.default_rng(0)
    start, move, emit = hmm._random(5, 3, 1)
    docs = [r.integers(0, 5, n).astype(np.int32) for n in (1, 6, 4, 6, 2)]
    assert np.allclose(hmm.forward(docs, start, move, emit), [brute_likelihood(d, start, move, emit) for d in docs])
    got = hmm.expected(docs, start, move, emit)
    want = [sum(x) for x in zip(*(brute_counts(d, start, move, emit) for d in docs))]
    for a, b in zip(got[:3], want):
        assert np.allclose(a, b)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(("le chat Dort" if i % 2 else "the cat sleeps") .split() * (1 + i % 5)) + f" w{i % 7}", i) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (102, "x " * 3000, 1), (None, "The cat", 2), (3, "twice", 1), (3, "twice", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)


def test_scores(spark, docs):
    out = hmm.score(docs, fold() != 1, symbols=6, classes=4, states=2, passes=2).collect()
    assert len(out) == docs.count()
    rows = docs.collect()
    count = Counter()
    key = lambda r: "" if r.doc_id is None else str(r.doc_id)
    for r in rows:
        if zlib.crc32(key(r).encode()) % 5 != 1:
            count.update([*hmm.tokens(r.text), b" "])
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*hmm.tokens(t), b" "])
    want = sorted((r.doc_id or -1, len(hmm.tokens(r.text)) + 1, sum(count[w] > 0 for w in [*hmm.tokens(r.text), b" "]), round(base(r.text), 6)) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)


def test_probabilities_sum_to_one(spark):
    """Over all texts of one word (unseen words together, by class) and then the end."""
    train = spark.createDataFrame([(i, "a b b c dd ee ff") for i in range(9)], "doc_id long, text string")
    model = hmm.train(train, hmm.count_words(train), symbols=2, classes=3, states=2, passes=2)
    emit = model.emit.sum(0)
    assert np.allclose(emit, 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.start.sum(), 1)
    texts = ["a", "b", "c", "dd", "ee", "ff"]
    unseen, taken = [], set()
    for i in range(1000):
        c = hmm.word_class(f"u{i}".encode(), 3)
        if c not in taken:
            taken.add(c)
            unseen.append(f"u{i}")
    ask = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts + unseen)] + [(i, "a b b c dd ee ff") for i in range(9)], "doc_id long, text string")
    got = hmm.score(ask, F.col("doc_id") < 100, symbols=2, classes=3, states=2, passes=2).where("doc_id >= 100").collect()
    one = sum(10**r.score for r in got)
    # P(one word, then the end) by the chain itself.
    after = (model.start * (1 - model.emit[model.end])) @ model.move @ model.emit[model.end]
    assert math.isclose(one, after, rel_tol=1e-6)


def test_empty(spark, docs):
    assert hmm.score(docs.limit(0), fold() != 1, passes=1).collect() == []
    none = hmm.score(docs, F.lit(False), passes=1, symbols=4, classes=4).collect()
    assert len(none) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
