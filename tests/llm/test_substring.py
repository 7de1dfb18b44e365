import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxfabric.llm import substring_dedup
from voxfabric.llm.shingles import Words


def brute(docs, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("phrases, seed_bits", [(1 << 22, 64), (60, 64), (1 << 22, 6), (60, 6)])
def test_against_brute_force(spark, monkeypatch, phrases, seed_bits):
    """With 6 bits of the hashes most factors fail their check, and the exact way has to find what they hid."""
    monkeypatch.setattr(substring_dedup, "TASK_PHRASES", phrases)
    r = random.Random(5)
    passages = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(3, 40))] for _ in range(12)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice("klmnop") + str(r.randint(0, 99)) for _ in range(r.randint(1, 20))]
        docs.append((i * 7 % 120, r.choice([" ", "\n", "\t  "]).join(w)))
    docs += [(500, None), (501, ""), (502, "x " * 3000), (503, "x " * 20), (504, "é ü " * 40), (-3, "a")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, kept string, places int").repartition(5)
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(df, window=6, seed_bits=seed_bits).collect()}
    assert {i: (x.n_words, x.n_removed, x.kept) for i, x in got.items()} == brute(docs, 6)
    assert all(sum(s["last"] - s["first"] for s in x.spans) == x.n_removed for x in got.values())


def test_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df, window=4).collect())
    assert got == Counter([(1, 0), (1, 0), (None, 0), (2, 8)])
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_rows_of_one_id_keep_apart(spark):
    t, u = "a b c d e f g h", "q r s t a b c d"
    df = spark.createDataFrame([(1, t), (5, u), (5, "z z z z z z z"), (5, "1 2 3 a b c d e")], "doc_id long, text string")
    got = Counter((r.doc_id, r.kept) for r in substring_dedup.remove_repeats(df, window=4).collect())
    assert got == Counter([(1, t), (5, "q r s t"), (5, "z z z z z z z"), (5, "1 2 3")])


def test_spans():
    assert substring_dedup.spans(np.array([5, 3, 20, 17, 40]), np.array([1, 2, 1, 1, 1]), 13) == [(3, 33), (40, 53)]


def test_runs_follow_one_reference():
    hits = np.array([(0, 7, 1, 4, 20), (0, 5, 1, 4, 18), (0, 6, 1, 4, 19), (0, 8, 1, 5, 21), (1, 9, 1, 5, 22)], substring_dedup._PARTS)
    assert substring_dedup.runs(hits).tolist() == [(0, 5, 3, 4, 18), (0, 8, 1, 5, 21), (1, 9, 1, 5, 22)]


def test_runs_depend_on_words_alone():
    a, b = Words("x  the quick\nbrown fox").runs(3), Words("the quick brown").runs(3)
    assert b[0] == a[1] and len(a) == 3 and len(set(a.tolist())) == 3
    assert len(Words("a b").runs(3)) == len(Words(None).runs(1)) == 0
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(5000))
    assert len(set(Words(text).runs(2).tolist())) == 4999
