import math
import re
from collections import Counter

import numpy as np
import pytest

from voxfabric.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    """The contract's arithmetic, document by document."""
    held = [Counter(words(t)) for _, t in docs]
    size = [sum(c.values()) for c in held]
    n, places = sum(s > 0 for s in size), sum(size)
    df = Counter(w for c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for (d, _), c, s in zip(docs, held, size):
            m = 75 + (25 * s * n) // max(places, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms if c[w])
            if score > 0:
                scored.append((-score, d is None, d, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(scored[:k])]
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Zürich", "ÉCOLE", "x9", "日本"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "  .,;"), (None, "w1 w2 w3"), (1003, "w1 w2 w3"), (1003, "w1 w2 w3"), (1004, "W1-w2_w3!W1"), (1005, "w5 zürich " * 60_000), (1006, "퟿\U0001f600 w7\x00w7")]
    docs += [(2000 + i, "same text w4 w4 w9") for i in range(150)]
    items = [(1, "w1 w2"), (2, "W4 same. text"), (3, None), (4, ""), (5, "nothing known"), (6, "w7 w7 w7 zürich École x9"), (7, "日本 \U0001f600 w9"), (8, "w1"), (8, "w3 w3"), (9, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"SEGMENT_DOCS": 64, "ITEM_BLOCK": 2}, {"SEGMENT_PLACES": 90, "BROADCAST_PAIRS": 0, "ITEM_BLOCK": 3}])
def test_search_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, segment int").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, block int")
    got = [tuple(r) for r in lexical.search(lexical.index(d), q).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables_and_other_ids(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "name string, body string")
    q = spark.createDataFrame([("q", "two")], "item string, body string")
    found = lexical.index(d, "name", "body")
    assert [tuple(r)[:3] for r in lexical.search(found, q, 20, "item", "body").orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.search(found, q.where("false"), 20, "item", "body").isEmpty()
    assert lexical.search(lexical.index(d.where("false"), "name", "body"), q, 20, "item", "body").isEmpty()


def test_bitmaps_and_lists_are_kept(spark):
    """Terms of many documents are bitmaps, others lists, in one index over all terms."""
    d = spark.createDataFrame([(i, f"often rare{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    found = {r.term: (r.df, len(r.slices)) for r in lexical.index(d).rows.where("term is not null").collect()}
    assert len(found) == 201
    assert found["often"] == (200, lexical.IMPACT_BITS * 4 * 8) and found["rare7"] == (1, 4)


def test_carry_arithmetic_and_top_k():
    rng = np.random.default_rng(3)
    total, expected = np.zeros((44, 8), np.uint64), np.zeros(512, np.int64)
    for _ in range(20):
        at = np.sort(rng.choice(512, rng.integers(1, 512), replace=False))
        x, w = rng.integers(0, 10**6, len(at)), int(rng.integers(1, 9000))
        touched, slices = lexical.to_slices(at, x, lexical.IMPACT_BITS)
        part = total[:, touched]
        lexical.add(part, lexical.times(slices, w))
        total[:, touched] = part
        expected[at] += x * w
    every = np.arange(512)
    assert (lexical._numbers(total, every) == expected).all()
    expected[::3] = expected[1::3][0]  # ties
    _, slices = lexical.to_slices(every, expected, 44)
    for k in (1, 20, 171, 600):
        best = sorted(sorted(every[expected > 0].tolist(), key=lambda i: (-expected[i], i))[:k])
        assert lexical.best(slices, k).tolist() == best
