import random
from collections import defaultdict

import numpy as np
import pytest

from voxfabric.llm import similarity_join as sj


def brute(rows, threshold, n):
    """Per row: class id, copy id, copies, links, by comparing all pairs."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[tuple((t or "").split())].append(i)
    names = list(groups)
    grams = [{w[k : k + n] for k in range(len(w) - n + 1)} or ({w} if w else set()) for w in names]
    rep = [min((i for i in groups[w] if i is not None), default=None) for w in names]
    root, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if grams[a] and grams[b] and None not in (rep[a], rep[b]) and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(names)):
        if rep[k] is not None:
            least[find(k)] = min(least.get(find(k), rep[k]), rep[k])
    return sorted((str(i), str(least.get(find(k))), str(rep[k]), len(groups[w]), links[k]) for k, w in enumerate(names) for i in groups[w])


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sj, "BLOCK", block)
    r = random.Random(3)
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 160))]
        for _ in range(r.choice([1, 1, 2, 3, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            rows.append((i * 13 % 997, r.choice([" ", "\n "]).join(w)))
            i += 1
    rows += [(2000, None), (2001, ""), (2002, " "), (None, rows[0][1]), (None, "alone"), (2003, rows[0][1]), (2004, "y " * 4000), (2005, "a b"), (2006, "a  b"), (rows[3][0], "other words than that row has")]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, class int, rep string").repartition(4)
    got = sorted((str(x.doc_id), str(x.class_id), str(x.copy_id), x.copies, x.n_links) for x in sj.join(df).collect())
    assert got == brute(rows, 0.8, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sj.join(df).collect() == []


def test_drop_near_copies(spark):
    t = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(4, t, 1), (2, t + " x", 2), (9, "q", 3), (None, t, 4)], "doc_id long, text string, class_id int")
    got = sj.drop_near_copies(df)
    assert got.columns == df.columns and sorted(r.class_id for r in got.collect()) == [2, 3, 4]


def test_drop_keeps_other_rows_of_an_id(spark):
    t = " ".join(map(str, range(100)))
    rows = [(1, t, 1), (7, t + " x", 2), (7, " something else\nhere ", 3), (7, "é", 4), (9, " é ", 5)]
    got = sj.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, k int"))
    assert sorted(r.k for r in got.collect()) == [1, 3, 4]


def test_recall_against_brute_force(spark):
    """Links of every hundredth id against all rows, over one of the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: set(zip(*[(r.text or "").split()[k:] for k in range(5)])) for r in docs.collect() if len((r.text or "").split()) >= 5}
    texts = {r.doc_id: tuple((r.text or "").split()) for r in docs.collect()}
    got = {r.doc_id: r.n_links for r in sj.join(docs).collect()}
    for i in [i for i in sets if i % 10 == 0]:
        near = {texts[j] for j in sets if texts[j] != texts[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert got[i] == len(near), i


def test_depth_reaches_recall():
    assert sj.prefix_depth(0.8, 20, 6, 0.99999) == 3
    assert sj.prefix_depth(0.8, 1, 6, 0.99) == 1


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(i, 100) for i in range(101, 160)] + [(7, 7)] + [(300, 301), (301, 302), (300, 302)]
    got = {r.node: r.label for r in sj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 300 for i in range(300, 303)}


def test_similarity_is_exact():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 50, n).astype(np.uint64)) for n in (0, 1, 10, 40, 40, 60)]
    sets += [np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)]  # 8 of 10: 0.8 itself
    for threshold in (0.25, 0.5, 0.8, 0.81):
        got = sj._similar(sets, threshold)
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if a != b and len(x) + len(y):
                    assert got[a, b] == (len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= threshold)
