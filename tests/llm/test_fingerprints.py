import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxfabric.llm import fingerprints as fp

K = fp.K


def kmers(t):
    return [t[i : i + K] for i in range(len(t) - K + 1)] if len(t) >= K else [t] if t else []


class Hash:
    """Spark's hash() of k-mers and of pairs of longs and ints, asked for in bulk."""

    def __init__(self, spark):
        self.spark, self.known = spark, {}

    def __call__(self, values, kind):
        new = sorted(set(values) - self.known.keys(), key=str)
        if new:
            rows = [v if isinstance(v, tuple) else (v,) for v in new]
            df = self.spark.createDataFrame(rows, kind)
            self.known.update(zip(new, [r[0] for r in df.select(F.hash(*df.columns)).collect()]))
        return self.known


def brute(h, texts):
    """text -> entries."""
    numbered = {}
    for t in texts:
        seen, out = Counter(), []
        for i, m in enumerate(kmers(t)):
            seen[m] += 1
            out.append((m, seen[m], i))
        numbered[t] = out
    base = dict(h({m for out in numbered.values() for m, _, _ in out}, "a string"))
    again = h({(base[m], n) for out in numbered.values() for m, n, _ in out if n > 1}, "a long, b int")
    again = dict(again)
    picked = {}
    for t, out in numbered.items():
        bins = defaultdict(list)
        for m, n, i in out:
            rank = base[m] if n == 1 else again[base[m], n]
            bins[(rank >> 27) + 16].append((rank, i))
        picked[t] = {b: tuple(r for r, _ in sorted(sorted(v)[: fp.TUPLE], key=lambda x: x[1])) for b, v in bins.items()}
    ones = {p[0] for v in picked.values() for p in v.values() if len(p) == 1}
    twos = {p for v in picked.values() for p in v.values() if len(p) == 2}
    one = Hash(h.spark)(ones, "a long")
    two = Hash(h.spark)(twos, "a long, b long")
    return {t: "-".join(f"{b:02x}{(one[p[0]] if len(p) == 1 else two[p]) & 0xFFFFFFFF:08x}" for b, p in sorted(v.items())) for t, v in picked.items()}


def alike(a, b):
    a, b = set(filter(None, a.split("-"))), set(filter(None, b.split("-")))
    bins = {x[:2] for x in a | b}
    return len(a & b) / len(bins) if bins else 1.0


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeté\U0001f600n ") for _ in range(r.randint(1, 6)))
    rows = [(i * 5 % 101, "".join(word() for _ in range(r.choice([0, 1, 2, 5, 30, 200])))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a" * 100_000), (203, "abcdefg"), (204, "abcdefgh"), (205, "ab" * 500), (None, "null id"), (206, "\r\n  x" * 9)]
    return spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, fingerprint string, key int").repartition(5)


def test_against_brute_force(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    after = [t for _, t in rows[1:]] + [rows[0][1]]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), n in zip(rows, after)]
    prints = brute(Hash(spark), {t for _, t in rows} | set(edited))
    want = {
        i: (len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e], alike(prints[t], prints[e]), alike(prints[t], prints[n]))
        for (i, t), e, n in zip(rows, edited, after)
    }
    got = {r.doc_id: tuple(r)[1:] for r in fp.compare_with_edits(docs).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4], i
        assert got[i][4:] == pytest.approx(want[i][4:])
    alone = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    assert alone == {i: prints[t] for i, t in rows}


def test_repeated_rows_and_edges(spark, docs):
    assert fp.compare_with_edits(docs.limit(0)).collect() == []
    one = fp.compare_with_edits(docs.where("doc_id = 204")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    rows = [(1, "abcdefghij" * 9), (1, "abcdefghij" * 9), (2, "other text " * 9), (2, "third text " * 9)]
    got = fp.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 2]
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1
