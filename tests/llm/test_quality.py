import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfabric.llm import quality
from voxfabric.llm.common import fold


def test_chunks_cover_every_window():
    for n in (0, 1, quality.WIDTH, quality.CHUNK, quality.CHUNK + 1, 5000):
        text = bytes(97 + (i * i) % 26 for i in range(n)).decode()
        c = quality.chunks(text)
        seen = {bytes(row[i : i + quality.WIDTH].astype(np.uint8)) for row in c for i in range(quality.STEP) if (row[i : i + quality.WIDTH] < 256).all()}
        assert seen == {text[i : i + quality.WIDTH].encode() for i in range(n - quality.WIDTH + 1)}


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    net = quality.Network.random(2)
    for name in vars(net):
        setattr(net, name, getattr(net, name).astype(float))
    rows = r.integers(0, 257, (5, quality.CHUNK)).astype(np.int16)
    y, w = np.array([0, 1, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = quality.logits(net, rows)
        return (w * (np.log1p(np.exp(z)) - y * z)).sum() / w.sum()

    for part, grad in zip(net.parts(), quality._gradients(net, rows, y, w)):
        where = tuple(x[0] for x in np.nonzero(np.abs(grad) == np.abs(grad).max()))
        old, e = part[where], 1e-5
        part[where] = old + e
        up = loss()
        part[where] = old - e
        down = loss()
        part[where] = old
        assert np.isclose((up - down) / (2 * e), grad[where], rtol=1e-2, atol=1e-7)


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 7)))
    rows = [(i, (" " if i % 4 else "### ").join(word() for _ in range(r.integers(5, 200))), int(i % 4 > 0), "clash") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")


def test_held_out_accuracy(spark, docs):
    net = quality.train(docs, docs.where(fold() != 0).select("doc_id", "quality"), passes=8)
    held = quality.score(docs.where(fold() == 0), net).collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_edges(spark, docs):
    net = quality.train(docs, docs.limit(0))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 70_000), (None, "x")], "doc_id long, text string")
    got = quality.score(odd, net).collect()
    assert len(got) == 4 and got[0].score == got[1].score
    assert quality.score(odd.limit(0), net).collect() == []
    one = quality.train(docs, docs.where(F.col("quality") == 1))
    assert one.bias[0] > 0


def brute_score(net, text):
    """Every chunk, every place and every filter one after the other."""
    data = [*(text or "").encode()]
    logits, at = [], 0
    while True:
        part = data[at : at + quality.CHUNK]
        part += [256] * (quality.CHUNK - len(part))
        windows = [np.concatenate([net.embed[b] for b in part[i : i + quality.WIDTH]]) for i in range(quality.STEP)]
        pooled = [max(0.0, max(float(np.dot(w, net.conv[:, f])) for w in windows) + float(net.conv_bias[f])) for f in range(quality.FILTERS)]
        hidden = [max(0.0, sum(p * float(net.hidden[f, h]) for f, p in enumerate(pooled)) + float(net.hidden_bias[h])) for h in range(quality.HIDDEN)]
        logits.append(sum(v * float(net.out[h]) for h, v in enumerate(hidden)) + float(net.bias[0]))
        at += quality.STEP
        if at + quality.WIDTH - 1 >= len(data):
            return 1 / (1 + np.exp(-sum(logits) / len(logits)))


def test_scores_against_brute_force(spark, docs):
    net = quality.train(docs, docs.select("doc_id", "quality"), passes=1)
    texts = [None, "", "abc", "é" * 300, "### ab cd " * 40, "x" * quality.CHUNK, "y z" * 700]
    rows = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.text: r.score for r in quality.score(rows, net).collect()}
    assert [got[t] for t in texts] == pytest.approx([brute_score(net, t) for t in texts], abs=1e-4)


def test_auc_on_the_tables(spark):
    from voxfabric.llm.queries import op8_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in op8_quality(spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
