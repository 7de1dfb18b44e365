"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each chunk's bytes are embedded, convolved with learned filters and max-pooled
over the chunk; a hidden layer makes a logit of that, and the document's
probability is the sigmoid of its chunks' mean logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EMBED, WIDTH, FILTERS, HIDDEN = 6, 6, 32, 16
CHUNK = 512
STEP = CHUNK - WIDTH + 1  # so that every run of WIDTH bytes lies in a chunk
BATCH = 256


@dataclass
class Network:
    embed: np.ndarray  # byte (256 is padding), EMBED
    conv: np.ndarray  # WIDTH * EMBED, FILTERS
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return cls(draw(257, EMBED) * 16, draw(WIDTH * EMBED, FILTERS), zero(FILTERS), draw(FILTERS, HIDDEN), zero(HIDDEN), draw(HIDDEN, 1)[:, 0], zero(1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.bias]


def chunks(text: str | None) -> np.ndarray:
    """Rows of CHUNK byte values, 256 past the end; together they cover the text. An empty text gives one row of padding."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - WIDTH + 1) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, 256, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _windows(net: Network, rows: np.ndarray) -> np.ndarray:
    """Embedded bytes of every place's window: chunk * place, WIDTH * EMBED."""
    flat = net.embed[rows].reshape(len(rows), CHUNK * EMBED)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, ::EMBED]
    return view.reshape(-1, WIDTH * EMBED)


def _pooled(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-pooled activations, the places they come from, and the windows."""
    windows = _windows(net, rows)
    acts = (windows @ net.conv).reshape(len(rows), STEP, FILTERS)
    at = acts.argmax(1) if len(rows) else np.zeros((0, FILTERS), int)
    top = np.take_along_axis(acts, at[:, None], 1)[:, 0] + net.conv_bias
    return np.maximum(top, 0), at, windows


def logits(net: Network, rows: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(rows), BATCH):
        windows = _windows(net, rows[i : i + BATCH])
        top = (windows @ net.conv).reshape(-1, STEP, FILTERS).max(1) + net.conv_bias
        hidden = np.maximum(np.maximum(top, 0) @ net.hidden + net.hidden_bias, 0)
        out.append(hidden @ net.out + net.bias)
    return np.concatenate(out)


def _gradients(net: Network, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted log loss, in the order of parts()."""
    pooled, at, windows = _pooled(net, rows)
    before = pooled @ net.hidden + net.hidden_bias
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-(hidden @ net.out + net.bias)))
    d = ((p - label) * weight / weight.sum()).astype(np.float32)
    g_hidden = np.outer(d, net.out) * (before > 0)
    g_pooled = (g_hidden @ net.hidden.T) * (pooled > 0)
    chosen = at + np.arange(len(rows))[:, None] * STEP  # the window that each maximum comes from
    taken = windows[chosen.reshape(-1)].reshape(*chosen.shape, -1)
    g_conv = np.einsum("cf,cfw->wf", g_pooled, taken)
    g_window = g_pooled[:, :, None] * net.conv.T[None]
    g_embed = np.zeros_like(net.embed)
    for k in range(WIDTH):
        bytes_ = np.take_along_axis(rows, at + k, 1)
        np.add.at(g_embed, bytes_.reshape(-1), g_window[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
    return [g_embed, g_conv, g_pooled.sum(0), pooled.T @ g_hidden, g_hidden.sum(0), hidden.T @ d, d.sum(keepdims=True)]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3_000, passes: int = 4, rate: float = 0.003, seed: int = 5, text: str = "text", label: str = "quality", doc_id: str = "doc_id") -> Network:
    """Fit on the texts of docs whose ids labels gives a label of 0 or 1.

    The fit uses a bounded sample: about sample_docs ids, chosen from labels
    by a hash, half of each label as far as there are so many, and every chunk
    of their texts, whatever their length; a text's chunks share its weight.
    The fit runs on the driver and holds twice the sample's bytes. Only the
    chosen ids are sent to the tasks, so no text is shuffled. The two labels
    weigh as they do among all labels. Null texts count as empty. Rows that
    repeat an id, in texts or labels, each bring their pair. Without any row
    of one of the labels the network stays untrained but for its bias.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    net = Network.random(seed)
    n0, n1 = count.get(0, 0), count.get(1, 0)
    net.bias[0] = np.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        return net
    places, share = 10**12, F.lit(0)
    for k, n in count.items():
        share = F.when(F.col("label") == k, min(places, sample_docs * places // (2 * n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(places)) < share)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    some = texts.join(F.broadcast(chosen), "id").select(F.col("id").cast("string").alias("id"), "label", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, t in zip(*(c.to_pylist() for c in batch.columns)):
                c = chunks(t)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([y], pa.int32()), pa.array([len(c)], pa.int32()), pa.array([np.ascontiguousarray(c, "<i2").tobytes()])], names=["id", "label", "n", "chunks"])

    got = sorted(some.mapInArrow(cut, "id string, label int, n int, chunks binary").collect(), key=lambda r: (r.label, r.id))
    if len({r.label for r in got}) < 2:
        return net
    x = np.concatenate([np.frombuffer(r.chunks, "<i2").reshape(-1, CHUNK) for r in got])
    y = np.repeat([r.label for r in got], [r.n for r in got]).astype(np.float32)
    w = np.repeat([1 / r.n for r in got], [r.n for r in got])
    r = np.random.default_rng(seed)
    w = np.where(y == 1, w * n1 / w[y == 1].sum(), w * n0 / w[y == 0].sum())
    parts = net.parts()
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for k in range(passes):
        order = r.permutation(len(x))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            t += 1
            step = rate * (0.3 if k == passes - 1 else 1) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, a, b in zip(parts, _gradients(net, x[pick], y[pick], w[pick]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (step * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def score(docs: DataFrame, net: Network, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with columns score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null texts are scored as empty ones. Input columns of these names are
    replaced, others pass through. Rows are scored one by one, whatever their
    ids, and every chunk of a text of any length counts. An empty table gives
    an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.drop("score", "predicted")
    at = kept.columns.index(text)
    schema = StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sums: list[float] = []
                held: list[np.ndarray] = []
                sizes: list[int] = []

                def out() -> None:
                    each = logits(sent.value, np.concatenate(held))
                    sums.extend((np.add.reduceat(each, np.cumsum([0, *sizes[:-1]])) / sizes).tolist())
                    held.clear()
                    sizes.clear()

                for t in part.column(at).to_pylist():
                    held.append(chunks(t))
                    sizes.append(len(held[-1]))
                    if sum(sizes) >= 4096:
                        out()
                if held:
                    out()
                p = 1 / (1 + np.exp(-np.clip(sums, -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
