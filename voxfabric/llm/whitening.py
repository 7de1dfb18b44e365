"""Embedding whitening: principal components by a randomised range finder, then rows projected and scaled.

A random basis, wider than the components asked for, is multiplied by the
covariance in passes over all centred rows. After each pass the Rayleigh-Ritz
components in the basis are held against their residuals; if these fail after
the last pass, the basis is extended to the full dimension, where they are
exact. What a pass gathers is one number per dimension and basis vector from
each task, summed by Spark; the driver holds matrices of the dimension only.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Larger numbers of steps, either sign, count as this many.
MOST = 1 << 45
#: Rows held as doubles at a time.
ROWS = 4096


@dataclass
class Model:
    """n rows, per-dimension sums, unit components (rows), their eigenvalues, the covariance's trace; passes over the rows, and whether the full dimension was needed."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    full: bool


def _vectors(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their x, where all entries are finite and dims in number."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            lists = rows.column(column)
            size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(size == dims)
            if not len(right):
                continue
            rows = rows.take(pa.array(right))
            c = rows.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.flatnonzero(np.isfinite(c).all(1))  # nulls have become NaN
            if len(fine):
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(STEPS * c[fine]), -MOST, MOST).astype(np.int64) + SHIFT
                yield rows.take(pa.array(fine)), x


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums/n: whole parts are exact, one rounding follows."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([s % n for s in sums], np.float64) / n


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sums)^2, exact; null where it exceeds a long."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    far = x - base
    if x.shape[1] * (n * (int(np.abs(far).max()) + 1)) ** 2 < 1 << 63:
        return ((n * far - rest) ** 2).sum(1).tolist()
    found = [sum((n * a - int(b)) ** 2 for a, b in zip(row, rest.tolist())) for row in far.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def _summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices given as rows (at, value)."""
    entries = rows.select("at", F.posexplode("value").alias("j", "v")).groupBy("at", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in entries.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("value")).collect():
        out[r[0]] = r[1]
    return out


def _pass(vectors: DataFrame, n: int, sums: list[int], right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred rows times the matrix right; with left, left-transposed times that."""
    dims, shape = len(sums), (right.shape[1] if left is not None else len(sums), right.shape[1])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _vectors(batches, 0, dims):
            c = _centred(x, n, sums)
            total += (c if left is None else c @ left).T @ (c @ right)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "value"])

    return _summed(vectors.mapInArrow(multiply, "at int, value array<double>"), shape) / n


def fit(rows: DataFrame, components: int = 32, oversample: int = 8, passes: int = 3, tolerance: float = 1e-13, seed: int = 13, vector: str = "embedding") -> Model:
    """Components of the rows' covariance, by falling eigenvalue.

    Rows whose vector is null, holds null or non-finite entries or is empty
    are no part of it, nor are vectors of another length than most have (of
    equally frequent lengths, the longest). Components whose eigenvalue isn't
    above rounding (such as all, of one row or of equal rows) are left out, so
    there may be fewer than asked for, or none. Repeated rows count as often.
    Entries beyond MOST steps count as MOST. passes: products with the
    covariance before the basis is extended to the full dimension if a
    residual exceeds tolerance times the largest eigenvalue.
    """
    vectors = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    length = F.size("vector")
    lengths = vectors.where(finite & (length > 0)).groupBy(length.alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0, False)
    dims, n = lengths

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)  # apart, so that no sum leaves 64 bits
        for _, x in _vectors(batches, 0, dims):
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = vectors.mapInArrow(add, "at int, high long, low long").groupBy("at").agg(exact("high").alias("high"), exact("low").alias("low")).collect()
    sums = [0] * dims
    for r in found:
        sums[r.at] = (int(r.high) << 32) + int(r.low)

    width = min(dims, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    k, done = min(components, dims), 0
    while True:
        image = _pass(vectors, n, sums, basis)
        done += 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn
        residual = np.linalg.norm(image @ turn[:, :k] - ritz[:, :k] * values[:k], axis=0)
        full = basis.shape[1] == dims
        if full or residual.max() <= tolerance * max(values[0], 0):
            break
        if done < passes:
            basis = np.linalg.qr(image)[0]
        else:  # the directions found so far, and all others
            basis = np.linalg.qr(np.hstack([ritz, np.random.default_rng(seed + 1).standard_normal((dims, dims - width))]))[0]
    trace = float(np.trace(small)) if full else _trace(vectors, n, sums)
    above = values[:k] > dims * np.finfo(float).eps * max(values[0], 0)
    found = ritz[:, :k][:, above].T
    found = found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found
    return Model(n, sums, found, values[:k][above], trace, done, full)


def _trace(vectors: DataFrame, n: int, sums: list[int]) -> float:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((float((_centred(x, n, sums) ** 2).sum()) for _, x in _vectors(batches, 0, len(sums))), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["total"])

    return vectors.mapInArrow(add, "total double").agg(F.sum("total")).first()[0] / n


def identity_error(rows: DataFrame, model: Model, vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; null without components."""
    if not len(model.values):
        return None
    whitener = (model.components / np.sqrt(model.values)[:, None]).T
    vectors = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return float(np.abs(_pass(vectors, model.n, model.sums, whitener, whitener) - np.eye(len(model.values))).max())


def whiten(rows: DataFrame, model: Model, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, deviation, whitened, explained: one row per remaining row and component.

    component counts from 1; deviation is the row's sum of (n * x - sums)^2,
    null beyond a long; whitened its projection over the square root of the
    eigenvalue; explained the eigenvalue over the trace. Rows that the fit
    leaves out have none; rows that repeat an id have their own; further
    columns are ignored, whatever their names. Empty tables, and models
    without components, give an empty result.
    """
    kind, n, sums, dims, k = rows.schema[vec_id].dataType.simpleString(), model.n, model.sums, len(model.sums), len(model.values)
    whitener = (model.components / np.sqrt(model.values)[:, None]).T if k else None
    explained = model.values / model.trace if k else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, x in _vectors(batches, 1, dims):
            w = _centred(x, n, sums) @ whitener
            at = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_deviation(x, n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [found.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x)))],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    picked = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    schema = f"vec_id {kind}, component int, deviation long, whitened double, explained double"
    return picked.mapInArrow(project, schema) if k else rows.sparkSession.createDataFrame([], schema)


def to_json(model: Model) -> str:
    """The model as text; arrays as their bytes."""
    put = lambda a: [base64.b64encode(np.ascontiguousarray(a, "<f8").tobytes()).decode(), list(a.shape)]
    return json.dumps({"n": model.n, "sums": model.sums, "components": put(model.components), "values": put(model.values), "trace": model.trace, "passes": model.passes, "full": model.full})


def from_json(text: str) -> Model:
    x = json.loads(text)
    get = lambda a: np.frombuffer(base64.b64decode(a[0]), "<f8").reshape(a[1])
    return Model(**x | {"components": get(x["components"]), "values": get(x["values"])})
