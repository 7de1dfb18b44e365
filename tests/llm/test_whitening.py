import math

import numpy as np
import pytest

from voxfabric.llm import queries, whitening


def brute(rows, dims, k):
    """x, sums, components by LAPACK on the whole covariance."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], np.int64)
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(1), c @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(got, rows, dims, k, tolerance=1e-7):
    ids, n, deviation, whitened, explained = brute(rows, dims, k)
    table = {}
    for r in got:
        table.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r)
    assert sum(len(x) for v in table.values() for x in v.values()) == len(ids) * k
    signs = np.zeros(k)
    for row, i in enumerate(ids):
        for j in range(k):
            found = table[str(i), int(deviation[row])][j + 1][0]
            assert abs(found.explained - explained[j]) <= 1e-4 * explained[j]
            assert abs(abs(found.whitened) - abs(whitened[row, j])) < tolerance
            if abs(whitened[row, j]) > 1e-3:
                signs[j] = signs[j] or np.sign(found.whitened * whitened[row, j])
                assert np.sign(found.whitened * whitened[row, j]) == signs[j]


def some_rows(seed=1, n=600, dims=24, decay=0.8):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((n, dims)) * 4 * decay ** np.arange(dims))]


BAD = [(-1, None), (-2, [None] * 24), (-3, [float("nan")] + [1.0] * 23), (-4, [float("inf")] + [1.0] * 23), (-5, []), (-6, [1.0, 2.0]), (-7, [-float("inf")] * 24)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component double").repartition(5)


@pytest.mark.parametrize("k", [4, 24])
def test_against_brute_force(spark, k):
    rows = some_rows() + BAD + [(7, some_rows()[7][1]), (None, some_rows()[9][1])] + [(10_000 + i, [0.5] * 24) for i in range(200)]
    d = frame(spark, rows)
    model = whitening.fit(d, components=k)
    compare(whitening.whiten(d, model).collect(), rows, 24, k)
    assert whitening.identity_error(d, model) < 1e-9
    again = whitening.from_json(whitening.to_json(model))
    assert (again.components == model.components).all() and again.sums == model.sums


def test_narrow_basis_suffices_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(2)
    low = rng.standard_normal((500, 3)) * [900, 80, 9]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(low @ rng.standard_normal((3, 40)))]
    d = frame(spark, rows)
    model = whitening.fit(d, components=2, passes=12, tolerance=1e-9)
    assert not model.full
    compare(whitening.whiten(d, model).collect(), rows, 40, 2, 1e-6)
    flat = whitening.fit(frame(spark, some_rows(decay=1.0)), components=4)
    assert flat.full and flat.passes == 4


def test_no_and_few_rows(spark):
    d = frame(spark, BAD[:5])
    for rows in (d, d.where("false"), frame(spark, [(1, [1.0, 2.0])]), frame(spark, [(1, [1.0, 2.0])] * 50)):
        model = whitening.fit(rows)
        assert whitening.whiten(rows, model).collect() == [] and whitening.identity_error(rows, model) is None
    line = frame(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)])
    assert len(whitening.fit(line).values) == 1
    huge = frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])
    found = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert {r.deviation for r in found if r.vec_id != 3} == {None} and all(math.isfinite(r.whitened) for r in found)


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, sf).collect()
    compare(got, rows, 64, 32)
    assert {r.n for r in got} == {len(rows)} and max(r.identity_error for r in got) < 1e-9
