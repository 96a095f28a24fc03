import math
from fractions import Fraction

import numpy as np
import pytest

from iotrail.llm import entry, whitening


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, q string").repartition(3)


def whitened(spark, rows):
    points = whitening.whole(frame(spark, rows))
    return whitening.apply(points, whitening.fit(points)).collect()


def brute(rows):
    """x vectors, sums, n and V in exact arithmetic."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    total = [sum(v[k] for v in fit) for k in range(d)]
    v = [[float(sum((Fraction(p[i]) - Fraction(total[i], n)) * (Fraction(p[j]) - Fraction(total[j], n)) for p in fit) / n) for j in range(d)] for i in range(d)]
    return x, n, total, np.array(v)


def test_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)] + [(100, [0.5] * 5), (101, [0.5] * 5), (101, [0.5] * 5), (102, [0.5] * 5)]
    got = whitened(spark, rows)
    x, n, total, v = brute(rows)
    assert len(got) == len(rows) * 5
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    for r in got:
        assert r.n == n and int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], total))
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-12)
        want = (np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x[r.vec_id], total)]) @ vectors[:, r.component - 1]) / math.sqrt(e[r.component - 1])
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-10)
        assert r.identity_error < 1e-12
    one = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(one[100, k] == one[102, k] for k in range(1, 6))


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [0.5, 0.25]), (None, [0.5, 0.25]), (9, [3e38, 0.0]), (1, [0.0, 1.0])]
    got = whitened(spark, rows)
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in got} == {3}


def test_without_variance(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    flat = whitened(spark, [(k, [float(k), float(k), 1.0]) for k in range(10)])  # rank 1
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def _wrong(v, e, x):
    size = np.abs(v).max()
    wide = v.astype(np.longdouble)
    residual = np.abs(wide @ x.astype(np.longdouble) - x.astype(np.longdouble) * e.astype(np.longdouble)).max()
    return float(residual / size), float(np.abs(x.T.astype(np.longdouble) @ x.astype(np.longdouble) - np.eye(len(v))).max())


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-13, 0])
def test_clustered_eigenvalues(gap):
    """Close and equal eigenvalues: residuals and orthogonality at double precision, and where a gap can be told apart from
    the rounding of the matrix itself, the very vectors."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    values = np.array([*(5 + gap * k for k in range(6)), *(2 + gap * k for k in range(4)), *np.linspace(0.1, 1, 14)])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.refine(v)
    assert (np.diff(e) <= 0).all()
    residual, askew = _wrong(v, e, x)
    assert residual < 1e-15 and askew < 2e-15
    assert np.abs(np.sort(values)[::-1] - e).max() < 1e-14


def test_better_than_float32_and_scales():
    rng = np.random.default_rng(4)
    for size in (1, 2, 64):
        for scale in (1e-200, 1.0, 1e200):
            m = rng.normal(size=(size, 3 * size))
            v = m @ m.T * scale
            e, x = whitening.refine((v + v.T) / 2)
            residual, askew = _wrong((v + v.T) / 2, e, x)
            assert residual < 1e-14 and askew < 1e-15


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(10**9, [5 * 10**12] * 3, np.ones(0), np.zeros((3, 0)), np.ones(0), 0.0)
    q = np.array([[1 << 30, -(1 << 40), 7]])
    assert model.deviation(q) == [sum((10**9 * int(a) - 5 * 10**12) ** 2 for a in q[0])]


def test_query(spark):
    got = entry.queries()["op11_whitening"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == rows * 16 and got.first().identity_error < 1e-10
