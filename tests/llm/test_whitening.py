import math

import numpy as np
import pytest

from tidewater.llm import whitening
from tidewater.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<double>, dim string, steps string, n int")


def brute(rows):
    """{(vec_id, dim): (n, deviation, |whitened| per component, explained)} with exact sums and numpy's eigenvectors."""
    good = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in sorted({len(x) for _, x in good} - {0}):
        fit = sorted({x for _, x in good if len(x) == dim})
        n, total = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([(s % n) / n for s in total]) + np.array([s // n for s in total])
        centred = np.array([[n * x - s for x, s in zip(v, total)] for v in fit], float) / n
        v = centred.T @ centred / n
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:16], vectors.T[::-1][:16]
        for i, x in good:
            if len(x) == dim:
                y = np.array([n * c - s for c, s in zip(x, total)], float) / n
                for k, (e, u) in enumerate(zip(values, vectors)):
                    if e > 1e-12 * np.trace(v):
                        out.append((i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, total)), abs(u @ y) / math.sqrt(e), e / np.trace(v)))
        assert mean.shape == (dim,)
    return out


def check(found, rows):
    want = brute(rows)
    assert len(found) == len(want)
    name = lambda r: (str(r[0]), r[1], r[2], r[3], round(abs(r[4]), 6))
    for f, w in zip(sorted(((*r[:4], abs(r[4]), r[5]) for r in found), key=name), sorted(want, key=name)):
        assert f[:4] == w[:4] and f[4] == pytest.approx(w[4], abs=1e-8) and f[5] == pytest.approx(w[5], rel=1e-9)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    scale = np.linspace(2, 0.2, dim)
    return [[float(np.float32(c)) for c in rng.normal(0, scale)] for _ in range(n)]


def test_brute_force(spark):
    rows = [(k, v) for k, v in enumerate(vectors(300, 24, 1))]
    rows += [(1000 + k, rows[3][1]) for k in range(100)]  # copies are fitted once
    out = whitening.whiten(spark, frame(spark, rows).repartition(7)).collect()
    check(out, rows)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    signs = {}
    for r in out:  # one sign for all rows: equal vectors get equal values
        if r.vec_id in (3, 1000, 1050):
            signs.setdefault(r.component, set()).add(r.whitened)
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark, tmp_path):
    rows = [(k, v, k % 3) for k, v in enumerate(vectors(60, 20, 2))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(QUERIES["op11_whitening"](spark, str(tmp_path)).collect(), [(i, v) for i, v, _ in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]), (7, [0.5, -2.0]), (7, [0.5, -2.0]), (None, [3.0, 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, [1.0]), (10, [2.0]), (11, [2.0]), (12, [0.0, 0.0])]
    check(whitening.whiten(spark, frame(spark, rows)).collect(), rows)
    flat = [(k, [1.0 * k, 2.0 * k, 5.0]) for k in range(6)]  # one direction only: one component
    out = whitening.whiten(spark, frame(spark, flat)).collect()
    assert {r.component for r in out} == {1} and len(out) == 6 and out[0].explained == pytest.approx(1)
    assert whitening.whiten(spark, frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(spark, frame(spark, [])).collect() == []
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    out = whitening.whiten(spark, frame(spark, huge)).collect()
    assert out and all(r.deviation is None or r.deviation < 2**63 for r in out)
    assert {r.deviation for r in out if r.vec_id == 1} == {None}


def test_large_offset_keeps_its_digits(spark):
    rows = [(k, [1e6 + (k % 5) / 64, -1e6 + (k % 3) / 64]) for k in range(30)]
    check(whitening.whiten(spark, frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_eigenvectors(n):
    x = np.random.default_rng(n).normal(size=(400, n)) * np.linspace(3, 1, n)
    v = x.T @ x / 400
    values, found = whitening.components(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-13)
    assert np.abs(found @ found.T - np.eye(len(found))).max() < 1e-13
    assert np.abs(found @ v - values[:, None] * found).max() < 1e-13 * values[0] * n


@pytest.mark.parametrize("v", [np.eye(6) * 3, np.diag([5, 5, 5, 1, 0, 0.0]), np.ones((8, 8)), np.kron(np.eye(5), [[2.0, 1], [1, 2]]), np.zeros((4, 4)),
                               np.diag(np.arange(20) * 1e-9 + 1), 1e-30 * np.diag([1.0, 2, 3])])
def test_clusters_and_zeros(v):
    values, found = whitening.components(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-12, atol=1e-14 * max(1e-30, np.abs(v).max()))
    assert np.abs(found @ found.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(found @ v - values[:, None] * found).max() <= 1e-12 * np.abs(v).max()
