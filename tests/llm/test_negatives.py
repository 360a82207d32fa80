import math

import numpy as np
import pytest

from tidewater.llm import negatives
from tidewater.llm.queries import QUERIES


def brute(rows, every=100, steps=256, positives=5, count=5, floor=80):
    rows = [(i, y, tuple(math.floor(steps * c) for c in v)) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, a in sorted({r for r in rows if r[0] % every == 0}):
        scored = sorted((-sum(p * q for p, q in zip(a, b)), j, z) for j, z, b in rows if j != i and len(a) == len(b))
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            hard = [s for s in scored if s[2] != y and floor * -p <= 100 * -s[0] <= 100 * -p][:count]
            out += [(i, j, k, m, -p, -n) for k, (n, m, _) in enumerate(hard, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, key string, block int")


def found(spark, rows, **how):
    return sorted(tuple(r) for r in negatives.mine(spark, frame(spark, rows).repartition(6), **how).collect())


def vectors(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    return [(int(k), [float(c) for c in np.round(rng.normal(0, 0.5, dim), 2)], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("block,slices,bytes_", [(2048, 32, 1 << 20), (30, 1, 1 << 20), (40, 2, 200)])
def test_brute_force(spark, monkeypatch, block, slices, bytes_):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SLICE", slices)
    monkeypatch.setattr(negatives, "COMPONENTS", bytes_)
    rows = vectors(400, 8, 1)
    want = brute(rows, every=10)
    assert len(want) > 100 and found(spark, rows, every=10) == want


def test_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 25)
    rng = np.random.default_rng(3)
    # few different vectors: scores tie by the hundred, at the positive's own score too
    rows = [(int(k), [float(x) for x in rng.integers(0, 2, 3)], int(k % 2)) for k in rng.permutation(300)]
    rows += [rows[5]] * 9 + [(400, rows[0][1], 1)] * 4
    want = brute(rows, every=20)
    assert len(want) > 50 and found(spark, rows, every=20) == want


def test_hot_label_and_cluster(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 0.5, 6)
    rows = [(k, [float(x) for x in middle + rng.normal(0, 0.01, 6)], 0 if k % 3 else 1) for k in range(500)]
    assert found(spark, rows, every=50) == brute(rows, every=50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 2), (4, [None, 1.0], 2), (5, [1.0, 0.1], None), (None, [1.0, 0.0], 1), (6, [0.9, 0.0], 1),
            (7, [0.8, 0.3], 2), (8, [0.85, 0.0], 2), (100, [-1.0, 0.0], 3), (9, [0.5, 0.5], 3), (200, [1.0], 1), (201, [1.0], 2), (300, [], 1), (301, [], 1), (302, [], 2),
            (-100, [0.9, 0.1], 2), (400, [1.0, 1.0, 1.0], 5)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == []
    huge = [(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [1e299, 0.0], 2)]
    assert [r[:4] for r in found(spark, huge)] == [(0, 1, 1, 2)]  # both count as the bound


def test_query_moves_labels(spark, tmp_path):
    rows = vectors(300, 6, 5, labels=10)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(i, [float(np.float32(c)) for c in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    assert sorted(tuple(r) for r in QUERIES["op12_negatives"](spark, str(tmp_path)).collect()) == brute(stored)


def test_keys_sort_by_anchor_then_falling_score():
    rows = [(-5, 7, 10, 1, 3), (-5, 7, 10, 0, 9), (-5, 7, -2, 0, 1), (-5, 7, 2**61, 1, 1), (3, 1, 0, 0, -4), (3, 1, 0, 0, 4)]
    made = [negatives.keys([a], [n], [s], k, [i], [0])[0] for a, n, s, k, i in rows]
    assert [negatives.opened(k) for k in sorted(made)] == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
