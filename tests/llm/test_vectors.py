import math

import numpy as np
import pytest

from tidewater.llm import vectors


def brute(rows):
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= vectors.THRESHOLD:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for k in range(n):
        i = rows[k][0]
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((rows[k][0], links[k], least.get(root(k))) for k in range(n)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<float>, key string, code string, links int")


def result(spark, rows):
    out = vectors.near_duplicates(spark, frame(spark, rows)).collect()
    for r in out:
        assert r.kept == (r.vec_id == r.component_id)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0.0, 0.02, 0.035, 0.05]), 24)
        else:
            v = rng.normal(0, 0.2, 24)
        rows.append((k, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("block,small,chunk", [(512, 24, 4096), (16, 2, 50)])
def test_brute_force(spark, monkeypatch, block, small, chunk):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "SMALL", small)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
    rows = clustered(400, 7)
    rows += [(1000 + k, rows[3][1]) for k in range(30)]  # copies
    assert result(spark, rows) == brute(rows)


def test_hot_bucket_is_held_by_pairs_of_blocks(spark, monkeypatch):
    whole, batch, block = vectors.whole_groups, 50, 16

    def watched(batches, keys, rows):
        for table in whole(batches, keys, rows):
            assert table.num_rows <= rows + batch + 6 * block, f"{table.num_rows} rows at once"
            yield table

    monkeypatch.setattr(vectors, "whole_groups", watched)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 50)
    monkeypatch.setattr("tidewater.llm.shared.ARROW_ROWS", batch)
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.2, 24)
    rows = [(k, [float(np.float32(x)) for x in middle + rng.normal(0, 1e-4, 24)]) for k in range(300)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (8, [2.0, 2.0]), (None, [1.0, 1.01]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, -1.0]), (11, [1.0]), (12, [5.0]),
            (None, [-1.0, 1.0]), (13, [1e-30, 1e-30])]
    assert result(spark, rows) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 64))
    x[30:] = x[:30] + 0.3 * rng.standard_normal((30, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    miss = []
    for seed in range(20):
        turned = np.concatenate([np.linalg.qr(np.random.default_rng([seed, k]).standard_normal((64, 64)))[0] for k in range(4)])
        packed, factors = vectors.encode(x, turned)
        weight, turn, error = vectors.sides(packed, factors, x, turned)
        miss.append((weight @ turn.T - unit @ unit.T) / error[:, None])
    miss = np.array(miss)
    off = ~np.eye(60, dtype=bool)
    assert abs(miss[:, off].mean()) < 0.05 and (np.abs(miss[:, off]) > vectors.SURE).mean() < 1e-4


def test_plan_misses_little():
    for n in (10, 1000, 10**6, 10**9):
        bits, bands = vectors.band_plan(n, 0.95)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - agree) ** bands <= vectors.MISS


def test_empty(spark):
    assert vectors.near_duplicates(spark, frame(spark, [])).count() == 0
