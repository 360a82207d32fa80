from collections import Counter

import numpy as np
import pytest

from tidewater.llm import jaccard


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, n = [shingles(t) for _, t, _ in rows], len(rows)
    links, parent = [0] * n, list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k in range(n):
        i = rows[k][0]
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((rows[k][0], least.get(root(k)), links[k]) for k in range(n)), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(n):
        if k and rng.random() < 0.6:
            w = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 6)):
                at = rng.integers(len(w))
                w[at:at + rng.integers(0, 2)] = [str(rng.choice(words))]
        else:
            w = list(rng.choice(words, rng.integers(3, 150)))
        rows.append((k * 11 % 1009, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("blocks", [None, (8, 4)])
def test_brute_force(spark, make_documents, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(jaccard, "BUCKET_ROWS", blocks[0])
        monkeypatch.setattr(jaccard, "GROUP_ROWS", blocks[1])
    rows = corpus(250, 5)
    out = sorted(map(tuple, jaccard.near_duplicates(spark, make_documents(rows)).collect()), key=str)
    assert out == brute(rows)


def test_odd_rows(spark, make_documents, odd_rows):
    out = sorted(map(tuple, jaccard.near_duplicates(spark, make_documents(odd_rows)).collect()), key=str)
    assert out == brute(odd_rows)


def test_keep_one(spark, make_documents, odd_rows):
    rows = odd_rows + [(i + 2000, t, s) for i, t, s in corpus(80, 9)]
    docs = make_documents(rows)
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    # one row of each class of several, all rows without words
    want = Counter()
    done = set()
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        if not sets[k]:
            want[rows[k][:2]] += 1
        elif root(k) not in done:
            done.add(root(k))
            want[rows[k][:2]] += 1
    assert got == want


def test_posterior_bound():
    need = jaccard.needed(96, 0.8, 1e-5)
    assert sorted(need) == [16, 32, 48, 64, 80, 96] and all(need[a] <= need[b] for a, b in zip(sorted(need), sorted(need)[1:], strict=False))
    rng = np.random.default_rng(3)
    hits = rng.random((20_000, 96)) < 0.8  # pairs at the threshold
    alive = np.ones(20_000, bool)
    for n, m in need.items():
        alive &= hits[:, :n].sum(1) >= m
    assert alive.mean() > 0.999
    for n, m in need.items():
        assert m > 0.4 * n or n == 16


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.05


def test_empty(spark, make_documents):
    assert jaccard.near_duplicates(spark, make_documents([])).count() == 0
    assert jaccard.keep_one(spark, make_documents([])).count() == 0
