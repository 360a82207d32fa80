import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Model:
    """The same model from dictionaries."""

    def __init__(self, rows):
        self.one, self.two, self.before, after = Counter(), Counter(), Counter(), defaultdict(list)
        for i, t, _ in rows:
            if not held_out(i):
                w = tokens(t)
                self.one.update(w)
                self.two.update(zip(["<s>", *w], w, strict=False))
                self.before.update(["<s>", *w[:-1]])
        self.n, self.z = sum(self.one.values()), sum(self.one.values()) + 0.1 * (len(self.one) + 1)
        of = Counter(self.two.values())
        self.d = katz.discounts(np.array([0, *(of[r] for r in range(1, 7))], float))
        for (a, b), r in self.two.items():
            after[a].append((b, r))
        self.alpha = {a: (1 - sum(self.discounted(r) for _, r in x) / self.before[a]) / (1 - sum(self.lower(b) for b, _ in x)) for a, x in after.items()}

    def discounted(self, r):
        return (self.d[r] if r <= katz.DISCOUNTED else katz.LARGE) * r

    def lower(self, b):
        return (self.one[b] + 0.1) / self.z

    def p(self, a, b):
        r = self.two.get((a, b), 0)
        return self.discounted(r) / self.before[a] if r else self.alpha.get(a, 1) * self.lower(b)


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def tokens(t):
    return [w.decode() for w in (t or "").translate(LOWER).encode().split()] + ["</s>"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"{'W' if k % 3 else 'w'}ord{k}" for k in range(400)]
    p = 1 / np.arange(1, 401)
    return [(k, " ".join(rng.choice(words, rng.integers(0, 120), p=p / p.sum())), "s") for k in range(n)]


def check(spark, make_documents, rows):
    model = Model(rows)
    out = katz.score(spark, make_documents(rows)).collect()
    assert len(out) == len(rows)
    got, want = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for i, t, _ in rows:
        w = tokens(t)
        want[i].append((held_out(i), len(w), sum(model.one[x] > 0 for x in w), model.n, sum(math.log10(model.lower(x)) for x in w),
                        sum(math.log10(model.p(a, b)) for a, b in zip(["<s>", *w], w, strict=False))))
    assert got.keys() == want.keys()
    for i in want:
        for g, e in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert g[:4] == e[:4] and g[4] == pytest.approx(e[4], abs=1e-9, rel=1e-11) and g[5] == pytest.approx(e[5], abs=1e-9, rel=1e-11)
    return model, out


def test_brute_force(spark, make_documents):
    model, out = check(spark, make_documents, corpus(400, 2))
    held = [r for r in out if r.held_out]
    assert held and all(sum(model.p(a, b) for b in model.one) + model.alpha[a] * 0.1 / model.z == pytest.approx(1) for a in list(model.alpha)[:20])


def test_many_blocks_and_split_words(spark, make_documents, monkeypatch):
    for name, value in (("BLOCK_TOKENS", 500), ("HOT", 1 / 60), ("VERY_HOT", 1 / 30), ("COMMON", 20)):
        monkeypatch.setattr(katz, name, value)
    check(spark, make_documents, corpus(300, 4))


def test_held_out_text_is_better_than_the_base(spark, make_documents):
    rng = np.random.default_rng(1)
    phrases = [" ".join(rng.choice([f"v{k}" for k in range(200)], 8)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(phrases, 12)), "s") for k in range(300)]
    _, out = check(spark, make_documents, rows)
    assert sum(r.score for r in out if r.held_out) > 0.5 * sum(r.base_score for r in out if r.held_out)


def test_odd_rows(spark, make_documents, odd_rows):
    check(spark, make_documents, odd_rows)
    check(spark, make_documents, [(i, t, s) for i, t, s in odd_rows if held_out(i)])  # no training documents
    assert katz.score(spark, make_documents([])).count() == 0


def test_texts_are_scored_from_the_tables(spark, make_documents, odd_rows, tmp_path, monkeypatch):
    for name, value in (("BLOCK_TOKENS", 700), ("HOT", 1 / 60), ("VERY_HOT", 1 / 30), ("COMMON", 20)):
        monkeypatch.setattr(katz, name, value)
    rows, path = corpus(200, 6) + [(i, t, s) for i, t, s in odd_rows if i is not None], str(tmp_path / "model")
    katz.score(spark, make_documents(rows), path, complete=True).collect()
    model = Model(rows)
    words, grams, weights = katz.tables(spark, path)
    assert sorted(r.n for r in words.collect()) == sorted(model.one.values())
    assert sorted(r.n for r in grams.collect()) == sorted(model.two.values())
    assert sorted(round(r.alpha, 9) for r in weights.collect()) == sorted(round(a, 9) for a in model.alpha.values())
    new = [(1, "word1 word2 nobody's WORD2 word1", "s"), (2, None, "s"), (3, "", "s"), (4, "brand new words only", "s"), (5, rows[3][1], "s"), (5, rows[3][1], "s"), (None, "word7", "s")]
    out = katz.score_texts(spark, path, make_documents(new)).collect()
    want = [(i, len(tokens(t)), sum(math.log10(model.p(a, b)) for a, b in zip(["<s>", *tokens(t)], tokens(t), strict=False))) for i, t, _ in new]
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for g, e in zip(sorted(map(tuple, out), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2], abs=1e-9, rel=1e-11)


def test_rows_follow_the_tokens(spark, make_documents, tmp_path):
    """What partitions send each other is bounded by bigrams and tokens, not by partitions squared."""
    rows = corpus(600, 8)
    docs, model, n = make_documents(rows), Model(rows), sum(len(tokens(t)) for _, t, _ in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (8, 100):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            path = str(tmp_path / f"m{parts}")
            katz.score(spark, docs, path, complete=True).collect()
            sent = spark.read.parquet(path).where(f"kind in ({katz.SUMS}, {katz.BACKOFF}, {katz.UNSEEN})").select("kind", "key", "raw").collect()
            size = {k: [len(katz.unpack(r.raw)[0]) for r in sent if r.kind == k] for k in (katz.SUMS, katz.BACKOFF)}
            assert sum(size[katz.SUMS]) <= n and min(size[katz.SUMS]) > 0
            assert sum(size[katz.BACKOFF]) <= len(model.two) and min(size[katz.BACKOFF]) > 0
            assert sum(r.key == katz.SPLIT for r in sent) <= parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packing_arrays():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0), np.array([True, False]), np.array([2**63], np.uint64)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
