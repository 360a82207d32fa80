import numpy as np
import pytest

from tidewater.llm import substrings


def brute(rows):
    """(doc_id, n_words, n_removed, kept) by looking up every window."""
    def key(r):
        return r[0] is None, r[0] or 0

    first = {}
    split = [(i, (t or "").encode().split()) for i, t, _ in sorted(rows, key=key)]
    for i, w in split:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k:k + 20]), (i, k))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] != (i, k):
                gone.update(range(k, k + 20))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def result(spark, docs, **more):
    return sorted(map(tuple, substrings.dedupe(spark, docs, **more).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    shared = [" ".join(rng.choice(vocabulary, rng.integers(15, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [shared[rng.integers(6)] if rng.random() < 0.5 else " ".join(rng.choice(vocabulary, rng.integers(1, 50))) for _ in range(rng.integers(1, 6))]
        rows.append((k * 3 % 101, str(rng.choice([" ", "\n", "\t"])).join(parts), "s"))
    return rows


@pytest.mark.parametrize("limit", [200_000, 3])
def test_brute_force(spark, make_documents, limit):
    rows = passages(limit % 7) + [(500, "the same pair " * 40, "s"), (501, "the same pair " * 35, "s"), (502, "a " * 19, "s"), (503, "a " * 45, "s")]
    assert result(spark, make_documents(rows), group_rows=limit) == brute(rows)


def test_chunks_keep_groups_whole(spark, make_documents, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_ROWS", 5)
    rows = passages(11, 30)
    assert result(spark, make_documents(rows)) == brute(rows)


def test_odd_rows(spark, make_documents, odd_rows):
    # texts of one doc_id are ordered by a hash there: none of them is long enough to matter
    got = result(spark, make_documents(odd_rows))
    want = brute([r for k, r in enumerate(odd_rows) if r not in odd_rows[:k]])
    assert sorted(set(got), key=str) == sorted(set(want), key=str) and len(got) == len(odd_rows)


def test_earliest_stays_and_order_matters(spark, make_documents):
    p = " ".join(f"p{k}" for k in range(25))
    rows = [(9, p, "s"), (2, "x " + p + " y", "s"), (5, p[::-1], "s"), (7, p + " " + p, "s")]
    out = dict((i, t) for i, _, _, t in result(spark, make_documents(rows)))
    assert out == {2: "x " + p + " y", 9: "", 5: p[::-1], 7: ""}


def test_empty(spark, make_documents):
    assert result(spark, make_documents([])) == []


def test_copies_of_a_row_share_their_marks(spark, make_documents, monkeypatch):
    kept, lists = substrings.landed, {}

    def watched(spark, df, name, **options):
        lists[name] = kept(spark, df, name, **options)
        return lists[name]

    monkeypatch.setattr(substrings, "landed", watched)
    text = " ".join(f"word{k}" for k in range(60))
    out = substrings.dedupe(spark, make_documents([(1, text, "a")] + [(2, text, "a")] * 40)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0)] + [(2, 60)] * 40
    for r in lists["substrings-marks"].collect():
        starts = [m.start for m in r.marks]
        assert len(starts) == len(set(starts)), len(starts)
