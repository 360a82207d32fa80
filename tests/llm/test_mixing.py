import re
from collections import defaultdict
from fractions import Fraction

import pytest

from tidewater.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by the letter: reshare what capped sources leave, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = Fraction(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in fixed else weight[s] * level for s in order}
        fixed |= over


def check(rows, out):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, took = targets(size), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert r["size"] * (r.target // max(1, r.source_size)) <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
    return want, took


def test_odd_rows(spark, make_documents, odd_rows):
    out = mixing.mix(spark, make_documents(odd_rows)).collect()
    check(odd_rows, out)
    assert [r.taken for r in out if not r["size"]] == [0] * sum(not (t or "").split() for _, t, _ in odd_rows)


def test_near_targets_and_reruns(spark, make_documents):
    rows = [(k, "w " * (k % 9 + 1), f"s{min(k % 30, 10):02}" if k % 30 else None) for k in range(3000)]
    docs = make_documents(rows)
    out = mixing.mix(spark, docs).collect()
    want, took = check(rows, out)
    for s in want:
        assert abs(took[s] - want[s]) <= 9
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(spark, docs.repartition(7)).collect()), key=str)


def test_thresholds_nest(spark, make_documents):
    docs = make_documents([(k, "w " * (k % 5 + 1), "ab"[k % 2]) for k in range(400)])
    small = {r.doc_id for r in mixing.mix(spark, docs, weights=(1, 3)).collect() if r.source == "a" and r.copies}
    large = {r.doc_id for r in mixing.mix(spark, docs, weights=(1, 2)).collect() if r.source == "a" and r.copies}
    assert small and small < large


def test_repeated_keeps_columns(spark, make_documents, odd_rows):
    docs = make_documents(odd_rows)
    out, copies = mixing.repeated(spark, docs), mixing.mix(spark, docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in copies.collect())


def test_empty(spark, make_documents):
    docs = make_documents([])
    assert mixing.mix(spark, docs).count() == 0 and mixing.repeated(spark, docs).count() == 0
