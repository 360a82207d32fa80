import hashlib

import numpy as np

from tidewater.llm import fingerprints
from tidewater.llm.queries import QUERIES


def run(spark, tmp_path, docs):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    return QUERIES["op7_fingerprints"](spark, path).collect()


def expected(rows):
    """(doc_id, n_chars, hash of the edited text) where doc_ids differ or rows are equal."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéü"), rng.integers(1, 12))) for _ in range(500)]
    return [(int(k) * 7, " ".join(rng.choice(words, rng.integers(0, 120))), "s") for k in rng.permutation(n)]


def test_next_and_edited(spark, make_documents, tmp_path):
    rows = texts(400)
    out = run(spark, tmp_path, make_documents(rows).repartition(5))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == expected(rows)
    prints = {}
    text = {i: t for i, t, _ in rows}
    for r in out:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint and len(r.fingerprint) == 8 * fingerprints.SLOTS
        same = sum(r.fingerprint[k:k + 8] == r.edited_fingerprint[k:k + 8] for k in range(0, 8 * fingerprints.SLOTS, 8))
        assert r.near_edited == same / fingerprints.SLOTS and 0 <= r.near_next <= 1


def test_crowded_doc_id_is_split(spark, make_documents, tmp_path):
    rows = [(5, f"text number {k} of the one id", "s") for k in range(300)] + [(k, f"other {k}", "s") for k in range(6, 60)]
    docs = make_documents(rows)
    found = fingerprints.fingerprints(spark, docs).collect()
    nxt = {r.text: r.next_text for r in found}
    seen, at = set(), "other 59"  # the last: its next is the first
    for _ in range(len(rows)):
        at = nxt[at]
        seen.add(at)
    assert len(found) == len(rows) == len(seen) and at == "other 59"


def test_odd_rows(spark, make_documents, odd_rows, tmp_path):
    plain = [r for r in odd_rows if r[0] not in (13, None)]
    out = run(spark, tmp_path / "a", make_documents(plain))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == expected(plain)
    assert len(run(spark, tmp_path / "b", make_documents(odd_rows))) == len(odd_rows)
    one = run(spark, tmp_path / "c", make_documents([(1, "alonehere!", "s")]))
    assert one[0].edited_sha256 == hashlib.sha256(b"alonealone").hexdigest() and one[0].near_next == 1.0
    assert run(spark, tmp_path / "d", make_documents([])) == []


def likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    return df.select(fingerprints.likeness(df.x, df.y)).first()[0]


def test_order_and_repeats_count(spark):
    rng = np.random.default_rng(4)
    w = [f"w{k}" for k in range(200)]
    text = " ".join(w)
    halves = " ".join(w[100:] + w[:100])
    assert likeness(spark, text, text) == 1
    assert likeness(spark, text, halves) < 0.75  # the same k-mers but two, in another order
    near = " ".join(w[:100] + ["new"] + w[100:])
    assert likeness(spark, text, near) > likeness(spark, text, halves) - 0.05 and likeness(spark, text, near) > 0.7
    far = " ".join(rng.permutation(w))
    assert likeness(spark, text, far) < 0.2
    assert likeness(spark, "a b c " * 50, "a b c " * 5) < 1


def test_repeats_among_many_kmers_count(spark):
    rng = np.random.default_rng(5)
    w = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    often = ["same", "old", "line"] * 700  # about as many occurrences as other k-mers, of three codes
    found = likeness(spark, " ".join(w[:1000] + often + w[1000:]), " ".join(w))
    assert found < 0.6, found  # over all k-mers a slot selects none of the repeats in about 1 of 4 cases
    assert likeness(spark, " ".join(w + often), " ".join(w + often[:30])) < 0.6


def test_native(spark, make_documents, odd_rows):
    plan = fingerprints.edited(spark, make_documents(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plain(text):
    """Order MinHash as the docstring says it, by plain loops over every numbered k-mer."""
    import re
    import struct

    import xxhash

    def long(x, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", x), seed % 2**64)

    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in re.findall(f"[^ \t\n\x0b\x0c\r]{{1,{fingerprints.TOKEN}}}", text)]
    seen, numbered = {}, []
    for k in range(len(tokens)):
        code = 42
        for t in tokens[k:k + 3]:
            code = long(t, code)
        code >>= 1
        occurrence = seen[code] = seen.get(code, -1) + 1
        numbered.append(xxhash.xxh64_intdigest(struct.pack("<i", occurrence), long(code, 42)) >> 1)
    out = []
    for m in fingerprints.MODULI:
        values = [e % m for e in numbered]
        two = sorted(range(len(values)), key=values.__getitem__)[:2]
        code = 42
        for k in sorted(two):
            code = long(values[k], code)
        out.append(code & 2**31 - 1)
    return out


def test_equals_plain_order_minhash(spark, odd_rows):
    rng = np.random.default_rng(9)
    texts_ = [t or "" for _, t, _ in odd_rows] + ["", "a", "a b", "a b c", "a a a a a a", "x" * 40, " ".join(f"w{k}" for k in rng.integers(0, 50, 3000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts_)], "k int, text string")
    found = {r.k: r.fp for r in fingerprints.with_fingerprint(df, "text", "fp").collect()}
    for k, t in enumerate(texts_):
        assert found[k] == plain(t), t[:50]


def test_places_among_many_bounds(spark):
    for n in (1, 2, 7, 100):
        bounds = sorted(np.random.default_rng(n).integers(0, 60, n).tolist())
        rows = spark.range(-1, 62).select("id", fingerprints._place(bounds, "id", True).alias("lo"), fingerprints._place(bounds, "id", False).alias("hi")).collect()
        assert [(r.lo, r.hi) for r in rows] == [(sum(b < r.id for b in bounds), sum(b <= r.id for b in bounds)) for r in rows]
