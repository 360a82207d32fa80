import numpy as np
import pyarrow as pa

from tidewater.llm import toxicity

INSULTS = ["blockhead", "numskull", "dunderhead", "nitwit", "lowlifeish"]


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abdefgilmnorstu"), rng.integers(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(n):
        word = list(rng.choice(plain, rng.integers(20, 200)))
        toxic = k % 10 == 0
        for _ in range(rng.integers(2, 8) if toxic else 0):
            word.insert(rng.integers(len(word)), str(rng.choice(INSULTS)) + str(rng.choice(["", "s", "like", "."])))
        rows.append((k, " ".join(word), "s", int(toxic)))
    return rows


def test_held_out_accuracy(spark, make_documents):
    rows = corpus(1500)
    docs = make_documents([r[:3] for r in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, _, y in rows if i < 1000], "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.scored(spark, docs, labels).collect()}
    held = [(out[i].toxic, y) for i, _, _, y in rows if i >= 1000]
    assert sum(a != bool(y) for a, y in held) <= 5
    kept = toxicity.keep_clean(spark, docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in out if not out[i].toxic}


def test_severity_grows_with_insults(spark, make_documents):
    rows = corpus(1000)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark, make_documents([r[:3] for r in rows]), labels)
    assert len(model["cuts"]) == 2 and model["cuts"][0] < model["cuts"][1]
    s = toxicity.severities(pa.array(["nice words", "a blockhead", "a blockhead and NITWIT", " ".join(INSULTS), None, ""]), model)
    assert s[0] < s[1] < s[2] < s[3] and s[0] == s[4] == s[5]


def plain_severity(text, model):
    """The docstring's sum for one text, by sets of words and beginnings."""
    import math
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    raw = [w for w in re.split(rb"[^a-z\x80-\xff]+", lower.encode()) if w]

    def code(piece, size=None):
        data = np.frombuffer(piece, np.uint8)
        found = toxicity.word_codes(data, np.array([0]), np.array([len(data)]))
        return int(found[0] if size is None else toxicity.mix(found ^ np.uint64(size))[0])

    have = {code(w) for w in raw} | {code(w[:n], n) for w in raw for n in toxicity.BEGINNINGS if len(w) > n}
    score = sum(float(x) for c, x in zip(model["codes"].tolist(), model["weights"], strict=True) if c in have)
    return sum(1 / (1 + math.exp(-(score - float(c)))) for c in model["cuts"])


def test_severities_by_brute_force(spark, make_documents, odd_rows):
    rows = corpus(800)
    docs = make_documents([r[:3] for r in rows] + [(10_000 + k, t, s) for k, (_, t, s) in enumerate(odd_rows)])
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels)
    assert len(model["codes"]) and len(model["cuts"]) == 2
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.scored(spark, docs, labels).collect():
        assert abs(r.severity - plain_severity(text[r.doc_id], model)) < 1e-9 and r.toxic == (r.severity >= toxicity.REJECT)


def test_fit_is_bounded_and_repeats_count_once(spark, make_documents):
    rows = corpus(400)
    docs = [r[:3] for r in rows]
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    one = toxicity.fit(spark, make_documents(docs), labels)
    # a doc_id that is two thirds of the table, labels that stand twice or belong to nobody
    more = labels.unionAll(labels).unionAll(spark.createDataFrame([(k, k % 2) for k in range(50_000, 60_000)] + [(None, 1)], labels.schema))
    two = toxicity.fit(spark, make_documents(docs + [docs[0]] * 800).repartition(7), more)
    for k in one:
        assert np.array_equal(one[k], two[k]), k
    few = toxicity.fit(spark, make_documents(docs), labels, sample=20)
    assert len(few["codes"]) < len(one["codes"])


def test_gradient_fits_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6)) < 0.3
    score = x @ np.array([2.0, 1.5, -1.0, 0, 0, 3.0]) + rng.logistic(size=2000)
    grade = (score > 1.0).astype(int) + (score > 3.0)
    w, cuts = toxicity.fit_ordinal(*np.nonzero(x), grade, 6)
    assert np.allclose(w, [2.0, 1.5, -1.0, 0, 0, 3.0], atol=0.5) and np.allclose(cuts, [1, 3], atol=0.5)


def test_odd_rows(spark, make_documents, odd_rows):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    docs = make_documents(odd_rows)
    assert toxicity.scored(spark, docs, labels).count() == len(odd_rows)
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.severity for r in toxicity.scored(spark, docs, none).collect()} == {0.0}
        assert toxicity.keep_clean(spark, docs, none).count() == len(odd_rows)
    assert toxicity.scored(spark, make_documents([]), labels).count() == 0
