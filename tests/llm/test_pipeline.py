"""The five stages on a small corpus, each held against a brute-force version of its decision."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import compare
from tidewater.llm import packing, secret_scan
from tidewater.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    plain = ["".join(rng.choice(list("abdefgilmnorstu"), rng.integers(2, 9))) for _ in range(4000)]
    insults = ["blockhead", "numskull", "dunderhead", "nitwit"]
    rows, toxic = [], set()
    for k in range(700):
        w = list(rng.choice(plain, rng.integers(30, 160)))
        if k % 9 == 0:
            toxic.add(k)
            for _ in range(6):
                w.insert(rng.integers(len(w)), str(rng.choice(insults)))
        if k % 50 == 7:
            w.insert(5, "password=kX9vQ2mZr7Lw4TbY8nHs")
        rows.append([k, " ".join(w), "en", f"s{k % 4}" if k % 4 else None, 0])
    for k in range(60):  # near copies of clean documents
        w = rows[k * 9 + 4][1].split()
        w[len(w) // 2] = "changed"
        rows.append([1000 + k, " ".join(w), "en", "s1", 0])
    rows += [[2000, "", "en", "s1", 0], [2001, None, None, None, None]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] < 600], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}, toxic


def shingles(t):
    w = (t or "").split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def test_stages(spark, corpus, tmp_path):
    path, rows, toxic = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "packing"]

    def stage(k, docs):
        name, fn = corpus_pipeline.STAGES[k]
        fn(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = stage(0, docs)
    kept = {r.doc_id for r in docs.collect()}
    assert docs.columns == names and len(toxic & kept) <= 2 and len(set(rows) - toxic - kept) <= 2

    docs = stage(1, docs)
    got = {r.doc_id for r in docs.collect()}
    drop, ids = set(), sorted(kept)
    for i in ids:
        if i >= 1000 and i < 2000:
            a = shingles(rows[i][1])
            if any(j < i and 5 * len(a & shingles(rows[j][1])) >= 4 * len(a | shingles(rows[j][1])) for j in ids if j < i):
                drop.add(i)
    assert docs.columns == names and got == kept - drop and len(drop) > 40

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = stage(2, docs)
    assert docs.columns == names
    for r in docs.collect():
        t = before[r.doc_id]
        want = t if t is None else re.sub(r"password=[A-Za-z0-9]+", "[SECRET]", t)
        assert r.text == want and r.n_chars == (None if want is None else len(want))

    counts = Counter(r.source for r in docs.collect() for _ in range(len((r.text or "").split())))
    text = {r.doc_id: r.text for r in docs.collect()}
    docs = stage(3, docs)
    assert docs.columns == names
    took = Counter(r.source for r in docs.collect() for _ in range(len((r.text or "").split())))
    total = sum(counts.values())
    weight = {"s1": 1, "s2": 2, "s3": 3, None: 1}
    for s, w in weight.items():
        assert abs(took[s] - min(3 * counts[s], total * w / 7)) < 200
    assert all(r.text == text[r.doc_id] for r in docs.collect())

    out = stage(4, docs).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r.doc_id, len(plain.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.length) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1 + 1.05 * sum(fill.values()) / 4096


def test_run_is_the_stages(spark, corpus):
    path, _, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 300
    assert not secret_scan.CANDIDATE.search("[SECRET]")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_registered_queries_read_whole_tables(spark, duck, key):
    sf = "/root/testdata/sf0.001"
    out = QUERIES[key](spark, sf)
    table = {"op3": "embeddings", "op11": "embeddings", "op12": "embeddings", "op13": "pages"}.get(key.split("_")[0], "documents")
    source = spark.read.parquet(f"{sf}/{table}.parquet")
    if key == "op12_negatives":  # its rows are those of the anchors: all of them against the SQL
        assert compare(out, ORACLES[key], duck)["ok"]
    else:
        assert out.count() >= source.count()


def test_repeated_rows_and_null_ids(spark, corpus, tmp_path):
    """Rows that stand twice, null doc_ids and sources, null texts, through every stage."""
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.where("doc_id < 120").unionByName(docs.where("doc_id < 120")).unionByName(docs.where("doc_id between 200 and 260").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.where("doc_id = 2001")).unionByName(docs.where("doc_id = 2001"))
    clean = corpus_pipeline.drop_toxic(spark, odd, path)
    assert odd.count() > clean.count() > 0.8 * odd.count()
    once = corpus_pipeline.drop_near_copies(spark, clean, path)
    texts = [r.text for r in once.collect() if r.text]
    assert len(texts) == len(set(texts))  # equal rows are one class
    assert {r.text for r in clean.collect() if r.text and r.doc_id is None} <= set(texts)
    masked = corpus_pipeline.mask_secrets(spark, once, path)
    assert masked.count() == once.count()
    mixed = corpus_pipeline.mix_sources(spark, masked, path)
    assert {r.text for r in mixed.collect()} <= {r.text for r in masked.collect()}
    packed = corpus_pipeline.pack_sequences(spark, mixed, path)
    assert packed.count() >= mixed.count()


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
