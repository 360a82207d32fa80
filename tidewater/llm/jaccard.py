"""Operator 8: n-gram Jaccard join with Bayesian candidate pruning.

A document is its set of five-word shingles.  Equal texts are one representative from
the start.  MinHash bands bring candidates together; inside a bucket, MinHash values are
compared 16 at a time, and a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold (uniform prior, binomial matches) falls below
``TOLERANCE``.  What is left links documents into candidate groups; inside a group every
pair is verified exactly on whole shingle sets.  Large buckets and groups are split into
pairs of blocks, so no task holds more than two blocks and no list of all pairs exists:
a task returns link counts and the edges of a spanning forest.

Defined cases: words are runs of other than ASCII white space, unchanged; a text of one
to four words is one shingle; a text without words (empty, null) links with nothing and
is a class of its own; repeated rows and equal texts are linked with one another; a class
is named by its smallest doc_id (null only if all are null); extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bit_of, bitmap, block_pairs, column, components, forest, groups, landed, maybe, small_batches, text_key
from .textcodes import U, mix, rolling, text_bytes, word_codes, words

SHINGLE = 5
#: Similarity threshold as a fraction.
THRESHOLD = (4, 5)
#: 24 bands of 4 values miss a pair at the threshold with probability 4e-6.
BANDS, ROWS = 24, 4
#: Values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-5
#: Rows of a block of a bucket, and documents of a block of a candidate group.
BUCKET_ROWS, GROUP_ROWS = 1024, 256


def shingles(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each text, text after text, and their n + 1 offsets."""
    data, offsets = text_bytes(texts)
    start, end, doc = words(data, offsets)
    code = word_codes(data, start, end)
    n = len(offsets) - 1
    run = rolling(code, size)
    inside = doc[:len(run)] == doc[size - 1:]
    run, owner = run[inside], doc[:len(run)][inside]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = np.array([rolling(code[a:a + count[d]], int(count[d]))[0] for a, d in zip(first, short, strict=True)], U)
        run, owner = np.concatenate([run, whole]), np.concatenate([owner, short])
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    run, owner = run[fresh], owner[fresh]
    return run, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def signatures(run: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """``values`` MinHash values of 16 bits for each text with shingles (others: zeros)."""
    n = len(offsets) - 1
    out = np.zeros((n, values), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    factors = mix(np.arange(1, values + 1, dtype=U)) | U(1)
    # a few texts at a time, so that the codes stay in cache
    at = 0
    while at < len(full):
        to = at + 1
        while to < len(full) and offsets[full[to] + 1] - offsets[full[at]] < 30_000:
            to += 1
        rows = full[at:to]
        part = run[offsets[rows[0]]:offsets[rows[-1] + 1]]
        heads = offsets[rows] - offsets[rows[0]]
        for k, f in enumerate(factors):
            out[rows, k] = (mix(np.minimum.reduceat(part * f, heads)) >> U(48)).astype(np.uint16)
        at = to
    return out


def needed(values: int, threshold: float, tolerance: float) -> dict[int, int]:
    """Fewest matches among the first n values at which a pair is still worth comparing."""
    out = {}
    for n in range(STEP, values + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(similarity >= t | m of n match), uniform prior
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def likely_links(sig: np.ndarray, need: dict[int, int]) -> list[tuple[int, int]]:
    """Forest edges that connect the rows exactly as all unpruned pairs would."""
    edges, left = [], np.arange(1, len(sig))
    todo = [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        one = todo.pop()
        near, match = left, np.zeros(len(left), np.int64)
        for n, least in need.items():
            match = match + (sig[near, n - STEP:n] == sig[one, n - STEP:n]).sum(1)
            alive = match >= least
            near, match = near[alive], match[alive]
            if not len(near):
                break
        if len(near):
            edges += [(one, int(k)) for k in near]
            todo += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def exact_links(run: np.ndarray, offsets: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    code, where, count = np.unique(run, return_inverse=True, return_counts=True)
    shared = count[where] > 1
    place = np.cumsum(count > 1) - 1
    col, row = place[where[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((n, n))
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[row[i:j], col[i:j] - a] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    linked = (both * threshold[1] >= union * threshold[0]) & (size[:, None] > 0)
    np.fill_diagonal(linked, False)
    return linked


def distinct_texts(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per distinct text: key, doc_id (smallest), copies, repeats (rows with that
    doc_id), n_shingles, sig."""
    small_batches(spark)
    values = BANDS * ROWS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, offsets = shingles(batch.column(2))
            sig = signatures(run, offsets, values)
            raw = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * 2 * values).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), raw],
                                             ["doc_id", "key", "n_shingles", "sig"])

    text = F.coalesce(column(documents, "text"), F.lit(""))
    rows = documents.select(column(documents, "doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.mapInArrow(task, "doc_id long, key binary, n_shingles long, sig binary")
    one_each = rows.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    texts = one_each.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("copies"), F.max("n").alias("repeats"),
                                        F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return landed(spark, texts, "jaccard-texts")


def candidate_edges(spark: SparkSession, texts: DataFrame, need: dict[int, int]) -> DataFrame:
    """Forest edges (a, b) over text keys that the bands propose and the posterior keeps."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, -1)
            code = sig.view("<u8").reshape(n, -1)[:, :BANDS]  # four values of 16 bits
            code = mix(code ^ (np.arange(BANDS, dtype=U) << U(58))) + np.arange(BANDS, dtype=U)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))], ["band", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, ["band", "pi", "pj"]):
            keys = g.column("key").to_pylist()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(len(keys), -1)
            for i, j in likely_links(sig, need):
                a.append(keys[i])
                b.append(keys[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    full = texts.where("n_shingles > 0")
    rows = full.select("key", "sig").mapInArrow(bands, "band long, key binary")
    crowded = landed(spark, rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-crowded")
    rows = rows.join(crowded, "band").join(full.select("key", "sig"), "key")
    rows = block_pairs(rows, F.col("n"), BUCKET_ROWS, F.col("key")).select("band", "pi", "pj", "key", "sig")
    sort = ["band", "pi", "pj", "key"]
    return rows.repartition("band", "pi", "pj").sortWithinPartitions(*sort).mapInArrow(compare, "a binary, b binary").distinct()


def verified(spark: SparkSession, documents: DataFrame, texts: DataFrame, near: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows (key, up, links): a linked text, the next text towards its component's first
    (or null), and how many rows of other texts it links with, block pair by block pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["root", "pi", "pj"]):
            blk = g.column("blk").to_numpy()
            linked = exact_links(*shingles(g.column("text")), threshold)
            if g.column("pi")[0].as_py() != g.column("pj")[0].as_py():
                linked &= blk[:, None] != blk[None, :]
            links = linked @ g.column("copies").to_numpy()
            parent = forest(linked)
            keys = np.array(g.column("key").to_pylist(), object)
            hit = np.flatnonzero(links)
            up = [keys[p] if p != k else None for k, p in zip(hit, parent[hit], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit], pa.binary()), pa.array(up, pa.binary()), pa.array(links[hit], pa.int64())],
                                             ["key", "up", "links"])

    near = landed(spark, near, "jaccard-members")
    sizes = landed(spark, near.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "jaccard-sizes")
    near = landed(spark, near.join(sizes, "root").withColumnRenamed("node", "key")
                  .join(texts.select("key", F.col("doc_id").alias("first"), "copies"), "key"), "jaccard-near")
    held = bitmap(spark, near.select(bit_of("key").alias("bit")))
    text = F.coalesce(column(documents, "text"), F.lit(""))
    rows = documents.select(column(documents, "doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.where(maybe(held, bit_of("key")))
    # one row per text: the representative's, once however often that row is repeated
    rows = rows.join(near, "key").where("doc_id <=> first")
    many = near.join(texts.where("repeats > 1").select("key"), "key", "left_semi").limit(1).count()
    if many:
        rows = rows.dropDuplicates(["key"])
    rows = block_pairs(rows, F.col("n"), GROUP_ROWS, F.col("key")).select("root", "pi", "pj", "blk", "key", "copies", "text")
    return (rows.repartition("root", "pi", "pj").sortWithinPartitions("root", "pi", "pj", "key")
            .mapInArrow(compare, "key binary, up binary, links long"))


def classes(spark: SparkSession, documents: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per distinct text: key, doc_id (smallest), class_id, keeper (key of the text that
    stands for the class), n_links, copies, repeats, n_shingles."""
    texts = distinct_texts(spark, documents)
    need = needed(BANDS * ROWS, threshold[0] / threshold[1], TOLERANCE)
    edges = landed(spark, candidate_edges(spark, texts, need), "jaccard-candidates")
    near = components(spark, edges, "jaccard-groups")
    links = landed(spark, verified(spark, documents, texts, near, threshold), "jaccard-links")
    named = components(spark, links.where("up is not null").select(F.col("key").alias("a"), F.col("up").alias("b")), "jaccard-classes")
    named = landed(spark, named.withColumnRenamed("node", "key").join(texts.select("key", "doc_id"), "key"), "jaccard-named")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key").alias("keeper"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(place)["keeper"].alias("keeper"))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    out = (texts.drop("sig").join(named.select("key", "root").join(least, "root").select("key", "class_id", "keeper"), "key", "left")
           .join(counted, "key", "left"))
    empty = F.col("n_shingles") == 0
    return out.select("key", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("keeper", "key").alias("keeper"),
                      F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
                      "copies", "repeats", "n_shingles")


def near_duplicates(spark: SparkSession, documents: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``documents``."""
    found = landed(spark, classes(spark, documents, threshold), "jaccard-result")
    rows = documents.select(column(documents, "doc_id").cast("long").alias("doc_id"),
                            text_key(F.coalesce(column(documents, "text"), F.lit(""))).alias("key"))
    out = rows.join(found.drop("doc_id"), "key")
    return out.select("doc_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def keep_one(spark: SparkSession, documents: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents without all but one row, that of the smallest doc_id, of each class;
    columns unchanged.  Only rows that may go are joined with the result, the others pass by."""
    found = landed(spark, classes(spark, documents, threshold).where("n_links > 0"), "jaccard-result")
    held = bitmap(spark, found.select(bit_of("key").alias("bit")))
    key = text_key(F.coalesce(column(documents, "text"), F.lit("")))
    rows = documents.withColumn("__key", key).withColumn("__maybe", maybe(held, bit_of("__key")))
    marks = found.select(F.col("key").alias("__key"), F.col("doc_id").alias("__first"), F.col("keeper").alias("__keeper"), F.col("repeats").alias("__repeats"))
    hit = rows.where("__maybe").join(marks, "__key", "left")
    kept = hit.where(F.col("__keeper").isNull() | (F.col("__keeper") == F.col("__key")) & column(hit, "doc_id").eqNullSafe(F.col("__first")))
    if found.where("repeats > 1").limit(1).count():
        once = kept.where("__repeats > 1").dropDuplicates(["__key"])
        kept = kept.where("__repeats is null or __repeats = 1").unionByName(once)
    names = [F.col(f"`{c}`") for c in documents.columns]
    return rows.where("not __maybe").select(*names).unionByName(kept.select(*names))
