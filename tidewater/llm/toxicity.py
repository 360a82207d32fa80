"""Operator 2: toxicity by cumulative-link ordinal regression.

A document's severity grade 0 < 1 < ... < K - 1 follows P(grade <= k) = s(cut_k - w . x): one
weight per word shared by all ordered cuts.  x is sparse: which of the model's words and word
beginnings occur in the whole text (ASCII lower case, letters only).  The output is the expected severity,
the sum over k of P(grade > k).

Grades come from a label column.  Where labels say only 0 or 1, ``graded`` splits the 1s
by how many marker words they hold (words that tell the labels apart), so that the model
still learns an order.  The model is fitted by one task on at most ``SAMPLE`` labelled documents
of each label, drawn by a hash from the doc_ids that have both a label and a document; it has
one weight per selected word of that sample, so weights and cuts are of bounded size and
travel with the scoring tasks.

Defined cases: a null or empty text has no words and gets the severity of the cuts alone; a
null label, a null doc_id or a label without document isn't used; a doc_id counts once in the
fit, by its highest label and, of several texts, by the one with the smallest hash; without labelled rows of both kinds every severity is 0; extra columns stay; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, landed, small_batches
from .textcodes import U, lower_ascii, mix, text_bytes, word_codes, words

#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 4000
#: Bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 3
#: A word enters the model if the labels tell it apart by so many standard errors.
APART = 5.0
#: Expected severity from which a document counts as toxic.
REJECT = 0.5
RIDGE, ROUNDS, RATE = 1e-4, 500, 0.1


def feature_codes(texts) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of every letter-only word and of its beginnings, the text each belongs to, and
    the number of texts.  Beginnings let an inflected or compounded insult count."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    letters = (data >= 128) | ((data >= 97) & (data <= 122))
    start, end, doc = words(np.where(letters, data, np.uint8(32)), offsets)
    codes, owners = [word_codes(data, start, end)], [doc]
    for size in BEGINNINGS:
        long = end - start > size
        codes.append(mix(word_codes(data, start[long], start[long] + size) ^ U(size)))
        owners.append(doc[long])
    return np.concatenate(codes), np.concatenate(owners), len(offsets) - 1


def distinct(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (owner, code) once, by owner."""
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[fresh], owner[fresh]


def telling_words(code: np.ndarray, owner: np.ndarray, label: np.ndarray, apart: float) -> np.ndarray:
    """Codes of the words whose document share under label > 0 exceeds that under label 0
    by more than ``apart`` standard errors."""
    found, where = np.unique(code, return_inverse=True)
    n1, n0 = (label > 0).sum(), (label == 0).sum()
    in1 = np.bincount(where, label[owner] > 0, len(found))
    in0 = np.bincount(where, label[owner] == 0, len(found))
    share = (in1 + in0 + 1) / (n1 + n0 + 2)
    return found[(in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) > apart]


def graded(label: np.ndarray, markers: np.ndarray, grades: int) -> np.ndarray:
    """0/1 labels as grades: the 1s are split evenly by their number of marker words."""
    grade = np.zeros(len(label), np.int64)
    hit = label > 0
    edges = np.quantile(markers[hit], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else []
    grade[hit] = 1 + np.searchsorted(np.unique(edges), markers[hit], side="left")
    return grade


def sigmoid(v):
    return 0.5 * (1 + np.tanh(0.5 * v))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the cumulative-link model (Adam on the whole sample).
    ``row``, ``col``: the ones of the sparse feature matrix."""
    n, last = len(grade), int(grade.max())
    # shares of the grades are even cuts to start from; gaps stay positive as exponentials
    cum = np.clip(np.array([(grade <= k).mean() for k in range(last)]), 1e-3, 1 - 1e-3)
    cuts = np.log(cum / (1 - cum))
    p = np.concatenate([np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, ROUNDS + 1):
        w, gaps = p[:width], np.exp(p[width + 1:])
        cut = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = sigmoid(edge[grade + 1] - score), sigmoid(edge[grade] - score)
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like  # of the log likelihood, by the edges
        dscore = dlo - dhi
        dcut = np.array([dhi[grade == k].sum() - dlo[grade == k + 1].sum() for k in range(last)])
        g = np.concatenate([np.bincount(col, dscore[row], width), [dcut.sum()],
                            [dcut[k + 1:].sum() * gaps[k] for k in range(last - 1)]]) / n
        g[:width] -= RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1:]))])


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = GRADES,
        sample: int = SAMPLE) -> dict:
    """The model: sorted word ``codes``, their ``weights`` and the ``cuts``."""
    small_batches(spark)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, owner, n = feature_codes(batch.column(1))
            code, owner = distinct(code, owner)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["label", "codes"])

    def train(table: pa.Table) -> pa.Table:
        y = table.column("label").to_numpy()
        lists = table.column("codes").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        code = lists.flatten().to_numpy().view(U)
        owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
        kept, weights, cuts = np.zeros(0, U), np.zeros(0), np.zeros(0)
        if (y > 0).any() and (y == 0).any():
            kept = telling_words(code, owner, y, APART)
            at = np.searchsorted(kept, code)
            hit = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == code) if len(kept) else np.zeros(len(code), bool)
            row, col = owner[hit], at[hit]
            grade = y
            if y.max() == 1 and grades > 2:
                grade = graded(y, np.bincount(row, minlength=len(y)), grades)
            weights, cuts = fit_ordinal(row, col, grade, len(kept))
        return pa.table({"codes": pa.array([kept.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()),
                         "cuts": pa.array([cuts.tobytes()], pa.binary())})

    known = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, label).cast("long").alias("label")).where("label is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = documents.select(column(documents, "doc_id").alias("doc_id"), column(documents, "text").alias("text"))
    known = landed(spark, known.join(texts.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("label = 0").orderBy(*order).limit(sample).unionAll(known.where("label > 0").orderBy(*order).limit(sample))
    # at most twice SAMPLE ids: bounded, and one row an id goes on
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
    rows = rows.mapInArrow(features, "label long, codes array<long>")
    found = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(train, "codes binary, weights binary, cuts binary").collect()
    if not found:
        return {"codes": np.zeros(0, U), "weights": np.zeros(0), "cuts": np.zeros(0)}
    return {"codes": np.frombuffer(found[0].codes, U), "weights": np.frombuffer(found[0].weights), "cuts": np.frombuffer(found[0].cuts)}


def severities(texts, model: dict) -> np.ndarray:
    """Expected severity of each text of an Arrow array."""
    code, owner, n = feature_codes(texts)
    kept, score = model["codes"], np.zeros(n)
    if len(kept) and len(code):
        at = np.minimum(np.searchsorted(kept, code), len(kept) - 1)
        hit = kept[at] == code
        at, owner = distinct(at[hit], owner[hit])
        score = np.bincount(owner, model["weights"][at], n)
    return sigmoid(score[:, None] - model["cuts"][None, :]).sum(1)


def severity_column(spark: SparkSession, text, model: dict):
    small_batches(spark)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(severities(batch, model))

    return score(text)


def scored(spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, severity (expected grade) and toxic (severity from ``REJECT`` on) per document."""
    model = fit(spark, documents, labels, label)
    out = documents.select(column(documents, "doc_id").alias("doc_id"), severity_column(spark, column(documents, "text"), model).alias("severity"))
    return out.withColumn("toxic", F.col("severity") >= REJECT)


def keep_clean(spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The documents whose expected severity stays below ``REJECT``; columns unchanged."""
    model = fit(spark, documents, labels, label)
    return documents.where(severity_column(spark, column(documents, "text"), model) < REJECT)
