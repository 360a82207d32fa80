"""Operator 12: hard-negative mining by a secondary-sort shuffle.

An anchor's *positives* are its ``positives`` best other rows of its label; for each of them
the *negatives* are the first ``negatives`` rows of other labels whose score lies between
``floor`` percent of the positive's score and that score.  Scores are integer inner
products, higher first, ties by smaller id.

Every scored pair that may be needed becomes one sortable key of bytes: anchor, descending
score, positive before negative, id.  ``repartitionAndSortWithinPartitions`` deals the keys
out by anchor and sorts them, and a task reads them as one stream: a positive opens a
window at its score, the negatives that follow go to each open window until it is full or
they fall below its floor.  A task holds the open windows of one anchor and nothing else.

Anchors (the stated query set) meet all rows in blocks.  Rows are packed into blocks of
``BLOCK`` rows, anchors likewise; a cell of the grid is one block of anchors and one slice
of row blocks, which a task reads one after the other.  A cell emits only what can be
among the first: per anchor the best positives in a first pass, and in a second, when the
windows are known, the first negatives of each window.  So the shuffle carries at most
``positives * (1 + negatives)`` keys per anchor and cell, however many rows share a label
or a score, and nothing is dropped that the result could need.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component
take no part; vectors only meet vectors of their length (empty ones score 0); a component
beyond ``BOUND`` steps counts as ``BOUND``; rows of the anchor's own id aren't *other* rows;
repeated rows count each, repeated anchors once; an anchor without positives, or a positive
without rows in its window (any with a negative score), gives no rows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dense import matrices, packed, stepped, unpacked
from .shared import column, landed, small_batches

#: Rows of a block, and blocks of a slice (a slice meets a block of anchors in one task).
BLOCK, SLICE = 2048, 32
#: Components a block holds at most, so that blocks of long vectors have fewer rows.
COMPONENTS = 1 << 20
#: Blocks of an Arrow batch.
BATCH = 8
#: A component is at most so many steps from zero.
BOUND = 1 << 24
POSITIVES, NEGATIVES, FLOOR, STEPS = 5, 5, 80, 256

BLOCKS = "block long, dim int, rows int, ids binary, labels binary, width int, vectors binary"
#: Anchor (id, number among all anchors), complement of the score, kind, id, and the row's place in the
#: blocks, which tells repeated rows apart; big-endian with the sign bit flipped, so that the order of
#: bytes is the order of numbers.
KEY = np.dtype([("anchor_id", ">u8"), ("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
#: Bits of a row's place within its block.
PLACE = 12
SIGN = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64) ^ SIGN


def signed(x) -> np.ndarray:
    return (np.asarray(x).astype(np.uint64) ^ SIGN).view(np.int64)


def keys(anchor_id, anchor, score, kind: int, ids, rows) -> list[bytes]:
    out = np.empty(len(ids), KEY)
    out["anchor_id"], out["anchor"] = unsigned(anchor_id), np.asarray(anchor, np.int64).view(np.uint64)
    out["score"], out["kind"], out["id"], out["row"] = ~unsigned(score), kind, unsigned(ids), np.asarray(rows, np.int64).view(np.uint64)
    raw, size = out.tobytes(), KEY.itemsize
    return [raw[a:a + size] for a in range(0, len(raw), size)]


def opened(key: bytes) -> tuple[int, int, int, int, int]:
    """(anchor id, anchor, score, kind, id) of a key."""
    k = np.frombuffer(key, KEY)[0]
    flip = (1 << 64) - 1
    return int(k["anchor_id"]) - (1 << 63), int(k["anchor"]), (int(k["score"]) ^ flip) - (1 << 63), int(k["kind"]), int(k["id"]) - (1 << 63)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where every partial sum is an exact double."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


def first_of(who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the entries that are among the first ``count`` of their ``who``: higher scores
    first, then smaller ids."""
    order = np.lexsort((rows, ids, -score, who))
    fresh = np.ones(len(order), bool)
    fresh[1:] = who[order][1:] != who[order][:-1]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < count]


def blocks(rows: DataFrame, steps: int) -> DataFrame:
    """``rows`` (vec_id, label, embedding) packed into blocks of one vector length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, labels, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            width, raw = packed(x)
            return pa.RecordBatch.from_pydict({"block": pa.array([number - 1], pa.int64()), "dim": pa.array([dim], pa.int32()), "rows": pa.array([len(ids)], pa.int32()),
                                               "ids": [ids.tobytes()], "labels": [labels.tobytes()], "width": pa.array([width], pa.int32()), "vectors": [raw]})

        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for at, values in matrices(batch, 2):
                dim, x = values.shape[1], stepped(values, steps, BOUND)
                parts = held.setdefault(dim, [])
                parts.append((ids[at], labels[at], x))
                if sum(len(p[0]) for p in parts) >= max(1, min(BLOCK, COMPONENTS // max(1, dim))):
                    yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    return rows.mapInArrow(task, BLOCKS)


def grid(rows: DataFrame, anchors: DataFrame, slices: int, wide: int, tasks: int, cell, schema: str) -> DataFrame:
    """Run ``cell(dim, anchor records, iterator of row records)`` over every pair of a block of
    anchors and a slice of row blocks; anchors come before rows in a cell."""
    names = ["kind", "dim", "wide", "slice", "block", "ids", "labels", "width", "vectors", "wins"]
    across = F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("wide")
    down = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    left = rows.withColumns({"kind": F.lit(1), "slice": F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"), "wins": F.lit(None).cast("array<struct<anchor:long,score:long>>")}).select("*", across)
    right = anchors.withColumn("kind", F.lit(0)).select("*", down)
    cells = left.select(names).unionAll(right.select(names))
    cells = cells.repartition(tasks, "wide", "slice").sortWithinPartitions("wide", "slice", "kind", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield {n: batch.column(i)[k].as_py() for i, n in enumerate(names)}

        now, mine, state = None, None, None
        for r in records():
            if (r["wide"], r["slice"]) != now:
                if state is not None:
                    yield from cell.end(state)
                now, mine, state = (r["wide"], r["slice"]), None, None
            x = unpacked(r["width"], r["vectors"]).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0), np.int64)
            ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
            if r["kind"] == 0:
                mine, state = (r["dim"], x, ids, labels, r["wide"] << 32), cell.start(len(ids), r["wins"] or [])
            elif mine and mine[0] == r["dim"]:
                state = cell.block(state, mine, x, ids, labels, r["block"] << PLACE)
        if state is not None:
            yield from cell.end(state)

    return cells.mapInArrow(task, schema)


class _Best:
    """Running first entries of a cell: (who, score, id, row, anchor id, anchor), ``count`` of each who."""

    def __init__(self, count: int):
        self.count, self.held = count, [np.zeros(0, np.int64)] * 6

    def add(self, *columns: np.ndarray) -> None:
        both = [np.concatenate(c) for c in zip(self.held, columns, strict=True)]
        keep = first_of(*both[:4], self.count)
        self.held = [c[keep] for c in both]


class Positives:
    """The cells of the first pass: per anchor the best other rows of its label."""

    def __init__(self, count: int):
        self.count = count

    def start(self, n: int, wins: list):
        return _Best(self.count)

    def block(self, best: _Best, mine, x, ids, labels, row):
        _, a, anchor_ids, anchor_labels, base = mine
        for label in np.intersect1d(anchor_labels, labels):
            i, j = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
            score = products(a[i], x[j])
            other = ids[j][None, :] != anchor_ids[i][:, None]
            p, q = np.nonzero(other & (score >= _nth(score, other, self.count)))
            best.add(i[p], score[p, q], ids[j][q], row + j[q], anchor_ids[i][p], base + i[p])
        return best

    def end(self, best: _Best):
        who, score, ids, rows, anchor_ids, anchor = best.held
        if len(who):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys(anchor_ids, anchor, score, POSITIVE, ids, rows), pa.binary())})


class Negatives:
    """The cells of the second pass: per anchor and window the first rows of other labels."""

    def __init__(self, count: int, floor: int):
        self.count, self.floor = count, floor

    def start(self, n: int, wins: list):
        anchor = np.array([w["anchor"] & 0xFFFFFFFF for w in wins], np.int64)
        top = np.array([w["score"] for w in wins], np.int64)
        order = np.lexsort((-top, anchor))
        return anchor[order], top[order], _Best(self.count)

    def block(self, state, mine, x, ids, labels, row):
        anchor, top, best = state
        _, a, anchor_ids, anchor_labels, base = mine
        score = products(a, x)
        other = labels[None, :] != anchor_labels[:, None]
        # windows by their rank within the anchor: at most one of an anchor at a time
        nth = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        for k in np.unique(nth):
            w = np.flatnonzero(nth == k)
            s = score[anchor[w]]
            ok = other[anchor[w]] & (s <= top[w, None]) & (100 * s >= self.floor * top[w, None])
            p, q = np.nonzero(ok & (s >= _nth(s, ok, self.count)))
            best.add(w[p], s[p, q], ids[q], row + q, anchor_ids[anchor[w][p]], base + anchor[w][p])
        return anchor, top, best

    def end(self, state):
        _, score, ids, rows, anchor_ids, anchor = state[2].held
        if len(ids):  # one key for all windows of the anchor
            found = sorted(set(keys(anchor_ids, anchor, score, NEGATIVE, ids, rows)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.binary())})


def _nth(score: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """Per row of ``score`` its ``count``-th highest allowed value (or less), as a column."""
    least = np.iinfo(np.int64).min
    if score.shape[1] <= count:
        return np.full((len(score), 1), least)
    held = np.where(allowed, score, least)
    return np.partition(held, score.shape[1] - count, axis=1)[:, [score.shape[1] - count]]


def secondary_sort(found: DataFrame, tasks: int):
    """The keys dealt out by anchor and sorted, as an RDD of (key, None)."""
    return found.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(tasks, lambda k: portable_hash(k[:16]))


def first_positives(stream, count: int) -> Iterator[tuple]:
    """(key, anchor, score) of the first positives of each anchor in a sorted stream."""
    now, seen = None, 0
    for key, _ in stream:
        if key[:16] != now:
            now, seen = key[:16], 0
        seen += 1
        if seen <= count:
            _, anchor, score, _, _ = opened(key)
            yield bytearray(key), anchor, score


def windows(stream, positives: int, negatives: int, floor: int) -> Iterator[tuple]:
    """Rows of the result from a sorted stream of keys."""
    now, open_, seen = None, [], 0
    for key, _ in stream:
        if key[:16] != now:
            now, open_, seen = key[:16], [], 0
        elif seen and not open_ and seen >= positives:
            continue  # all windows of this anchor are closed
        anchor_id, _, score, kind, other = opened(key)
        if kind == POSITIVE:
            seen += 1
            open_.append([score, other, 0])
            continue
        open_ = [w for w in open_ if w[2] < negatives and 100 * score >= floor * w[0]]
        for w in open_:
            if score <= w[0]:
                w[2] += 1
                yield anchor_id, w[1], w[2], other, w[0], score


def mine(spark: SparkSession, embeddings: DataFrame, every: int = 100, steps: int = STEPS, positives: int = POSITIVES,
         negatives: int = NEGATIVES, floor: int = FLOOR, label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the
    rows whose vec_id is divisible by ``every``."""
    small_batches(spark)
    rows = embeddings.select(column(embeddings, "vec_id").cast("long").alias("vec_id"), column(embeddings, label).cast("long").alias("label"),
                             column(embeddings, "embedding").alias("embedding")).where("vec_id is not null and label is not null and embedding is not null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = landed(spark, blocks(rows, steps), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % every == 0).distinct()
    anchors = landed(spark, blocks(anchors, steps), "negatives-anchors")
    number = anchors.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("wide"))  # one row a block of anchors
    anchors = landed(spark, anchors.join(number, "block"), "negatives-numbered")
    wide, n = anchors.count(), row_blocks.count()
    # wide slices ship fewer anchors; never fewer slices than tasks can share
    slices = max(1, -(-n // SLICE), min(n, tasks))
    none = F.lit(None).cast("array<struct<anchor:long,score:long>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    found = grid(row_blocks, anchors.withColumn("wins", none), slices, max(1, wide), tasks, Positives(positives), "key binary")
    best = secondary_sort(found, tasks).mapPartitions(lambda s: first_positives(s, positives))
    best = landed(spark, spark.createDataFrame(best, "key binary, anchor long, score long"), "negatives-positives")
    # a block of anchors has at most BLOCK times ``positives`` windows
    wins = best.groupBy(F.shiftright("anchor", 32).cast("int").alias("wide")).agg(F.collect_list(F.struct("anchor", "score")).alias("wins"))
    found = grid(row_blocks, anchors.join(wins, "wide"), slices, max(1, wide), tasks, Negatives(negatives, floor), "key binary")
    out = secondary_sort(best.select("key").unionAll(found), tasks).mapPartitions(lambda s: windows(s, positives, negatives, floor))
    small_batches(spark)
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
