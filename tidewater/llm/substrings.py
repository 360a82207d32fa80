"""Operator 4: substring deduplication by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words.  Its anchor is its run of ``GRAM`` words with the
smallest code (the leftmost of equal ones), so equal windows have equal anchors.  Suffixes
are split into groups by the anchor's words, a prefix of variable length: anchors that
occur once can't repeat and are never shipped, anchors that occur up to ``GROUP_ROWS``
times are groups of their own, and for more frequent ones the prefix is lengthened to the
whole window, where a group needs no tree but only its smallest position, found by a
map-side combined aggregate.  In a group, suffixes are sorted by their words; the longest
common prefixes of neighbours are the suffix tree's internal nodes, and a node of depth
``WINDOW`` or more is a repeat: all its leaves but the first (smaller doc_id, then
earlier start) are marked.  Marks go back to the texts as bit masks of window starts.

Defined cases: a null or empty text has no words and no windows; a text of fewer than
``WINDOW`` words loses none; rows equal in doc_id and text are the same document; rows of
one doc_id with other texts are ordered by a hash of the text; a null doc_id comes after
all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BITMAP_BITS, bit_of, bitmap, column, in_bitmap, landed, maybe, small_batches, whole_groups
from .textcodes import U, mix, rolling, slices, text_bytes, word_codes, words

WINDOW = 20
GRAM = 6
#: Rows of a prefix group that one task sorts; longer ones get a longer prefix.
GROUP_ROWS = 200_000
#: Rows that a task works on at a time, whole groups.
CHUNK_ROWS = 10_000


def anchored(texts) -> dict[str, np.ndarray]:
    """The runs of windows that share an anchor: its code, the text, the first window's
    word number in the text, the number of windows, and the byte range of their words."""
    data, offsets = text_bytes(texts)
    start, end, doc = words(data, offsets)
    code = word_codes(data, start, end)
    n = len(code) - WINDOW + 1
    if n <= 0:
        n = 0
    gram = rolling(code, GRAM)
    # least[i]: leftmost position of the smallest code among the grams of window i
    least, have, size = np.arange(len(gram)), 1, WINDOW - GRAM + 1
    while have < size:
        step = min(have, size - have)
        a, b = least[:len(least) - step], least[step:]
        least = np.where(gram[a] <= gram[b], a, b)
        have += step
    least = least[:n]
    whole = doc[:n] == doc[WINDOW - 1:][:n]
    at = np.flatnonzero(whole)
    anchor = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)
    i0 = at[first]
    count = np.diff(np.append(np.flatnonzero(first), len(at)))
    last = i0 + count + WINDOW - 2
    base = np.searchsorted(doc, doc[i0]) if len(i0) else i0
    return {"code": gram[anchor[first]], "doc": doc[i0], "start": i0 - base, "count": count,
            "from": start[i0] if len(i0) else i0, "to": end[last] if len(i0) else i0, "data": data}


def bit_index(code: np.ndarray) -> np.ndarray:
    return (code >> U(64 - 26)).astype(np.int64) & (BITMAP_BITS - 1)


def repeats(code: np.ndarray, rank: list[np.ndarray], texts: pa.Array, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For whole groups: a bit mask per row of its windows that are not the first leaf of a
    deep node.  ``rank``: the order of documents, most significant column first."""
    data, offsets = text_bytes(texts)
    a, b, owner = words(data, offsets)
    word = word_codes(data, a, b)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.searchsorted(owner, np.arange(len(count)))[row] + nth
    place = start[row] + nth
    order = np.lexsort((place, *[r[row] for r in rank[::-1]], rolling(word, WINDOW)[at], code[row]))
    suffix, group = word[at[order][:, None] + np.arange(WINDOW)], code[row][order]
    common = np.cumprod(suffix[1:] == suffix[:-1], axis=1).sum(1)  # longest common prefixes
    deep = np.concatenate([[False], (common >= WINDOW) & (group[1:] == group[:-1])])
    node = np.cumsum(~deep) - 1
    head = order[np.flatnonzero(~deep)][node]  # the first leaf of each suffix's node
    same = place[order] == place[head]
    for r in rank:
        same &= r[row][order] == r[row][head]
    marked = order[deep & ~same]
    mask = np.zeros(len(count), np.int32)
    np.bitwise_or.at(mask, row[marked], np.left_shift(1, nth[marked]).astype(np.int32))
    return mask


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(column(documents, "text"), F.lit(""))
    return documents.select(column(documents, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def marks(spark: SparkSession, documents: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, t, start, mask): window ``start`` + k of the document (doc_id, text hash
    t) repeats an earlier one if bit k of ``mask`` is set."""
    small_batches(spark)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchored(batch.column(0))["code"].view(np.int64))], ["code"])

    rows = keyed(documents)
    often = rows.select("text").mapInArrow(anchors, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    often = landed(spark, often.where("n > 1"), "substrings-often")
    bit = F.shiftrightunsigned("code", 64 - 26).alias("bit")
    repeated = bitmap(spark, often.select(bit))
    crowded = bitmap(spark, often.where(F.col("n") > group_rows).select(bit))
    crowds = bool(crowded.value.any())

    def contexts(hot: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = anchored(batch.column(2))
                b = bit_index(x["code"])
                keep = in_bitmap(repeated.value, b)
                if crowds:
                    keep &= in_bitmap(crowded.value, b) == hot
                who = pa.array(x["doc"][keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["code"][keep].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who),
                     pa.array(x["start"][keep].astype(np.int32)), pa.array(x["count"][keep].astype(np.int32)),
                     slices(x["data"], x["from"][keep], x["to"][keep])],
                    ["code", "doc_id", "t", "start", "count", "words"])
        return task

    schema = "code long, doc_id long, t long, start int, count int, words binary"

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            doc = table.column("doc_id")
            rank = [doc.is_null().to_numpy().astype(np.int8), doc.fill_null(0).to_numpy(), table.column("t").to_numpy()]
            mask = repeats(table.column("code").to_numpy().view(U), rank, table.column("words"),
                           table.column("start").to_numpy().astype(np.int64), table.column("count").to_numpy())
            found = pa.table({"doc_id": doc, "t": table.column("t"), "start": table.column("start"), "mask": pa.array(mask)})
            return found.filter(pa.array(mask != 0)).combine_chunks().to_batches()

        for table in whole_groups(batches, ["code"], CHUNK_ROWS):
            yield from done(table)

    out_schema = "doc_id long, t long, start int, mask int"
    found = (rows.select("doc_id", "t", "text").mapInArrow(contexts(False), schema).repartition("code").sortWithinPartitions("code")
             .mapInArrow(trees, out_schema))
    return found.unionAll(_crowded(spark, rows.mapInArrow(contexts(True), schema))) if crowds else found


def _crowded(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Marks of the windows of crowded anchors: one row per window, grouped by all its words.
    The first places are written before they are joined, and the result is written by
    itself: Spark can split such a join where one window fills a partition."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(5))
            a, b, owner = words(data, offsets)
            word = word_codes(data, a, b)
            count = batch.column(4).to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = np.searchsorted(owner, np.arange(len(count)))[row] + nth
            who = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolling(word, WINDOW)[at].view(np.int64)), pa.array(rolling(mix(word + U(1)), WINDOW)[at].view(np.int64)),
                 batch.column(1).take(who), batch.column(2).take(who),
                 pa.array((batch.column(3).to_numpy()[row] + nth).astype(np.int32))], ["w1", "w2", "doc_id", "t", "start"])

    each = rows.mapInArrow(windows, "w1 long, w2 long, doc_id long, t long, start int")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("d"), "t", "start")
    first = landed(spark, each.groupBy("w1", "w2").agg(F.min(place).alias("first")), "substrings-first")
    again = each.join(first, ["w1", "w2"]).where(place > F.col("first"))
    return landed(spark, again.select("doc_id", "t", "start", F.lit(1).alias("mask")), "substrings-crowded")


def dedupe(spark: SparkSession, documents: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, per document."""
    # copies of a row have the same marks: one of each, so that a list is bounded by its text
    once = marks(spark, documents, group_rows).groupBy("doc_id", "t", "start").agg(F.bit_or("mask").alias("mask"))
    found = landed(spark, once.groupBy("doc_id", "t")
                   .agg(F.collect_list(F.struct("start", "mask")).alias("marks")), "substrings-marks")
    held = bitmap(spark, found.select(bit_of("t").alias("bit")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, kept = [], [], []
            lists = batch.column(2)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            starts, masks = flat.field("start").to_numpy(), flat.field("mask").to_numpy()
            for text, n, to in zip(batch.column(1).to_pylist(), size, np.cumsum(size), strict=True):
                word = text.encode().split()  # on exactly the ASCII white space
                before.append(len(word))
                if n:
                    start, mask = starts[to - n:to], masks[to - n:to]
                    edge = np.zeros(len(word) + WINDOW + 32, np.int32)
                    for k in range(WINDOW - GRAM + 1):
                        s = start[mask >> k & 1 == 1] + k
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + WINDOW, -1)
                    word = list(compress(word, (np.cumsum(edge)[:len(word)] == 0).tolist()))
                after.append(len(word))
                kept.append(b" ".join(word))
            before, after = np.array(before, np.int64), np.array(after, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before), pa.array(before - after), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "text"])

    rows = keyed(documents).withColumn("__maybe", maybe(held, bit_of("t")))
    hit = rows.where("__maybe").alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id and r.t = f.t"), "left")
    hit = hit.select("r.doc_id", "text", "marks")
    rest = rows.where("not __maybe").select("doc_id", "text", F.lit(None).cast(found.schema["marks"].dataType).alias("marks"))
    return hit.unionAll(rest).mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
