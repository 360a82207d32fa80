"""Operator 9: language-model scores by Katz backoff over word bigrams.

    P(w2 | w1) = d(r) r / c(w1)                      if r = c(w1, w2) > 0
               = alpha(w1) (c(w2) + 0.1) / Z          otherwise; alpha = 1 if c(w1) = 0

r is a count in the training documents, d(r) the Good-Turing discount for r up to ``DISCOUNTED``
(``LARGE`` above, so that every history keeps mass), and alpha(w1) the exact quotient of the
mass left over by seen words and their mass in the lower order, which is the add-0.1
unigram distribution.  Text, counts and weights never meet in one place:

1. Tokens of a block of documents become packed rows, one per block and word partition
   (of w2; a hot w2 is split by w1), and are shuffled once.
2. A word partition counts its words and bigrams over all blocks, stores them as the
   n-gram table (one packed row per partition), and returns per block and document the
   sums that need no other partition: how often each small count occurs, and logs of
   counts.  Since log P is a sum, discounts enter later as factors of those numbers.
3. What alpha(w1) needs (how many seen words of each count, and their lower-order mass)
   goes to partitions of w1, with the unseen bigrams of held-out documents; these get
   their backoff weights there (the stored backoff table) and sums per document.  The few
   histories so common that their unseen bigrams are split over partitions (at most
   1 / ``VERY_HOT``) are summed by themselves, and their weights travel with the tasks.
4. The sums of a block come together again by document.

``score`` leaves the tables at its ``path``; ``tables`` reads them as columns (words, bigrams,
backoff weights) and ``score_texts`` scores any documents from them, a join per table and a
step down to the lower order for every token whose bigram isn't there.  With ``complete`` the
backoff table has every history, else those of the held-out documents.

Words are 64-bit codes.  A w1 among the ``COMMON`` most common words travels as its number
and otherwise as its code (with the top bit set, to tell it from a number); ``COMMON`` only
shortens rows, and its list may come from block counts.  There are as many word partitions
as ``PART_TOKENS`` asks for, so a task's memory does not grow with the corpus; a partition
returns rows for the blocks, documents and histories that it holds, so all rows together
follow the tokens.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the
empty string in the split; repeated rows count as often as they stand; without training
documents all words are unknown; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .shared import BITMAP_BITS, bitmap, column, groups, in_bitmap, landed, small_batches
from .textcodes import U, lower_ascii, mix, text_bytes, word_codes, words

FOLDS, ADD = 10, 0.1
DISCOUNTED, LARGE = 5, 0.999
#: Tokens of a block; a block has at most 65,535 documents.
BLOCK_TOKENS = 1_000_000
COMMON = 65_535
#: Tokens of a word partition at most on average: a task holds some 60 bytes for each.
PART_TOKENS = 2_000_000
#: A word with more than this share of all tokens is split over partitions.
HOT, VERY_HOT = 1 / 8192, 1 / 256
START, END = U(0x51A27E11C0DE0001), U(0xE2D0C0DE0F7EC571)
#: Kinds of packed rows.
DOCS, SUMS, COUNTS, NGRAMS, BACKOFF, UNSEEN, WEIGHTS = range(7)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], "<i8")
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray]:
    body = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    at, out = 8 * (1 + 3 * n), []
    for kind, size, length in np.frombuffer(body, "<i8", 3 * n, 8).reshape(n, 3):
        out.append(np.frombuffer(body, np.dtype(f"{chr(kind)}{size}"), int(length), at))
        at += int(size * length)
    return out


def blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of documents: their rows (doc_id, held_out, text), every token's code, the code
    before it and its document; each document ends with ``END`` and begins after ``START``."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def block():
        table = pa.Table.from_batches([b.select(["doc_id", "held_out"]) for b, _, _ in held]).combine_chunks()
        shift = np.cumsum([0] + [b.num_rows for b, _, _ in held])
        code, doc = np.concatenate([c for _, c, _ in held]), np.concatenate([d + s for (_, _, d), s in zip(held, shift, strict=False)])
        docs = np.arange(table.num_rows)
        own = np.concatenate([doc, docs])
        order = np.argsort(own, kind="stable")  # words keep their order, the end comes last
        w2, doc = np.concatenate([code, np.full(len(docs), END)])[order], own[order]
        w1 = np.concatenate([[START], w2[:-1]])
        w1[1:][doc[1:] != doc[:-1]] = START
        return table, w2, w1, doc

    for batch in batches:
        for part in [batch.slice(k, 500) for k in range(0, batch.num_rows, 500)]:
            data, offsets = text_bytes(part.column(2))
            data = lower_ascii(data)
            start, end, doc = words(data, offsets)
            held.append((part, word_codes(data, start, end), doc))
            if sum(len(c) for _, c, _ in held) >= tokens or sum(b.num_rows for b, _, _ in held) > 60_000:
                yield block()
                held.clear()
    if held:
        yield block()


def history_bit(w1: np.ndarray) -> np.ndarray:
    return (mix(w1) >> U(64 - 26)).astype(np.int64) & (BITMAP_BITS - 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing d(1) .. d(DISCOUNTED) from n[r], the number of bigrams that occur r times;
    where these give none below 1, half a count is taken off."""
    k = DISCOUNTED
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = np.empty(k + 1)
    out[0] = np.nan
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def bigram_runs(wid: np.ndarray, w1: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training count of each entry's bigram, and the distinct bigrams: history, word, count."""
    order = np.argsort(mix(w1) ^ (wid.astype(U) * U(0x9E3779B97F4A7C15)), kind="stable")
    one, two = w1[order], wid[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.flatnonzero(fresh)
    seen = np.add.reduceat(train[order].astype(np.int64), head)
    r = np.empty(len(order), np.int64)
    r[order] = seen[np.cumsum(fresh) - 1]
    return r, one[head], two[head], seen


TOP = U(1) << U(63)


def named(short: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Histories: numbers of common words, or codes with the top bit set."""
    out = short.astype(U)
    out[short == COMMON] = far | TOP
    return out


NAMED_START = START | TOP
#: Where the statistics of split histories go.
SPLIT = -1


def flagged(histories: np.ndarray, flags: np.ndarray, rare: bool) -> np.ndarray:
    """For named histories the flag of their common word; ``rare`` for the others."""
    common = histories < len(flags)
    out = np.full(len(histories), rare)
    out[common] = flags[histories[common].astype(np.int64)]
    return out


def dealt(home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, its rows) for every partition that has any."""
    if not len(home):
        return
    order = np.argsort(home, kind="stable")
    have, start = np.unique(home[order], return_index=True)
    yield from zip(have.tolist(), np.split(order, start[1:]), strict=True)


def halves(histories: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return histories.astype(np.uint32), (histories >> U(32)).astype(np.uint32)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U) | high.astype(U) << U(32)


META = ("n_types long, n_train long, train_docs long, discounts array<double>, common binary, split_history binary, split_count binary, split_alpha binary")


def common_words(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Codes of the most common words, from what is common in some block, and all tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w2, _, _ in blocks(batches, BLOCK_TOKENS):
            code, n = np.unique(w2, return_counts=True)
            often = n > max(1, len(w2) / COMMON)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(code[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                                              pa.array(np.append(np.zeros(often.sum(), np.int64), len(w2)))], ["code", "n", "tokens"])

    found = rows.mapInArrow(task, "code long, n long, tokens long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    found = landed(rows.sparkSession, found, "katz-common")
    total = found.agg(F.sum("tokens")).first()[0] or 0
    top = found.where("n > 0").orderBy(F.desc("n"), "code").limit(COMMON).select("code").toArrow().column(0).to_numpy()
    return np.sort(top.astype(np.int64).view(U)), total


def hot_counts(spark: SparkSession, rows: DataFrame, common: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, object]:
    """Hot words with their exact training counts, and a bitmap of the words of held-out
    documents (the only histories whose backoff weights are needed)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, w2, _, doc in blocks(batches, BLOCK_TOKENS):
            out = table.column("held_out").to_numpy()[doc]
            code, n = np.unique(np.concatenate([w2[~out], common]), return_counts=True)
            at = np.searchsorted(code, common)
            seen = n[at] - 1
            bit = np.unique(history_bit(np.concatenate([w2[out], [START]])))
            hit = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([common[hit].view(np.int64), np.zeros(len(bit), np.int64)])),
                                              pa.array(np.concatenate([seen[hit], np.zeros(len(bit), np.int64)])),
                                              pa.array(np.concatenate([np.full(len(hit), -1), bit]))], ["code", "n", "bit"])

    found = landed(spark, rows.mapInArrow(task, "code long, n long, bit long").groupBy("code", "bit").agg(F.sum("n").alias("n")), "katz-hot")
    held = bitmap(spark, found.where("bit >= 0"))
    hot = found.where(F.col("n") > int(total * HOT)).select("code", "n").toArrow()  # fewer than 1 / HOT words
    code, n = hot.column(0).to_numpy().view(U), hot.column(1).to_numpy()
    order = np.argsort(code)
    return code[order], n[order], held


def statistics(small: list, big: np.ndarray, big_sum: np.ndarray, mass: np.ndarray, d: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and backoff weights of histories: from how many seen words occur 1 ..
    ``DISCOUNTED`` times and more often, the counts of the latter, and all their unigram counts."""
    c1 = sum((k + 1) * x for k, x in enumerate(small)) + big_sum
    kept = sum(d[k + 1] * (k + 1) * x for k, x in enumerate(small)) + LARGE * big_sum
    lower = (mass + ADD * (sum(small) + big)) / z
    return c1, (1 - kept / c1) / (1 - lower)


def score(spark: SparkSession, documents: DataFrame, path: str | None = None, complete: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.  The
    model's tables stay at ``path``."""
    small_batches(spark)
    doc_id = column(documents, "doc_id").cast("long")
    bucket = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = documents.select(doc_id.alias("doc_id"), (bucket == 0).alias("held_out"), column(documents, "text").alias("text"))
    common, total = common_words(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    hot, hot_n, histories = hot_counts(spark, rows, common, total)
    splits = spark.sparkContext.broadcast((common, hot, hot_n, np.append(hot[hot_n > total * VERY_HOT], START)))

    def part_of(w2: np.ndarray, w1: np.ndarray, split: np.ndarray) -> np.ndarray:
        return (mix(np.where(np.isin(w2, split), mix(w1) ^ w2, w2)) % U(parts)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hot, _, _ = splits.value
        here = TaskContext.get().partitionId() << 24
        for nth, (table, w2, w1, doc) in enumerate(blocks(batches, BLOCK_TOKENS)):
            out = table.column("held_out").to_numpy()
            ids = table.column("doc_id")
            yield packed([DOCS], [0], [here + nth], [pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), out, np.bincount(doc, minlength=len(out)))])
            part = part_of(w2, w1, hot).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(w2, kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            part, w2, w1, doc = part[order], w2[order], w1[order], doc[order].astype(np.uint16)
            at = np.minimum(np.searchsorted(common, w1), max(0, len(common) - 1))
            near = (common[at] == w1) if len(common) else np.zeros(len(w1), bool)
            short = np.where(near, at, COMMON).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(part)) + 1
            keys, raws = [], []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(part)), strict=True):
                code, n = np.unique(w2[a:b], return_counts=True)
                keys.append(int(part[a]))
                raws.append(pack(code, n.astype(np.uint32), doc[a:b], short[a:b], w1[a:b][~near[a:b]], np.packbits(out)))
                if len(raws) == 16:
                    yield packed([NGRAMS] * 16, keys, [here + nth] * 16, raws)
                    keys, raws = [], []
            yield packed([NGRAMS] * len(keys), keys, [here + nth] * len(keys), raws)

    def packed(kind, key, block, raw) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(raw, pa.binary())],
                                          ["kind", "key", "block", "raw"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hot, hot_n, very_hot = splits.value
        # of the common words: whose backoff weight is needed, and which are split
        wanted, wide = in_bitmap(histories.value, history_bit(common)) | complete, np.isin(common, very_hot)
        for g in groups(batches, ["kind", "key"]):
            if g.column("kind")[0].as_py() == DOCS:
                yield from g.to_batches()
                continue
            at, each = g.column("block").to_pylist(), [unpack(r) for r in g.column("raw").to_pylist()]
            code, wid = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
            wid = np.repeat(wid.astype(np.int32), np.concatenate([x[1] for x in each]))
            size = [len(x[5]) * 8 for x in each]
            first = np.cumsum([0, *size])
            doc = np.concatenate([x[2].astype(np.int32) + s for x, s in zip(each, first, strict=False)])
            train = ~np.concatenate([np.unpackbits(x[5]) for x in each]).astype(bool)[doc]
            w1 = np.concatenate([named(x[3], x[4]) for x in each])
            del g, each
            c2 = np.bincount(wid, train, len(code))
            split = np.searchsorted(hot, code)
            is_hot = (split < len(hot)) & (hot[np.minimum(split, max(0, len(hot) - 1))] == code) if len(hot) else np.zeros(len(code), bool)
            c2[is_hot] = hot_n[split[is_hot]] if is_hot.any() else 0
            r, gw1, gw2, seen = bigram_runs(wid, w1, train)
            few = np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:DISCOUNTED + 2]
            yield packed([COUNTS], [0], [0], [pack(np.append(few, [(c2[~is_hot] > 0).sum(), int(c2[~is_hot].sum())]).astype(np.int64))])
            known = seen > 0
            order = np.argsort(gw2[known], kind="stable")
            yield packed([NGRAMS], [int(mix(code[:1])[0] % U(parts))], [0], [pack(
                code, c2.astype(np.int64), np.bincount(gw2[known], minlength=len(code)).astype(np.uint32), *halves(gw1[known][order]),
                seen[known][order].astype(np.uint32))])
            # sums by document that no other partition has a part in
            ends = code[wid] == END
            log_c2 = np.log10(c2 + ADD)
            value = np.where(r > DISCOUNTED, np.log10(np.maximum(r, 1)), 0.0)
            value -= np.where(ends, 0.0, np.log10(np.maximum(c2, 1))[wid])
            value += np.where(r == 0, log_c2[wid], 0.0)
            n = int(first[-1])
            total_value, base = np.bincount(doc, value, n), np.bincount(doc, log_c2[wid], n)
            counts = [np.bincount(doc[r == k], minlength=n) for k in range(DISCOUNTED + 1)] + [np.bincount(doc[c2[wid] > 0], minlength=n)]
            here = np.flatnonzero(np.bincount(doc, minlength=n))  # the documents that have a word of this partition
            cuts = np.searchsorted(here, first)
            for b, a, lo, hi in zip(at, first[:-1], cuts[:-1], cuts[1:], strict=True):
                k = here[lo:hi]
                yield packed([SUMS], [b], [b], [pack((k - a).astype(np.uint16), total_value[k], base[k], *(c[k].astype(np.uint32) for c in counts))])
            # what histories of held-out documents need for their backoff weights
            take = known & (flagged(gw1, wanted, True) | (gw1 == NAMED_START))
            id1, inverse = np.unique(gw1[take], return_inverse=True)
            s, w, big = seen[take], len(id1), seen[take] > DISCOUNTED
            stats = [np.bincount(inverse[s == k], minlength=w).astype(np.uint32) for k in range(1, DISCOUNTED + 1)]
            stats += [np.bincount(inverse[big], minlength=w).astype(np.uint32), np.bincount(inverse[big], s[big], w).astype(np.uint64),
                      np.bincount(inverse, c2[gw2[take]], w).astype(np.uint64)]
            split = flagged(id1, wide, False) | (id1 == NAMED_START)
            for p, k in dealt(np.where(split, SPLIT, (mix(id1) % U(parts)).astype(np.int64))):
                yield packed([BACKOFF], [p], [0], [pack(*halves(id1[k]), *(x[k] for x in stats))])
            # unseen bigrams: a split history's go to the partition that the document says
            u = np.flatnonzero(r == 0)
            id1, d = w1[u], doc[u]
            split = flagged(id1, wide, False) | (id1 == NAMED_START)
            which = np.searchsorted(first, d, side="right") - 1
            block_ids, place = np.array(at, np.int64), (d - first[which]).astype(np.uint16)
            for p, k in dealt((mix(np.where(split, id1 ^ mix(d.astype(U) + U(7)), id1)) % U(parts)).astype(np.int64)):
                yield packed([UNSEEN], [p], [0], [pack(*halves(id1[k]), block_ids, which[k].astype(np.uint32), place[k])])

    schema = "kind int, key long, block long, raw binary"
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/katz-{uuid.uuid4().hex[:12]}"
    (rows.mapInArrow(spread, schema).repartition(parts, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(count, schema)
     .write.partitionBy("kind").parquet(path))
    stored = spark.read.schema("key long, block long, raw binary, kind int").parquet(path)

    counted = np.zeros(DISCOUNTED + 4, np.int64)
    for r in stored.where(f"kind = {COUNTS}").select("raw").toLocalIterator():  # one small row per partition
        counted += unpack(r.raw)[0]
    n_types, n_train = int(counted[-2] + (hot_n > 0).sum()), int(counted[-1] + hot_n.sum())
    d = discounts(counted[:DISCOUNTED + 2].astype(float))
    train_docs = rows.where("not held_out").count()
    z = n_train + ADD * (n_types + 1)

    def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                lo, hi, *stats = unpack(raw)
                yield pa.RecordBatch.from_arrays([pa.array(whole(lo, hi).view(np.int64)), *(pa.array(x.astype(np.int64)) for x in stats)], ["history", *(f"s{k}" for k in range(len(stats)))])

    width = DISCOUNTED + 3
    summed = stored.where(f"kind = {BACKOFF} and key = {SPLIT}").select("raw").mapInArrow(split_rows, "history long, " + ", ".join(f"s{k} long" for k in range(width)))
    found = summed.groupBy("history").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width))).toArrow()  # at most 1 / VERY_HOT + 1 rows
    split_id = found.column(0).to_numpy().astype(np.int64).view(U)
    each = [found.column(k + 1).to_numpy().astype(float) for k in range(width)]
    split_c1, split_alpha = statistics(each[:DISCOUNTED], *each[DISCOUNTED:], d, z) if len(split_id) else (np.zeros(0), np.zeros(0))
    spark.createDataFrame([(n_types, n_train, train_docs, [float(x) for x in d[1:]], common.tobytes(), split_id.tobytes(), split_c1.astype(np.int64).tobytes(), split_alpha.tobytes())],
                          META).write.parquet(f"{path}-meta")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Backoff weights of a partition of histories; its unseen bigrams get theirs."""
        for g in groups(batches, ["key"]):
            kind, raw = g.column("kind").to_numpy(), g.column("raw").to_pylist()
            stats = [unpack(x) for x, k in zip(raw, kind, strict=True) if k == BACKOFF]
            misses = [unpack(x) for x, k in zip(raw, kind, strict=True) if k == UNSEEN]
            id1, c1, alpha = np.zeros(0, U), np.zeros(0), np.zeros(0)
            if stats:
                cat = [np.concatenate(x) for x in zip(*stats, strict=True)]
                id1, inverse = np.unique(whole(*cat[:2]), return_inverse=True)
                total = [np.bincount(inverse, x.astype(float), len(id1)) for x in cat[2:]]
                c1, alpha = statistics(total[:DISCOUNTED], *total[DISCOUNTED:], d, z)
                yield packed([WEIGHTS], [g.column("key")[0].as_py()], [-1], [pack(id1, c1.astype(np.int64), alpha)])
            id1 = np.concatenate([id1, split_id])
            order = np.argsort(id1)
            id1, weight = id1[order], np.log10(np.concatenate([alpha * c1, split_alpha * split_c1]))[order]
            if not len(id1):
                continue
            for lo, hi, ids, which, doc in misses:
                w1 = whole(lo, hi)
                at = np.minimum(np.searchsorted(id1, w1), len(id1) - 1)
                hit = id1[at] == w1
                where, slot = np.unique(which[hit].astype(np.int64) << 16 | doc[hit], return_inverse=True)
                sums = np.bincount(slot, weight[at[hit]], len(where))
                cuts = np.flatnonzero(np.diff(where >> 16)) + 1
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(where)), strict=True):
                    if b > a:
                        block = int(ids[where[a] >> 16])
                        yield packed([UNSEEN], [block], [block], [pack((where[a:b] & 65535).astype(np.uint16), sums[a:b])])

    back = stored.where(F.col("kind").isin(BACKOFF, UNSEEN) & (F.col("key") != SPLIT)).select("kind", "key", "block", "raw")
    path2 = f"{path}-backoff"
    back.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(weigh, schema).write.partitionBy("kind").parquet(path2)
    weighed = spark.read.schema("key long, block long, raw binary, kind int").parquet(path2)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            kind, raw = g.column("kind").to_numpy(), g.column("raw").to_pylist()
            ids, null, out, n = unpack(raw[int(np.flatnonzero(kind == DOCS)[0])])
            docs = len(ids)
            value, base = np.zeros(docs), np.zeros(docs)
            counts = np.zeros((DISCOUNTED + 2, docs), np.int64)
            for k, x in zip(kind, raw, strict=True):
                if k == SUMS:
                    doc, *s = unpack(x)
                    value[doc] += s[0]
                    base[doc] += s[1]
                    counts[:, doc] += np.array(s[2:], np.int64)
                elif k == UNSEEN:
                    doc, add = unpack(x)
                    value[doc] += add
            unseen, known = counts[0], counts[-1]
            value += sum(counts[r] * np.log10(d[r] * r) for r in range(1, DISCOUNTED + 1))
            value += (n - counts[:DISCOUNTED + 1].sum(0)) * np.log10(LARGE) - unseen * np.log10(z)
            value -= np.log10(max(1, train_docs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known),
                 pa.array(np.full(docs, n_train, np.int64)), pa.array(base - n * np.log10(z)), pa.array(value)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = stored.where(F.col("kind").isin(DOCS, SUMS)).select("kind", "block", "raw")
    both = sums.unionAll(weighed.where(f"kind = {UNSEEN}").select("kind", "block", "raw"))
    return both.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables that ``score`` left at ``path``, as columns: words (word, n), bigrams (history,
    word, n) and backoff weights (history, n, alpha); words and histories are 64-bit codes,
    those of rare histories without their top bit."""
    meta = spark.read.schema(META).parquet(f"{path}-meta").first()
    common = np.frombuffer(meta.common, U)

    def codes(histories: np.ndarray) -> np.ndarray:
        out = histories & ~TOP
        near = histories < len(common)
        out[near] = common[histories[near].astype(np.int64)]
        return out & ~TOP

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                code, c2, each, lo, hi, n = unpack(raw)
                w2 = np.repeat(code, each)
                history = np.concatenate([np.zeros(len(code), U), codes(whole(lo, hi))])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.ones(len(code), bool), np.zeros(len(n), bool))), pa.array(history.view(np.int64)),
                                                  pa.array(np.concatenate([code, w2]).view(np.int64)), pa.array(np.concatenate([c2, n.astype(np.int64)]))], ["single", "history", "word", "n"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                id1, c1, alpha = unpack(raw)
                yield pa.RecordBatch.from_arrays([pa.array(codes(id1).view(np.int64)), pa.array(c1), pa.array(alpha)], ["history", "n", "alpha"])

    packed = "key long, block long, raw binary, kind int"
    both = spark.read.schema(packed).parquet(path).where(f"kind = {NGRAMS}").select("raw").mapInArrow(grams, "single boolean, history long, word long, n long")
    # a word split over partitions stands in each with its whole count
    words_ = both.where("single and n > 0").select("word", "n").distinct()
    own = spark.read.schema(packed).parquet(f"{path}-backoff").where(f"kind = {WEIGHTS}").select("raw").mapInArrow(weights, "history long, n long, alpha double")
    split = codes(np.frombuffer(meta.split_history, U)).view(np.int64), np.frombuffer(meta.split_count, np.int64), np.frombuffer(meta.split_alpha)
    few = spark.createDataFrame([(int(h), int(n), float(a)) for h, n, a in zip(*split, strict=True)], "history long, n long, alpha double")
    return words_, both.where("not single").select("history", "word", "n"), own.unionAll(few)


def score_texts(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of any documents by the tables at ``path`` (written with
    ``complete``), token by token: the bigram's count, else the backoff weight of its history
    times the lower order.  Equal rows of a doc_id are scored each."""
    small_batches(spark)
    meta = spark.read.schema(META).parquet(f"{path}-meta").first()
    z = meta.n_train + ADD * (meta.n_types + 1)
    start = int((START & ~TOP).view(np.int64))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, w2, w1, doc in blocks(batches, BLOCK_TOKENS):
            pair, n = np.unique(np.stack([doc.astype(U), w1 & ~TOP, w2]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(pair[0].astype(np.int64))), table.column("held_out").combine_chunks().take(pa.array(pair[0].astype(np.int64))),
                                              pa.array(pair[1].view(np.int64)), pa.array(pair[2].view(np.int64)), pa.array(n)], ["doc_id", "row", "history", "word", "times"])

    rows = documents.select(column(documents, "doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("held_out"), column(documents, "text").alias("text"))
    tokens = landed(spark, rows.mapInArrow(spell, "doc_id long, row long, history long, word long, times long"), "katz-tokens")
    words_, grams, weights = tables(spark, path)
    seen = grams.withColumnRenamed("n", "r")
    lower = words_.withColumnRenamed("n", "c2")
    before = words_.select(F.col("word").bitwiseAND(F.lit(2**63 - 1)).alias("history"), F.col("n").alias("c1")).unionAll(
        spark.createDataFrame([(start, meta.train_docs)], "history long, c1 long"))
    j = (tokens.join(seen, ["history", "word"], "left").join(lower, "word", "left").join(before, "history", "left")
         .join(weights.select("history", "alpha"), "history", "left"))
    d = F.array(*(F.lit(x) for x in meta.discounts))
    kept = F.when(F.col("r") <= DISCOUNTED, F.get(d, (F.col("r") - 1).cast("int"))).otherwise(F.lit(LARGE)) * F.col("r")
    p = F.when(F.col("r").isNotNull(), kept / F.col("c1")).otherwise(F.coalesce("alpha", F.lit(1.0)) * (F.coalesce("c2", F.lit(0)) + ADD) / z)
    return j.groupBy("doc_id", "row").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10(p)).alias("score")).select("doc_id", "n_tokens", "score")
