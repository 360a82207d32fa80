"""Operator 5: pack token sequences by the sum-of-squares rule.

Every document becomes its token ids plus an end id; longer ones are cut into pieces of
the capacity.  Pieces are dealt at random into groups of bounded size, and each group is
packed by one task from piece lengths alone, longest first: a piece goes where the sum of
squares of the numbers of open sequences per residual gap becomes smallest (ties: the
smallest gap).  Unequal gaps stay in stock that way, so small pieces find exact fits.  A
group leaves at most a few open sequences, so the loss against one global packing is a
small constant per ``GROUP_PIECES`` pieces.

Defined cases: a null or empty text is the end id alone; repeated rows are pieces of their
own; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, landed, small_batches

CAPACITY = 4096
END = 1
#: Pieces in a group on average; a group's lengths and ids take a few MB.
GROUP_PIECES = 50_000
#: Words a task remembers the ids of.
KNOWN_WORDS = 500_000
#: Fixed value: the tokenizer's own split.  It is used only on texts of the characters
#: below, where lower-casing, normal form and character classes leave no doubt.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\s\\w]|[_²³¹¼½¾])+"
UNSURE = "[^\\t\\n\\r\\x20-\\x7e¡-©«-±´¶-¸»¿-ĮĲ-ɏ]|<\\|"


def byte_letters() -> dict[int, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(other)}


def word_encoder(path: str):
    """``encode(text)`` -> little-endian unsigned 32-bit ids as bytes, the same as the
    tokenizer's own, with the ids of known words looked up."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    model, letters = coder.model, byte_letters()
    split, unsure = re.compile(SPLIT), re.compile(UNSURE)

    def packed(numbers: list[int]) -> bytes:
        return array("I", numbers).tobytes()

    class Known(dict):
        """Ids of words and of the parts that punctuated words are split into."""

        def __missing__(self, word: str) -> bytes:
            parts = [word] if word.isalpha() else split.findall(word)
            if len(parts) == 1:
                part = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                ids = packed([t.id for t in model.tokenize(part)])
            else:
                ids = b"".join([self[p] for p in parts])
            self[word] = ids
            return ids

    known = Known()

    def encode(text: str) -> bytes:
        if unsure.search(text):
            return packed(coder.encode(text, add_special_tokens=False).ids)
        if len(known) > KNOWN_WORDS:
            known.clear()
        return b"".join(map(known.__getitem__, text.lower().split()))

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    small_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = word_encoder(tokenizer or default_tokenizer()), np.array([end], "<u4").tobytes()
        for batch in batches:
            owner, piece, size, crc, held = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = encode(text or "") + tail
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at:at + 4 * capacity]
                    owner.append(k)
                    piece.append(at // (4 * capacity))
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int32))
            piece = np.array(piece, np.int32)
            cols = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            cols += [pa.array(held, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return documents.select(column(documents, "doc_id").cast("long").alias("doc_id"),
                            column(documents, "text").alias("text")).mapInArrow(task, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length, longest placed first."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; none is counted at gap 0
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        gaps = np.flatnonzero(count[size:]) + size
        best = capacity
        if len(gaps):
            left = count[gaps - size]
            gain = 2 * (left - count[gaps]) + 2 - (gaps == size)
            pick = int(gain.argmin())
            if gain[pick] <= 2 * count[capacity - size] + 1:
                best = int(gaps[pick])
        if best == capacity:
            number, made = made, made + 1
        else:
            number = stock[best].pop()
            count[best] -= 1
        where[k], offset[k] = number, capacity - best
        if best > size:
            stock[best - size].append(number)
            count[best - size] += 1
    return where, offset


def pack(spark: SparkSession, parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (with a ``length`` column and any others) plus sequence_id and offset."""
    parts = landed(spark, parts, "pack-pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    # numbered over written files, so a task that runs again deals its rows out alike
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def task(table: pa.Table) -> pa.Table:
        where, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        first = table.column("grp")[0].as_py() << 32
        return (table.drop_columns(["grp"]).append_column("sequence_id", pa.array(where + first))
                .append_column("offset", pa.array(offset)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInArrow(task, schema)
