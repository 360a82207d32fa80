"""Helpers the operators share: written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Word characters: everything but space, tab, LF, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows per Arrow batch handed to Python; a batch of long texts stays small.
ARROW_ROWS = 500


def landed(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage ends
    here, later jobs reuse the rows, and a lost executor costs only a re-read."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def column(df: DataFrame, name: str):
    """A top-level column by its exact name (dots and clashes in extra columns don't matter)."""
    return df["`" + name.replace("`", "``") + "`"]


def text_key(text):
    """16 bytes that stand for a whole text (truncated SHA-256)."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orderable key type) as
    ``(node, root)``, root being the smallest node of the component.

    Alternating large-star and small-star rounds: every round is one aggregate and
    one join on the node, and its edges are written out, so no component, hub or
    label list is ever gathered in one place.  The number of edges never grows.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = landed(spark, e, name)
    before = None
    while True:
        e = landed(spark, _star(spark, landed(spark, _star(spark, e, name, large=True), name), name, large=False), name)
        after = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _star(spark: SparkSession, e: DataFrame, name: str, large: bool) -> DataFrame:
    """One round over edges (u > v).  Large: every larger neighbour of a node links to
    the node's smallest neighbour.  Small: every smaller-or-equal neighbour does.  The
    smallest neighbours are written first: a join of two plain shuffles is one that
    Spark can split where a hub is large."""
    if large:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = landed(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = landed(spark, e.groupBy("u").agg(F.min("v").alias("m")), name)
        out = (e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
               .select("x.*"))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


#: Bits of a membership bitmap: 8 MB however many keys it stands for.
BITMAP_BITS = 1 << 26
BLOCK_BITS = 1 << 19


def bit_of(key):
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def bitmap(spark: SparkSession, bits: DataFrame):
    """A broadcast bitmap of the column ``bit`` (numbers below ``BITMAP_BITS``).  Rows whose
    bit isn't set have no partner and stay out of a shuffle.  Its size is fixed; when it
    fills up it only lets more rows through."""

    def block(table: pa.Table) -> pa.Table:
        found = np.zeros(BLOCK_BITS, bool)
        found[table.column("bit").to_numpy() % BLOCK_BITS] = True
        where = int(table.column("bit")[0].as_py() // BLOCK_BITS)
        return pa.table({"block": pa.array([where], pa.int32()), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    blocks = bits.select("bit").distinct().groupBy((F.col("bit") / BLOCK_BITS).cast("int")).applyInArrow(block, "block int, bits binary").collect()
    whole = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in blocks:
        at = r.block * (BLOCK_BITS // 8)
        whole[at:at + BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def in_bitmap(held: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def maybe(held, bit):
    """A column: whether ``bit`` is set in the broadcast bitmap."""

    @F.pandas_udf("boolean")
    def look(b: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, b.to_numpy()))

    return look(bit)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` (integers, strings or bytes) in batches sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        table = pa.Table.from_batches([batch])
        if held:
            new[0] = any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            code = codes.indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(table.slice(at, cut - at))
            if held:
                yield pa.concat_tables(held).combine_chunks()
            held, at = [], int(cut)
        held.append(table.slice(at))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may have fewer) that end with a group, from
    batches sorted by the integer columns ``keys``.  Beyond ``rows`` only a batch and the
    group that may go on are held."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows:
            table = pa.concat_tables(held)
            other = np.zeros(table.num_rows, bool)
            for k in keys:
                values = table.column(k).to_numpy()
                other |= values != values[-1]
            cut = table.num_rows - int(other[::-1].argmax()) if other.any() else 0  # the last group may go on
            if cut:
                yield table.slice(0, cut).combine_chunks()
                table = table.slice(cut)
            held = [table]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def block_pairs(rows: DataFrame, size, block_rows: int, key) -> DataFrame:
    """Deal the rows of a group of ``size`` rows out to pairs of blocks (``pi`` <= ``pj``) of
    about ``block_rows`` rows, so that every two rows of the group meet in one pair:
    a group in one block is pair (0, 0), a larger one is replicated to its pairs."""
    blocks = F.ceil(size / F.lit(block_rows)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (rows.withColumn("other", other)
            .withColumn("pi", F.least("blk", "other")).withColumn("pj", F.greatest("blk", "other")).drop("blocks", "other"))


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row a neighbour nearer to the first row of its component (itself: none)."""
    n = len(linked)
    parent, seen = np.arange(n), np.zeros(n, bool)
    for k in range(n):
        if seen[k]:
            continue
        seen[k], todo = True, [k]
        while todo:
            one = todo.pop()
            new = np.flatnonzero(linked[one] & ~seen)
            seen[new], parent[new] = True, one
            todo += new.tolist()
    return parent
