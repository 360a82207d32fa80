"""Operator 7 [native]: document fingerprints by Order MinHash, in DataFrame functions alone.

Tokens are runs of up to ``TOKEN`` characters other than white space; a k-mer is ``K``
consecutive tokens (shorter at the end of the text).  Equal k-mers are numbered by
occurrence, so repeats count, and hashed once to 63 bits.  For each of ``SLOTS`` hash
functions (that hash modulo a number of the slot) the two of all numbered k-mers with the
smallest hashes are selected, put back into text order, and hashed as a pair.  A slot
agrees only if both texts select the same k-mers in the same order, so likeness (the
share of agreeing slots) falls with edit distance, not only with shared content.

The next document (ascending doc_id) comes from a window inside ranges of doc_id, whose
bounds are quantiles; the first row of every range also goes to the range before it.  A
doc_id that fills several ranges is split by a hash of the text.

Defined cases: a null text is empty; all slots of texts without tokens agree; rows of
one doc_id are ordered by a hash of the text, equal rows follow each other; null doc_ids
come last; the only row of a table is its own next; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import column

TOKEN, K = 8, 3
SLOTS = 32
#: Ranges of doc_id per shuffle partition.
RANGES = 2
TOP = 2**63 - 1
#: Hashes a slot looks at closely, on average.
LIKELY = 16
#: The slots' moduli: odd numbers of 45 bits, spread by the golden ratio so that no two are near
#: each other or near a simple ratio.
MODULI = [2**44 + (s * 0x9E3779B97F4A7C15 % 2**64 >> 19) | 1 for s in range(1, SLOTS + 1)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``SLOTS`` integers for the string column ``text``.  Each step is a
    column of its own, so that none is evaluated once per array element."""
    names = df.columns

    def step(df, name, expr):
        return df.withColumn(name, F.expr(expr))

    df = step(df, "__h", f"transform(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]{{1,{TOKEN}}}', 0), x -> xxhash64(x))")
    df = step(df, "__k", "transform(__h, (a, i) -> shiftrightunsigned(xxhash64(a, get(__h, i + 1), get(__h, i + 2)), 1))")
    # Most texts repeat no k-mer.  Else codes and places are packed into one number each (as many bits
    # as the places need are the place's) and sorted; the runs of one code number its occurrences.
    df = step(df, "__d", "size(array_distinct(__k)) < size(__k)")
    df = step(df, "__b", "shiftleft(1L, length(bin(size(__k)))) - 1")
    df = step(df, "__s", "if(__d, sort_array(transform(__k, (c, i) -> (c & ~__b) | i)), null)")
    df = step(df, "__run", "if(__d, filter(sequence(0, greatest(size(__s), 1) - 1), j -> j = 0 or (get(__s, j) ^ get(__s, j - 1)) > __b), null)")
    df = step(df, "__p", "transform(__s, x -> cast(x & __b as int))")
    df = step(df, "__e", "if(__d, flatten(transform(__run, (a, r) -> transform(sequence(a, coalesce(get(__run, r + 1), size(__s)) - 1), "
                         "j -> shiftrightunsigned(xxhash64(get(__k, get(__p, j)), j - a), 1)))), transform(__k, c -> shiftrightunsigned(xxhash64(c, 0), 1)))")
    # Per slot: the two smallest hashes, as the text has them.  Hashes so small that only some LIKELY of
    # them are expected go on, or all if fewer than two are.  (Hashes and places are a lambda's
    # variable: a column used once would be computed again in each slot.)
    moduli = ", ".join(f"{m}L" for m in MODULI)
    limits = f"transform(array({moduli}), m -> struct(m as m, m div greatest(size(y.e), 1) * {LIKELY} as below))"
    few = "get(transform(array(filter(y.e, e -> e % m < x.below)), c -> if(size(c) >= 2, c, y.e)), 0)"
    place = "get(y.p, cast(array_position(y.e, get(k, cast(array_position(v, {0}) as int) - 1)) as int) - 1)"
    first = f"if(y.p is null, array_position(v, a) < array_position(v, b), {place.format('a')} < {place.format('b')})"
    pair = f"cast((if(b is null or {first}, xxhash64(a, b), xxhash64(b, a))) & 2147483647 as int)"
    smallest = f"get(transform(array(array_min(v)), a -> get(transform(array(array_min(array_remove(v, a))), b -> {pair}), 0)), 0)"
    slot = f"get(transform(array({few}), k -> get(transform(array(transform(k, e -> e % m)), v -> {smallest}), 0)), 0)"
    df = step(df, out, f"get(transform(array(struct(__e as e, __p as p)), y -> transform({limits}, x -> get(transform(array(x.m), m -> {slot}), 0))), 0)")
    return df.select(*names, out)


def spelled(fingerprint):
    """Eight hexadecimal digits a slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a, b):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(SLOTS))


def _place(bounds: list[int], key: str, strict: bool):
    """How many of the sorted ``bounds`` are smaller than (or equal to) column ``key``.  They are
    looked through in two steps, blocks first, so a row looks at twice their square root."""
    size = max(1, math.isqrt(len(bounds)))
    starts = F.split(F.lit(",".join(str(b) for b in bounds[::size])), ",").cast("array<bigint>")
    blocks = F.transform(F.split(F.lit(";".join(",".join(str(b) for b in bounds[k:k + size]) for k in range(0, len(bounds), size))), ";"),
                         lambda x: F.split(x, ",").cast("array<bigint>"))
    under = lambda b: b < F.col(key) if strict else b <= F.col(key)
    block = F.size(F.filter(starts, under)) - 1  # the last block that may hold the place; -1: before all
    return F.when(block < 0, 0).otherwise(block * size + F.size(F.filter(F.get(blocks, block), under)))


def with_next(spark: SparkSession, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, t: hash of the text, ...) with ``next_<c>`` for each of ``columns``: the
    value in the next row by doc_id, after the last the first."""
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(TOP))
    bounds = rows.agg(F.percentile_approx(key, [k / count for k in range(1, count)], max(10_000, 10 * count))).first()[0] or [0]
    rows = rows.withColumn("__key", key)
    rows = rows.withColumn("__lo", _place(sorted(bounds), "__key", strict=True)).withColumn("__hi", _place(sorted(bounds), "__key", strict=False))
    share = F.shiftrightunsigned("t", 1) / F.lit(float(2**63))
    crowded = F.col("__hi") - F.col("__lo") >= 2
    rows = rows.withColumn("__range", F.when(crowded, F.col("__lo") + 1 + F.least(F.floor(share * (F.col("__hi") - F.col("__lo"))), F.col("__hi") - F.col("__lo") - 1))
                           .otherwise(F.col("__hi")).cast("int")).drop("__lo", "__hi")
    rows = rows.withColumn("__place", F.struct(F.col("doc_id").isNull().alias("z"), F.col("__key").alias("d"), F.col("t").alias("t")))
    # one row a range
    firsts = sorted(rows.groupBy("__range").agg(F.min("__place").alias("first")).collect(), key=lambda r: r[0])
    ghosts = [(r[0], *r[1], firsts[k - 1][0]) for k, r in enumerate(firsts)]
    table = spark.createDataFrame(ghosts, "__range int, z boolean, d long, ft long, `to` int")
    rows = rows.join(F.broadcast(table), "__range", "left")
    is_first = F.col("__place") == F.struct(F.col("z"), F.col("d"), F.col("ft").alias("t"))
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("to").alias("r"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("__in", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))))
    order = Window.partitionBy("__in.r").orderBy("__in.ghost", "__place")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("__in.ghost = 0")
    return rows.drop("__key", "__range", "__place", "z", "d", "ft", "to", "__in")


def fingerprints(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, fingerprint and those of the next document, per document."""
    text = F.coalesce(column(documents, "text"), F.lit(""))
    rows = documents.select(column(documents, "doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    return with_next(spark, with_fingerprint(rows, "text", "fp"), ["text", "fp"])


def edited(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Every document against its edited text (the last half replaced by the start of the
    next document) and against the next document."""
    rows = fingerprints(spark, documents).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edit", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "edit", "fp", "next_fp")
    return with_fingerprint(rows, "edit", "edit_fp")
