"""Operator 1: mix sources to target weights with hash-threshold histograms.

Every row has a hash in [0, 2^60).  A source whose target is ``q`` whole copies and a
remainder takes each row ``q`` times, and the rows whose hash lies below the source's
threshold once more.  The threshold is found without sorting: words are summed by
(source, hash bucket), the bucket in which the running sum crosses the remainder is
the boundary, and only the rows of boundary buckets are summed again by the next bits,
until no boundary bucket holds more than one hash.  Thresholds nest: a larger budget
takes every row that a smaller one took.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a
source of its own, after all others; rows equal in doc_id and text share one hash and
are taken together or not at all; a null doc_id is hashed by its text alone; an empty
table gives no rows; extra columns are ignored.  The boundary hash itself is taken if
that brings the source nearer to its target, so a source misses its target by at most
half the words of the rows that share its boundary hash.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, column, landed

HASH_BITS = 60
#: Sources up to which their thresholds are broadcast.
FEW_SOURCES = 10_000
#: Bits per refinement: 4096 buckets a source, summed before the shuffle.
STEP_BITS = 12


def row_hash(doc_id, text):
    """60 bits of an MD5 over the id and the text (also computable in plain SQL)."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    text, doc_id = column(documents, "text"), column(documents, "doc_id")
    return documents.select(doc_id.alias("doc_id"), column(documents, "source").alias("source"),
                            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                            row_hash(doc_id, text).alias("h"))


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets by filling up: ``level`` words per unit of weight, no source above
    ``most`` times its size.  Each round is one aggregate over the sources; the driver
    sees two sums.  Capping a source only raises the level, so rounds end."""
    order = F.col("source").asc_nulls_last()
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # places in the order of all sources: ranges of names, numbered within and shifted by the ranges before
    ranged = landed(spark, sums.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    held = sorted(ranged.groupBy("part").count().collect())  # one row a range
    starts = list(accumulate([0, *(r["count"] for r in held)]))
    shifts = spark.createDataFrame([(r["part"], n) for r, n in zip(held, starts, strict=False)], "part int, before long")
    ranked = ranged.join(F.broadcast(shifts), "part")
    nth = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    ranked = landed(spark, ranked.select("source", "source_size", "weight"), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * most
    while True:
        fixed, free = ranked.agg(F.sum(F.when(cap <= F.col("weight") * level, cap)),
                                 F.sum(F.when(cap > F.col("weight") * level, F.col("weight")))).first()
        higher = (total - (fixed or 0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def thresholds(spark: SparkSession, documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and per source: source_size, target, whole copies and the hash
    ``edge`` up to which a row is taken once more."""
    rows = landed(spark, sized(documents), "mix-sizes")
    sources = landed(spark, source_targets(spark, rows, weights, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    # lo: every hash below is taken; below: their words
    bounds = sources.select("source", F.col("rest"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        prefix = F.shiftright("h", shift + STEP_BITS) == F.shiftright("lo", shift + STEP_BITS)
        inside = rows.where("size > 0").alias("r").join(bounds.alias("b"), F.expr("r.source <=> b.source")).where(prefix)
        sums = (inside.groupBy(F.col("r.source").alias("source"), "rest", "lo", "below", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1")))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = (sums.withColumn("upto", F.col("below") + F.sum("words").over(run))
                .withColumn("before", F.col("upto") - F.col("words")))
        # the bucket whose words reach the remainder; a remainder above all of them has no boundary
        hit = sums.where("before <= rest and rest < upto").select(
            "source", F.shiftleft("bucket", shift).alias("lo"), F.col("before").alias("below"), "words", "h0", "h1")
        bounds = landed(spark, sources.select("source", "rest").alias("s").join(hit.alias("t"), F.expr("s.source <=> t.source"), "left")
                        .select("s.source", "rest", "lo", "below", "words", "h0", "h1"), "mix-bounds")
        if not bounds.where("h0 < h1").limit(1).count():
            break
        bounds = bounds.select("source", "rest", "lo", "below")
    # take hashes up to `edge`: the boundary hash goes in if that is nearer
    edge = (F.when(F.col("words").isNull(), F.lit(-1).cast("long"))
            .when(F.col("rest") - F.col("below") > F.col("below") + F.col("words") - F.col("rest"), F.col("h0"))
            .otherwise(F.col("h0") - 1))
    cuts = sources.alias("s").join(bounds.select("source", edge.alias("edge")).alias("t"), F.expr("s.source <=> t.source"))
    cuts = cuts.select("s.source", "source_size", "target", "whole", "edge")
    # one short row a source: broadcast while there are few, so that no text is shuffled by source
    return rows, F.broadcast(cuts) if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else cuts


def mix(spark: SparkSession, documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies."""
    rows, cuts = thresholds(spark, documents, weights, most)
    out = rows.alias("r").join(cuts.alias("c"), F.expr("r.source <=> c.source"))
    copies = F.col("whole") + F.when(F.col("h") <= F.col("edge"), 1).otherwise(0)
    return out.select("doc_id", "r.source", "size", "source_size", "target",
                      (copies * F.col("size")).cast("long").alias("taken"),
                      F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"))


def repeated(spark: SparkSession, documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every document as many times as it is taken (0 to ``most``); columns
    unchanged.  Only the thresholds of each source are joined to the texts."""
    cuts = thresholds(spark, documents, weights, most)[1].select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("edge").alias("__edge"))
    rows = documents.withColumn("__h", row_hash(column(documents, "doc_id"), column(documents, "text")))
    rows = rows.join(cuts, column(rows, "source").eqNullSafe(F.col("__source")))
    copies = (F.col("__whole") + F.when(F.col("__h") <= F.col("__edge"), 1).otherwise(0)).cast("int")
    some = F.coalesce(column(documents, "text"), F.lit("")).rlike(WORD)
    rows = rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.when(some, copies).otherwise(0))))
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns))


#: The same mix by sorting, for a check on small tables.
MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
s AS (SELECT source, source_size, ((k - 1) % 3 + 1)::BIGINT AS w FROM r),
lv(level, step) AS (
  SELECT 0.0::DOUBLE, 0
  UNION ALL
  SELECT x.level, step + 1 FROM lv, LATERAL (
    SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= w * lv.level), 0))::DOUBLE
           / sum(w) FILTER (3 * source_size > w * lv.level) AS level FROM s) x
  WHERE x.level > lv.level AND step < 100),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * (SELECT max(level) FROM lv)) AS target FROM s),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY d.source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT c.source, h, (upto <= rest) OR (upto - words <= rest AND rest - (upto - words) > upto - rest) AS take
      FROM c JOIN (SELECT source, target - whole * source_size AS rest FROM q) z ON c.source IS NOT DISTINCT FROM z.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * (q.whole + CASE WHEN coalesce(e.take, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
