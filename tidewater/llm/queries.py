"""The thin contract queries ``opN_<name>`` of the operators, with their SQL where SQL can say it.

Every query reads its whole table; parameters are the operators' production defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, katz, mixing, negatives, packing, secret_scan, sharding, substrings, toxicity, url_filter, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(mixing.MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: All pairs and their reachability, for a check on small tables.
VECTORS_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT k, vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v
      WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
p AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k AND len(a.e) = len(b.e)
      AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT k AS a, k AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS k, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.k GROUP BY r.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.k)::BIGINT AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c ON v.k = c.k
"""


@query(VECTORS_SQL)
def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


#: Every window by itself, for a check on small tables.
SUBSTRINGS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 18)::BIGINT)) AS k FROM d),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS h FROM i),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1 AS again FROM g),
x AS (SELECT DISTINCT doc_id, k + o AS k FROM r, range(20) t(o) WHERE again),
n AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT n.doc_id, string_agg(w[n.k], ' ' ORDER BY n.k) AS kept, count(*) AS c
      FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.k = x.k WHERE x.k IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""


@query(SUBSTRINGS_SQL)
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedupe(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(spark, table(spark, sf_dir, "documents"))
    return packing.pack(spark, parts)


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(spark, table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


@query()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
                       fingerprints.spelled(F.col("fp")).alias("fingerprint"), fingerprints.spelled(F.col("edit_fp")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("fp"), F.col("edit_fp")).alias("near_edited"),
                       fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


#: All pairs that share a shingle, and their reachability, for a check on small tables.
JACCARD_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2)::BIGINT)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS c FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON p.a = x.k JOIN n y ON p.b = y.k WHERE 5 * m >= 4 * (x.c + y.c - m)),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, min(e.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.k)::BIGINT AS n_links
FROM r JOIN d ON r.a = d.k JOIN d e ON r.b = e.k GROUP BY d.k, d.doc_id
"""


@query(JACCARD_SQL)
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query()
def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark, table(spark, sf_dir, "documents"))


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, table(spark, sf_dir, "documents"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


#: All anchors against all rows, for a check on small tables.
NEGATIVES_SQL = """
WITH t AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM t WHERE vec_id % 100 = 0) a JOIN t b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id) WHERE k <= 5 AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query(NEGATIVES_SQL)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark, table(spark, sf_dir, "embeddings").withColumn("label", moved))


#: The fixed rules of the query: (host, beginning of the path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def shouting(html):
    """Whether a page's title is cried out: the pages that the query lists."""
    return F.substring_index(html, "</title>", 1).contains("!!")


URLS_SQL = """
WITH u AS MATERIALIZED (
  SELECT row_number() OVER () AS k, page_id, contains(split_part(html, '</title>', 1), '!!') AS loud,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT k, page_id, loud, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www\\.|\\.$', '', 'g') AS h,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'ref'))) AS q FROM a),
c AS MATERIALIZED (SELECT k, page_id, loud, host, path, CASE WHEN h = '' THEN '' ELSE h || regexp_replace(path, '/+$', '') || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS page FROM b),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rh, rp, said)),
m AS (SELECT k, rh || rp AS rule, said, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
      FROM c JOIN r ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rule, page IN (SELECT page FROM c WHERE loud AND page <> '') AS listed,
  coalesce(said, CASE WHEN page IN (SELECT page FROM c WHERE loud AND page <> '') THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON c.k = m.k AND n = 1
"""


@query(URLS_SQL)
def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    loud = url_filter.pages_list(pages.where(shouting(pages["html"])), "url", "block")
    return url_filter.judged(spark, pages.select("page_id", "url"), url_filter.rules(spark, URL_RULES).unionAll(loud))
