"""Operator 13 [native]: URL filters by a blocked Bloom filter and an exact hash join.

A *list* names web addresses and their verdict: rules (a host with all its subdomains and
a beginning of the path) and single pages (canonical URLs).  Every address to judge has a
few *keys* that the list might hold: its canonical URL, and each of its host's suffixes
with each beginning of its path, but only of the label counts and path lengths that occur
in the list.  The keys of the list set bits of a blocked Bloom filter: one hash picks a
block of 512 bits, a second one a bit in each of its eight words, so a look-up touches one
block.  Its size follows the list up to ``MOST_BLOCKS`` blocks (9 MB with the block
numbers), so it can be broadcast whatever the list; a fuller filter only passes more keys.
Keys that pass go to an exact hash join with the list, which removes the false positives.
The longest rule wins; without one a listed page has the list's verdict; the rest is
allowed.

Every distinct address is judged once, so a page that fills a third of the table is one
row of the join with the list; the join back to the rows is a plain one that Spark can
split where an address is hot.  Everything is DataFrame functions.

Canonical URLs leave out the scheme, user, default port, ``www.``, fragment, slashes at the
end and tracking parameters (``TRACKING``); the other parameters are sorted.  Hosts and
paths as returned are those of the URL itself.

Defined cases: a null URL, or one without ``://``, has an empty host and path, is on no list
and is allowed; rows of one URL are judged alike and all returned, null ids included; of
rules equally long the longer host wins, then the smaller path; of several entries for one
key ``block`` wins; list entries that are null or have no host name nothing; a URL of any
length and any number of labels has as many keys as the list has label counts times path
lengths, plus one; extra columns are ignored; an empty table gives no rows, an empty list
allows everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, landed

#: Parameters that name a visit and not a page: these, and all that begin with ``utm_``.
TRACKING = ["fbclid", "gclid", "ref"]
#: Eight words of 64 bits make a block.
WORDS = 8
#: Bits of the filter per listed key, and the largest number of blocks.
BITS, MOST_BLOCKS = 16, 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://`` (empty without one)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The page that ``url`` leads to, written one way; empty if there is no host."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":(80|443)?$", ""), "^www\\.|\\.$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))
    asked = F.array_join(F.array_sort(kept), "&")
    page = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host == "", "").otherwise(F.when(asked == "", page).otherwise(F.concat(page, F.lit("?"), asked)))


def rules(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A list of rules from (host, path, verdict)."""
    return spark.createDataFrame(entries, "host string, path string, verdict string").select("host", "path", F.lit(None).cast("string").alias("page"), "verdict")


def pages_list(pages: DataFrame, url: str, verdict: str) -> DataFrame:
    """A list of the canonical URLs in column ``url``, all with one verdict."""
    none = F.lit(None).cast("string")
    return pages.select(none.alias("host"), none.alias("path"), canonical(column(pages, url)).alias("page"), F.lit(verdict).alias("verdict"))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, path)


def _page_key(page: Column) -> Column:
    return F.concat(F.lit("page "), page)


def keyed(listed: DataFrame) -> DataFrame:
    """One row per key of the list: key, host and path (null for pages), verdict."""
    rule = listed.where("host != ''").select(_rule_key(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"),
                                             F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    page = listed.where("host is null and page != ''").select(_page_key(F.col("page")).alias("key"), F.lit(None).cast("string").alias("host"),
                                                             F.lit(None).cast("string").alias("path"), "verdict")
    both = rule.unionAll(page).where("verdict is not null")
    # a rule's key can be cut in two ways (host, path); the host ends where the path's slash begins
    return both.groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _bits(key: Column) -> list[Column]:
    """The bit of ``key`` in each word of its block, from a second hash."""
    second = F.xxhash64(F.lit("second"), key)
    # F.shiftleft takes a fixed distance, SQL's takes a column
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of column ``key``: at most ``blocks`` rows of a block number and eight words."""
    bits = keys.select(_block(F.col("key"), blocks), *(b.alias(f"w{w}") for w, b in enumerate(_bits(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))


def blocks_for(keys: int) -> int:
    return min(MOST_BLOCKS, max(1, 1 << math.ceil(math.log2(max(1, keys * BITS / (64 * WORDS))))))


def passing(keys: DataFrame, held: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` whose column ``key`` the filter may hold.  The filter is broadcast:
    it has at most ``MOST_BLOCKS`` rows."""
    near = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(held), "block")
    hit = F.lit(True)
    for w, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{w}").bitwiseAND(bit) != 0)
    return near.where(hit).drop("block", *(f"w{w}" for w in range(WORDS)))


def judged(spark: SparkSession, pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, listed (the page itself is on the list), verdict per row."""
    entries = landed(spark, keyed(listed), "urls-list")
    # lengths and label counts that rules have: at most as many as the longest rule is long
    shape = entries.where("host is not null").agg(F.collect_set(F.length("path")).alias("lengths"), F.collect_set(F.size(F.split("host", "\\."))).alias("labels"),
                                                  F.count(F.lit(1)).alias("n")).first()
    blocks = blocks_for(entries.count())
    held = bloom(entries, blocks)

    own = column(pages, url)
    rows = pages.select(column(pages, page_id).alias("page_id"), host_of(own).alias("host"), path_of(own).alias("path"), canonical(own).alias("page"))
    rows = rows.select("page_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "page")))
    address = rows.select("host", "path", "page").distinct()

    ints = lambda xs: F.array(*(F.lit(int(x)) for x in sorted(xs))).cast("array<int>")
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.filter(ints(shape.labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    starts = F.transform(F.filter(ints(shape.lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: _rule_key(s, p))))
    keys = address.select("host", "path", "page", F.explode(F.array_distinct(F.concat(found, F.array(_page_key(F.col("page")))))).alias("key"))
    maybe = passing(keys, held, blocks)

    entry = entries.select("key", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("said"))
    hits = maybe.join(entry.hint("shuffle_hash"), "key")
    # keys cut elsewhere than the address is cut: "a" + "b/" is no rule "ab" + "/"
    fits = F.col("rule_host").isNull() | (F.concat(F.lit("."), F.col("host")).endswith(F.concat(F.lit("."), F.col("rule_host"))) & F.col("path").startswith(F.col("rule_path")))
    rule = F.when(F.col("rule_host").isNotNull(), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
                                                           F.concat("rule_host", "rule_path").alias("rule"), F.col("said").alias("said")))
    best = hits.where(fits).groupBy("host", "path", "page").agg(
        F.max(rule).alias("best"), F.max(F.when(F.col("rule_host").isNull(), F.col("said"))).alias("said"))
    out = rows.join(best, ["host", "path", "page"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("said").isNotNull().alias("listed"),
                      F.coalesce("best.said", "said", F.lit("allow")).alias("verdict"))
