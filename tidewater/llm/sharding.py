"""Operator 6 [native]: shard rows through fixed virtual slots.

Rows are hashed into ``SLOTS`` virtual slots, bytes and rows are summed per slot, and a
versioned table maps slots to shards.  A run loads the newest version of the stored map
(version 0, the first, deals the slots out in equal runs), edits it (moves or swaps single
slots between the fullest and the emptiest shard until they are within ``SLACK`` of each
other) and stores the result as the next version, unless nothing had to move.  So rows of
an unmoved slot stay where they were, from run to run.  More shards get slots by the same
edits; the slots of shards that are gone go to the emptiest ones first.  The law is
``bytes``: shards end up near equal in bytes.

The map has ``SLOTS`` rows whatever the input, so the driver may hold and edit it and
executors may get it by broadcast; rows and texts never reach the driver.

Defined cases: a null text has size 1 (no bytes, plus one) and the CRC of no bytes;
equal rows (doc_id and text) are counted before the shuffle and get consecutive places;
rows of one doc_id with other texts fall into other slots, so no id is a hot slot; an
empty table gives no rows; extra columns are ignored; a stored map of another number of
slots is an error.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, path_exists
from .shared import column, landed

SLOTS = 4096
#: Fullest and emptiest shard may differ by this share of the mean; nothing moves below it.
SLACK = 0.0005
MAP = "vslot int, shard int, bytes long, n_rows long"
#: Copies of one row that one task numbers; more are split over tasks.
CHUNK = 100_000


def hashed(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot per row."""
    doc_id, text = column(documents, "doc_id"), column(documents, "text")
    body = F.coalesce(text, F.lit("")).cast("binary")
    return documents.select(doc_id.alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                            F.crc32(body).alias("text_crc32"),
                            F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int").alias("vslot"))


def first_map(slots: int, shards: int) -> list[int]:
    return [v * shards // slots for v in range(slots)]


def rebalanced(sizes: list[int], shard_of: list[int], shards: int, slack: float = SLACK) -> list[int]:
    """The next version of the map.  While it helps and is needed, the fullest shard gives the
    emptiest one a slot, or swaps one, whichever brings the two nearest to each other."""
    shard_of = list(shard_of)
    homeless = sorted((v for v, s in enumerate(shard_of) if s >= shards), key=lambda v: -sizes[v])
    kept = [0] * shards
    for v, s in enumerate(shard_of):
        if s < shards:
            kept[s] += sizes[v]
    for v in homeless:
        shard_of[v] = min(range(shards), key=kept.__getitem__)
        kept[shard_of[v]] += sizes[v]
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    for v, s in enumerate(shard_of):
        held[s].append((sizes[v], v))
        load[s] += sizes[v]
    for h in held:
        h.sort()
    for _ in range(4 * len(sizes)):
        full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[low]
        if gap <= slack * sum(load) / shards:
            break
        best = None  # (what is left of the gap, slot to move, slot to take back)
        for back in [(0, -1), *held[low]]:
            k = bisect_left(held[full], (back[0] + gap // 2, -1))
            for give in held[full][max(0, k - 1):k + 1]:
                shift = give[0] - back[0]
                if 0 < shift < gap:
                    found = (abs(gap - 2 * shift), give, back)
                    best = min(best, found) if best else found
        if best is None or best[0] >= gap:
            break
        _, give, back = best
        held[full].remove(give)
        held[low].insert(bisect_left(held[low], give), give)
        shard_of[give[1]] = low
        if back[1] >= 0:
            held[low].remove(back)
            held[full].insert(bisect_left(held[full], back), back)
            shard_of[back[1]] = full
        load[full] -= give[0] - back[0]
        load[low] += give[0] - back[0]
    return shard_of


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a stored map."""
    if not path_exists(spark, path):
        return []
    return sorted(r[0] for r in spark.read.schema(f"{MAP}, version int").parquet(path).select("version").distinct().collect())


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest (or a given) version of a stored map: vslot, shard, bytes, n_rows, version."""
    at = map_versions(spark, path)[-1] if version is None else version
    return spark.read.schema(f"{MAP}, version int").parquet(path).where(F.col("version") == at)


def slot_map(spark: SparkSession, rows: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Bring the map stored at ``path`` (none: a new one in the shared folder) up to date with
    ``rows`` and return its newest version with what its slots hold now."""
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex[:12]}"
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")).collect()
    size, count = [0] * slots, [0] * slots
    for r in found:  # at most `slots` rows
        size[r.vslot], count[r.vslot] = r.bytes, r.n_rows

    def store(version: int, shard_of: list[int]) -> None:
        table = [(v, s, size[v], count[v]) for v, s in enumerate(shard_of)]
        spark.createDataFrame(table, MAP).coalesce(1).write.parquet(f"{path}/version={version}")

    versions = map_versions(spark, path)
    if not versions:
        store(0, first_map(slots, shards))
        versions = [0]
    held = {r.vslot: r.shard for r in load_map(spark, path, versions[-1]).collect()}  # one row a slot
    if len(held) != slots:
        raise ValueError(f"the map at {path} has {len(held)} slots, not {slots}")
    before = [held[v] for v in range(slots)]
    after = rebalanced(size, before, shards)
    if after != before:
        store(versions[-1] + 1, after)
        versions.append(versions[-1] + 1)
    now = [(versions[-1], v, s, size[v], count[v]) for v, s in enumerate(after)]
    return spark.createDataFrame(now, "version int, vslot int, shard int, bytes long, n_rows long")


def shard(spark: SparkSession, documents: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (its place in the shard,
    gapless from 0), vslot, map_version.  ``map_path`` names the stored map to go on from."""
    rows = landed(spark, hashed(documents, slots), "sharded")
    table = slot_map(spark, rows, shards, slots, map_path)
    place = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("start", F.coalesce(F.sum("n_rows").over(place), F.lit(0)))
    same = ["vslot", "doc_id", "size", "text_crc32"]
    run = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    counted = (rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))))
    chunks = counted.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    one_each = chunks.withColumn("k", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + CHUNK, F.col("n")) - 1)))
    return one_each.join(F.broadcast(table.select("vslot", "shard", "start", "version")), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before") + F.col("k")).alias("slot"),
        "vslot", F.col("version").alias("map_version"))
