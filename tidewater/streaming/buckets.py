"""T02 below the partition: an upsert target of hash buckets with versioned files.

A key belongs to one bucket for good, whatever its other columns say, so a micro-batch reads
and rewrites the buckets of its own keys and nothing else.  Layout of a target:

    data/version=<batch>/bucket=<n>/*.parquet    the buckets a batch rewrote
    manifest/<batch>/*.json                      (bucket, version) of every bucket

A batch writes its buckets beside those in use, then its manifest beside the others under a
name of its own, and renames it: that rename is the commit.  Readers take the newest
manifest, so they see a batch whole or not at all, and files of older versions stay until
``vacuum`` drops them.  A batch that runs again after its commit does nothing; one that died
before it starts over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.datasets import cdc_latest
from ..session import _file_system, path_exists, remove_path

BUCKETS = 256
#: A bucket's rows are merged and written by so many tasks, each a file of its own.
SLICES = 4
_MANIFEST = "bucket INT, version BIGINT"


def _names(spark: SparkSession, path: str) -> list[str]:
    jpath, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def versions(spark: SparkSession, target: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{target}/manifest") if n.isdigit())


def manifest(spark: SparkSession, target: str, version: int | None = None) -> dict[int, int]:
    """bucket -> version of its files, at the newest (or a given) version; at most a row a bucket."""
    held = versions(spark, target)
    if not held:
        return {}
    at = held[-1] if version is None else version
    return {r.bucket: r.version for r in spark.read.schema(_MANIFEST).json(f"{target}/manifest/{at}").collect()}


def read_buckets(spark: SparkSession, target: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the target (or of some ``buckets``) at its newest version, tombstones included."""
    held = manifest(spark, target)
    paths = [f"{target}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, target: str, version: int, held: dict[int, int]) -> None:
    stage, final = f"{target}/manifest/_{version}", f"{target}/manifest/{version}"
    spark.createDataFrame(sorted(held.items()), _MANIFEST).coalesce(1).write.mode("overwrite").json(stage)
    jpath, fs = _file_system(spark, stage)
    if not fs.rename(jpath, _file_system(spark, final)[0]):
        raise OSError(f"version {version} of {target} could not be committed")


def upsert_buckets(target: str, keys: list[str], ts: str, seq: str, op: str, buckets: int = BUCKETS, sort_by: str | None = None):
    """The ``foreachBatch`` function.  ``sort_by`` orders the rows of a bucket's files, so that a
    filter on that column skips row groups.  ``buckets`` is fixed by the first batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{target}/manifest/{batch_id}"):
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()  # used twice; a lost executor only means reading its files again
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most ``buckets`` numbers
        if touched:
            held = manifest(spark, target)
            before = read_buckets(spark, target, batch.schema, touched)
            # dealt out by bucket before the latest change is taken, so that a row is shuffled once
            slices = F.pmod(F.hash(*keys), F.lit(SLICES))
            both = batch.unionByName(before.select(*batch.columns)).withColumns({"bucket": bucket, "_slice": slices}).repartition("bucket", "_slice")
            latest = cdc_latest(both, ["bucket", "_slice", *keys], ts, seq, op, delete_flag=None).select(*batch.columns, "bucket")
            rows = latest.sortWithinPartitions("bucket", *([sort_by] if sort_by else []))
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/version={batch_id}")
            _commit(spark, target, batch_id, held | {b: batch_id for b in touched})
        batch.unpersist()

    return apply


def stream_upsert_buckets(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], ts: str, seq: str, op: str,
                          buckets: int = BUCKETS, sort_by: str | None = None) -> DataFrame:
    """T02 over new files of ``source``; returns the live rows of the target."""
    stream = spark.readStream.schema(schema).parquet(source)
    (stream.writeStream.foreachBatch(upsert_buckets(target, keys, ts, seq, op, buckets, sort_by)).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return read_buckets(spark, target, stream.schema).where(~F.coalesce(F.col(op) == "D", F.lit(False)))


def rewritten(spark: SparkSession, target: str) -> DataFrame:
    """(version, n_buckets, n_bytes) that each batch wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{target}/data")
    part = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("bigint")
    return files.select(part("version").alias("version"), part("bucket").alias("bucket"), "length").groupBy("version").agg(
        F.count_distinct("bucket").alias("n_buckets"), F.sum("length").alias("n_bytes"))


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Drop the files that none of the newest ``keep`` manifests names, and the older manifests;
    the number of dropped bucket versions."""
    held = versions(spark, target)
    kept = {(v, b) for at in held[-keep:] for b, v in manifest(spark, target, at).items()}
    dropped = 0
    for at in held[:-keep]:
        for name in _names(spark, f"{target}/data/version={at}"):
            if name.startswith("bucket=") and (at, int(name.removeprefix("bucket="))) not in kept:
                remove_path(spark, f"{target}/data/version={at}/{name}")
                dropped += 1
        remove_path(spark, f"{target}/manifest/{at}")
    return dropped
