"""Structured Streaming jobs.  They reuse the batch
operators; every query writes through a checkpoint in the shared checkpoint
folder, so a restarted job resumes where it stopped (exactly-once file sinks).

* T01 incremental ingest  — file source, declared schema, ``availableNow``.
* T02 upsert              — ``foreachBatch``: CDC-latest over the batch plus the
  touched target partitions, staged, then dynamic partition overwrite (idempotent
  per batch: a batch that runs again repeats the overwrite from its stage).
  Deletes are kept as tombstones in the target so that batch-wise application
  equals applying the whole change log at once; readers filter them.
* T03 node health         — watermark + tumbling window aggregate, append mode.
* T04 dedupe              — ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import cdc_latest, schema_enforce
from ..session import path_exists, remove_path
from ..sources.sinks import sync_write


def incremental_ingest(spark: SparkSession, source: str, schema: str, declared: list[dict], sink: str,
                       checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Pick up only files not seen before, enforce the declared schema, append."""
    stream = spark.readStream.schema(schema).parquet(source)
    typed = schema_enforce(stream, declared)
    w = typed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.trigger(availableNow=True).start().awaitTermination()


#: Op flag of the row that keeps a partition in place after all its keys moved away.
MOVED = "M"


def upsert_batch(target: str, keys: list[str], ts: str, seq: str, op: str, part_col: str):
    """The ``foreachBatch`` function.

    A batch touches the partitions of its own rows and those that hold older versions of
    its keys (a key may change its partition).  The result is staged first; a batch that
    is run again after a crash finds its finished stage and only repeats the overwrite,
    so it never reads a target that was left half written.  Whether there is a target is
    asked of the file system; any error while reading it fails the batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{target.rstrip('/')}_stage/batch={batch_id}"
        if not path_exists(spark, f"{stage}/_SUCCESS"):
            batch = batch.persist()  # used several times; a lost executor only means reading its files again
            _merged(spark, batch).write.mode("overwrite").parquet(stage)
            batch.unpersist()
        staged = spark.read.schema(batch.schema).parquet(stage)
        if staged.isEmpty():
            remove_path(spark, stage)
            return
        sync_write(staged, target, mode="overwrite", partition_by=[part_col], dynamic=True)
        remove_path(spark, stage)

    def _merged(spark: SparkSession, batch: DataFrame) -> DataFrame:
        if not path_exists(spark, target):
            return cdc_latest_keep_deletes(batch, keys, ts, seq, op)
        current = spark.read.schema(batch.schema).parquet(target)
        same_key = [current[k].eqNullSafe(batch[k]) for k in keys]
        found = current.join(batch.select(*keys), same_key, "left_semi").select(part_col).distinct().collect()  # a row a partition
        held = spark.createDataFrame(found, batch.select(part_col).schema)  # used twice, joined once
        touched = batch.select(part_col).unionByName(held).distinct()
        # a partition column on the probe side: untouched partitions are pruned at run time
        before = current.join(touched.withColumnRenamed(part_col, "_touched"), F.col(part_col).eqNullSafe(F.col("_touched")), "left_semi")
        before = before.where(~F.col(op).eqNullSafe(MOVED))
        latest = cdc_latest_keep_deletes(batch.unionByName(before.select(*batch.columns)), keys, ts, seq, op)
        # a dynamic overwrite leaves a partition without rows as it was: one marker row replaces it
        emptied = held.distinct().join(latest.select(F.col(part_col).alias("_kept")).distinct(),
                                       F.col(part_col).eqNullSafe(F.col("_kept")), "left_anti")
        markers = emptied.select(*[F.col(f.name) if f.name == part_col else F.lit(MOVED if f.name == op else None).cast(f.dataType).alias(f.name)
                                   for f in batch.schema])
        return latest.select(*batch.columns).unionByName(markers)

    return apply


def cdc_latest_keep_deletes(df: DataFrame, keys: list[str], ts: str, seq: str, op: str) -> DataFrame:
    """W06 without dropping deletes (tombstones stay in the target)."""
    return cdc_latest(df, keys, ts, seq, op, delete_flag=None)


def stream_upsert(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
                  keys: list[str], ts: str, seq: str, op: str, part_col: str, max_files: int | None = None) -> DataFrame:
    """T02.  ``max_files`` limits a micro-batch only if the caller asks for it."""
    (_files(spark, source, schema, max_files).writeStream.foreachBatch(upsert_batch(target, keys, ts, seq, op, part_col))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(_files(spark, source, schema, None).schema).parquet(target).where(
        ~F.coalesce(F.col(op).isin("D", MOVED), F.lit(False)))


def _files(spark: SparkSession, source: str, schema: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def node_health(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                window: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Errors and latency per node in tumbling windows; a window is emitted
    once the watermark (max event time - ``delay``) passes its end.

    Each call takes all files that arrived since the last one as one micro-batch: the
    watermark moves only after the whole drop, so files of one drop can't make each
    other late.  Totals keep nine digits of every value and are not rounded per row."""
    s = _files(spark, source, schema, None)
    agg = (s.withWatermark("ts", delay)
           .groupBy(F.window("ts", window).alias("w"), "node_name")
           .agg(F.count(F.lit(1)).alias("n_runs"),
                F.count_if(F.col("status") == "error").alias("n_errors"),
                F.sum(F.col("elapsed_ms").cast("decimal(28,9)")).alias("total_ms")))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "node_name",
                     "n_runs", "n_errors", "total_ms")
    (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(sink)


def late_rows(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
              window: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """T03's side output: the rows that ``node_health`` doesn't count, with the reason: ``late`` (the
    row's window had ended at the watermark when it came) or ``no_time``.

    A stream of its own over the same files, called after the same drops: each call is one
    micro-batch, whose watermark is the largest event time of the batches before it (to the
    millisecond, as Spark keeps it) less ``delay``.  A batch writes its rows and its own
    largest time under its number, so a batch that runs again writes the same again."""
    stream = _files(spark, source, schema, None)
    marks, out = f"{sink}/times", f"{sink}/rows"

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        seen = None
        if path_exists(own, marks):
            seen = own.read.schema("batch BIGINT, top BIGINT").parquet(marks).where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]  # a row a batch
        batch = batch.persist()
        # a null time has no window, and a window column drops such rows
        named = batch.where("ts is null").withColumn("reason", F.lit("no_time"))
        if seen is not None:
            mark = F.timestamp_millis(F.lit(seen)) - F.expr(f"INTERVAL {delay}")
            timed = batch.where("ts is not null").withColumn("_end", F.window("ts", window)["end"])
            named = named.unionByName(timed.where(F.col("_end") <= mark).drop("_end").withColumn("reason", F.lit("late")))
        named.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        top = batch.agg(F.max(F.floor(F.unix_micros("ts") / 1000)).alias("top")).where("top is not null")
        top.select(F.lit(batch_id).cast("bigint").alias("batch"), F.col("top").cast("bigint").alias("top")).write.mode("overwrite").parquet(f"{marks}/part={batch_id}")
        batch.unpersist()

    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    found = spark.createDataFrame([], stream.schema.add("reason", "string"))
    return spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(out) if path_exists(spark, out) else found


def dedupe_within_watermark(spark: SparkSession, source: str, schema: str, keys: list[str], ts: str,
                            sink: str, checkpoint: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated events by key within the watermark."""
    s = spark.readStream.schema(schema).parquet(source)
    d = s.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    (d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(sink)
