"""Streaming queries.  Each writes its input drops and
checkpoints under a fresh folder of the shared checkpoint folder, runs the
stream to completion (``availableNow``) and returns the sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import telemetry as te
from testbed import landing as ld

from ..session import scratch_path
from ..sources.tables import Tables
from ..streaming import jobs
from ..streaming.buckets import stream_upsert_buckets
from . import q_datasets as qd
from .registry import ORACLES, query

ORDERS_LANDING_SCHEMA = ", ".join(f"{n} STRING" for n, _ in ld.ORDERS_LANDING)


@query("T01", "stream_incremental_ingest", qd.W(qd._OL, qd._OT) + "SELECT * FROM ot")
def q_stream_incremental_ingest(spark, sf_dir):
    base = scratch_path(spark, "stream-ingest")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    landing = ld.orders_landing(Tables(spark, sf_dir))
    # two drops; the second run must pick up only the new files
    landing.where(F.col("o_orderkey").cast("bigint") % 2 == 0).write.mode("append").parquet(src)
    jobs.incremental_ingest(spark, src, ORDERS_LANDING_SCHEMA, qd.ORDERS_SCHEMA, sink, ckpt)
    landing.where(F.col("o_orderkey").cast("bigint") % 2 == 1).write.mode("append").parquet(src)
    jobs.incremental_ingest(spark, src, ORDERS_LANDING_SCHEMA, qd.ORDERS_SCHEMA, sink, ckpt)
    return spark.read.parquet(sink)


@query("T02", "stream_upsert", ORACLES["cdc_latest"])
def q_stream_upsert(spark, sf_dir):
    base = scratch_path(spark, "stream-upsert")
    src, target, ckpt = f"{base}/source", f"{base}/target", f"{base}/checkpoint"
    li = ld.lineitem_landing(Tables(spark, sf_dir)).withColumn("part", F.substring("commit_ts", 1, 4))
    schema = ld.LINEITEM_SCHEMA + ", part STRING"
    # three change drops, each applied as one micro-batch that touches the partitions of its
    # years and those that keys with changes in several years move away from
    for k in range(3):
        li.where(F.col("part").cast("int") % 3 == k).write.mode("append").parquet(src)
        out = jobs.stream_upsert(spark, src, schema, target, ckpt, ["l_orderkey", "l_linenumber"],
                                 "commit_ts", "seq", "opflag", "part")
    cols = [c.split()[0] for c in ld.LINEITEM_SCHEMA.split(", ")]
    return out.select(*cols)


def _epoch_ltz():
    """The zone-less ``ts`` as an instant (its wall time read as UTC), independent
    of the session time zone."""
    return F.timestamp_micros(F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))


def _time_span(df, drop: int, drops: int):
    """The rows of the ``drop``-th of so many equal spans of ``ts`` (over any number of months)."""
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        return df
    edge = [lo + (hi + 1 - lo) * k // drops for k in range(drops + 1)]
    at = F.unix_micros("ts")
    return df.where((at >= edge[drop]) & (at < edge[drop + 1]))


@query("T03", "stream_node_health", """
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, node_name, count(*) AS n_runs,
  count(*) FILTER (WHERE node_name = 'error') AS n_errors, CAST(sum(CAST(value * 10 AS DECIMAL(28,9))) AS DOUBLE) AS total_ms
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ws, event_type AS node_name, value FROM events)
WHERE ws + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY ws, node_name""")
def q_stream_node_health(spark, sf_dir):
    base = scratch_path(spark, "stream-health")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    runs = te.node_runs(Tables(spark, sf_dir)).select(_epoch_ltz().alias("ts"), "node_name", "status", "elapsed_ms")
    for drop in range(4):  # drops in event-time order, each of several files
        _time_span(runs, drop, 4).repartition(3, F.unix_micros("ts")).write.mode("append").parquet(src)
        out = jobs.node_health(spark, src, "ts TIMESTAMP, node_name STRING, status STRING, elapsed_ms DOUBLE", sink, ckpt)
    return out.select(F.unix_seconds("window_start").alias("window_start"), "node_name", "n_runs", "n_errors",
                      F.col("total_ms").cast("double").alias("total_ms"))


#: A row comes with the drop of its time, every seventeenth two drops later.
_DROPS = 5
_LATE_SQL = f"""d AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS w_end,
  least({_DROPS - 1}, CAST(floor((epoch_us(ts) - lo) * {_DROPS} / (hi + 1 - lo)) AS INTEGER) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END) AS drop_no
  FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)),
wm AS (SELECT k, (SELECT max(ts) FROM d WHERE drop_no < k) - INTERVAL 1 HOUR AS mark FROM range({_DROPS}) r(k))"""


@query("T03", "stream_late_rows", f"""WITH {_LATE_SQL}
SELECT event_id, event_type AS node_name, 'late' AS reason FROM d JOIN wm ON drop_no = k WHERE w_end <= mark""")
def q_stream_late_rows(spark, sf_dir):
    base = scratch_path(spark, "stream-late")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    events = Tables(spark, sf_dir).events.select("event_id", F.col("event_type").alias("node_name"), _epoch_ltz().alias("ts"))
    at = F.unix_micros("ts")
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    own = F.floor((at - lo) * _DROPS / (hi + 1 - lo)).cast("int") if lo is not None else F.lit(0)
    drops = events.withColumn("_drop", F.least(F.lit(_DROPS - 1), own + F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)))
    for k in range(_DROPS):
        drops.where(F.col("_drop") == k).drop("_drop").repartition(3, "event_id").write.mode("append").parquet(src)
        out = jobs.late_rows(spark, src, "event_id BIGINT, node_name STRING, ts TIMESTAMP", sink, ckpt)
    return out.select("event_id", "node_name", "reason")


@query("T02", "stream_upsert_buckets", ORACLES["cdc_latest"])
def q_stream_upsert_buckets(spark, sf_dir):
    base = scratch_path(spark, "stream-buckets")
    src, target, ckpt = f"{base}/source", f"{base}/target", f"{base}/checkpoint"
    li = ld.lineitem_landing(Tables(spark, sf_dir)).withColumn("part", F.substring("commit_ts", 1, 4))
    for k in range(3):  # the drops of stream_upsert
        li.where(F.col("part").cast("int") % 3 == k).write.mode("append").parquet(src)
        out = stream_upsert_buckets(spark, src, ld.LINEITEM_SCHEMA + ", part STRING", target, ckpt, ["l_orderkey", "l_linenumber"], "commit_ts", "seq", "opflag",
                                    buckets=32, sort_by="commit_ts")
    return out.select(*[c.split()[0] for c in ld.LINEITEM_SCHEMA.split(", ")])


@query("T04", "stream_dedupe", """
SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events""")
def q_stream_dedupe(spark, sf_dir):
    base = scratch_path(spark, "stream-dedupe")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    ev = Tables(spark, sf_dir).events.select(
        "user_id", "event_type", F.to_date("ts").alias("day"), _epoch_ltz().alias("ts"))
    for drop in range(5):  # spans end inside a day, so keys of that day come again in the next drop
        _time_span(ev, drop, 5).write.mode("append").parquet(src)
        out = jobs.dedupe_within_watermark(spark, src, "user_id BIGINT, event_type STRING, day DATE, ts TIMESTAMP",
                                           ["user_id", "event_type", "day"], "ts", sink, ckpt)
    return out.select("user_id", "event_type", "day")
