"""Streaming jobs over several files, failing reads, moved keys and repeats across batches."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import datasets as ds
from tidewater.operators.dataset_run import run_dataset
from tidewater.sources import sinks
from tidewater.streaming import jobs
from tidewater.streaming.buckets import read_buckets, rewritten, stream_upsert_buckets, upsert_buckets, vacuum, versions

SCHEMA = "k INT, part STRING, v STRING, ts STRING, seq INT, op STRING"


def drop(spark, path, rows, files=3):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)


def upsert(spark, base):
    out = jobs.stream_upsert(spark, f"{base}/src", SCHEMA, f"{base}/target", f"{base}/ckpt", ["k"], "ts", "seq", "op", "part")
    return sorted((r.k, r.part, r.v) for r in out.collect())


def test_upsert_moved_keys_null_ops_and_deletes(spark, tmp_path):
    base = str(tmp_path)
    drop(spark, f"{base}/src", [(1, "a", "x", "2024-01-01 00:00:00", 1, "U"), (2, "a", "x", "2024-01-01 00:00:00", 1, None),
                                (3, "b", "x", "2024-01-01 00:00:00", 1, "U"), (4, "b", "x", "2024-01-01 00:00:00", 1, "U")])
    assert upsert(spark, base) == [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "x")]
    # 3 moves to c and leaves 4 alone in b; 1 is deleted
    drop(spark, f"{base}/src", [(3, "c", "y", "2024-02-01 00:00:00", 1, "U"), (1, "a", "y", "2024-02-01 00:00:00", 1, "D")])
    assert upsert(spark, base) == [(2, "a", "x"), (3, "c", "y"), (4, "b", "x")]
    # 4 moves too: b is left empty; an older change of 3 is ignored
    drop(spark, f"{base}/src", [(4, "c", "z", "2024-03-01 00:00:00", 1, "U"), (3, "a", "old", "2024-01-15 00:00:00", 9, "U")])
    assert upsert(spark, base) == [(2, "a", "x"), (3, "c", "y"), (4, "c", "z")]
    drop(spark, f"{base}/src", [(5, "b", "w", "2024-04-01 00:00:00", 1, "U")])
    assert upsert(spark, base) == [(2, "a", "x"), (3, "c", "y"), (4, "c", "z"), (5, "b", "w")]


def test_upsert_read_error_keeps_the_target(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/target"
    apply = jobs.upsert_batch(target, ["k"], "ts", "seq", "op", "part")
    rows = [(1, "a", "x", "2024-01-01 00:00:00", 1, "U"), (2, "a", "x", "2024-01-01 00:00:00", 1, "U")]
    apply(spark.createDataFrame(rows, SCHEMA), 0)
    later = spark.createDataFrame([(3, "a", "x", "2024-01-02 00:00:00", 1, "U")], SCHEMA)

    def fail(*_):
        raise OSError("store is away")

    with monkeypatch.context() as m:
        m.setattr(type(spark.read), "parquet", fail)
        with pytest.raises(OSError):
            apply(later, 1)
    assert spark.read.parquet(target).count() == 2
    apply(later, 1)
    apply(later, 1)  # a batch that runs again changes nothing
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_upsert_replays_from_its_stage(spark, tmp_path):
    """A crash after the stage was written and the target half replaced."""
    target = f"{tmp_path}/target"
    apply = jobs.upsert_batch(target, ["k"], "ts", "seq", "op", "part")
    apply(spark.createDataFrame([(1, "a", "x", "2024-01-01 00:00:00", 1, "U")], SCHEMA), 0)
    whole = spark.createDataFrame([(1, "a", "x", "2024-01-01 00:00:00", 1, "U"), (2, "a", "y", "2024-01-02 00:00:00", 1, "U")], SCHEMA)
    whole.write.parquet(f"{target}_stage/batch=1")
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(target)
    apply(spark.createDataFrame([(2, "a", "y", "2024-01-02 00:00:00", 1, "U")], SCHEMA), 1)
    assert sorted(r.k for r in spark.read.schema(SCHEMA).parquet(target).collect()) == [1, 2]
    assert not list(tmp_path.glob("target_stage/batch=1"))


def test_node_health_many_files_many_months(spark, tmp_path):
    src, sink, ckpt = (f"{tmp_path}/{x}" for x in ("src", "sink", "ckpt"))
    rows = spark.range(3000).select(
        (F.lit(1_700_000_000) + F.col("id") * 4000).cast("timestamp").alias("ts"), F.concat(F.lit("n"), F.col("id") % 3).alias("node_name"),
        F.when(F.col("id") % 5 == 0, "error").otherwise("ok").alias("status"), F.lit(0.004).alias("elapsed_ms"))
    for k in range(3):  # each drop has its files in no order of time
        rows.where((F.unix_seconds("ts") - 1_700_000_000) / 4_000_000 >= k).where((F.unix_seconds("ts") - 1_700_000_000) / 4_000_000 < k + 1) \
            .repartition(6).write.mode("append").parquet(src)
        out = jobs.node_health(spark, src, "ts TIMESTAMP, node_name STRING, status STRING, elapsed_ms DOUBLE", sink, ckpt)
    last = 1_700_000_000 + 2999 * 4000
    want = rows.where(F.unix_seconds("ts") - F.unix_seconds("ts") % 900 + 900 <= last - 3600).count()
    assert out.agg(F.sum("n_runs")).first()[0] == want > 2990
    assert float(out.agg(F.sum("total_ms")).first()[0]) == pytest.approx(0.004 * want)


def test_null_op_is_no_delete(spark):
    rows = [(1, "a", "x", "2024-01-01 00:00:00", 1, "U"), (1, "a", "y", "2024-01-02 00:00:00", 1, None), (2, "a", "x", "2024-01-01 00:00:00", 1, "D")]
    out = ds.cdc_latest(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "seq", "op").collect()
    assert [(r.k, r.v) for r in out] == [(1, "y")]


def test_sums_round_only_the_result(spark):
    df = spark.createDataFrame([("r", 0.004)] * 3, "region string, v double")
    assert ds.region_sum(df, ["region"], "v").first()[1] == 0.012
    big = ds.round_step(spark.createDataFrame([(1e30,), (2.345,), (None,)], "v double"), "v").collect()
    assert [r.v for r in big] == [1e30, 2.35, None]


def test_run_refuses_another_schema(spark, tmp_path):
    section = {"metadata": {"schema": [{"name": "a", "type": "int"}]}, "sync": {"overwrite_schema": False},
               "quality": {"expectations": [{"title": "t", "handler": "uniqueness", "columns": ["a"]}]}}
    src, target = f"{tmp_path}/src", f"{tmp_path}/target"
    spark.createDataFrame([("1",), ("1",)], "a string").write.parquet(src)
    out, report = run_dataset(spark, "d", section, src, target)
    assert [(r.checked, r.failed, r.verdict) for r in report.collect()] == [(2, 1, "fail")]
    other = dict(section, metadata={"schema": [{"name": "a", "type": "string"}]})
    with pytest.raises(ValueError):
        run_dataset(spark, "d", other, src, target)
    assert spark.read.parquet(target).schema["a"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        run_dataset(spark, "d", section, src, target, file_type="csv")
    assert sinks.guarded_write(spark.read.parquet(src), target, overwrite_schema=True)
    assert spark.read.parquet(target).schema["a"].dataType.simpleString() == "string"


def test_bucket_upsert_equals_the_partitioned_one(spark, tmp_path):
    base = str(tmp_path)
    drops = [[(1, "a", "x", "2024-01-01 00:00:00", 1, "U"), (2, "a", "x", "2024-01-01 00:00:00", 1, None), (3, "b", "x", "2024-01-01 00:00:00", 1, "U"),
              (4, "b", "x", "2024-01-01 00:00:00", 1, "U"), (None, "b", "null key", "2024-01-01 00:00:00", 1, "U")],
             [(3, "c", "y", "2024-02-01 00:00:00", 1, "U"), (1, "a", "y", "2024-02-01 00:00:00", 1, "D")],
             [(4, "c", "z", "2024-03-01 00:00:00", 1, "U"), (3, "a", "old", "2024-01-15 00:00:00", 9, "U"), (None, "b", "null again", "2024-01-02 00:00:00", 1, "U")],
             [(5, "b", "w", "2024-04-01 00:00:00", 1, "U"), (1, "a", "back", "2024-05-01 00:00:00", 1, "U")]]
    for rows in drops:
        drop(spark, f"{base}/src", rows)
        out = stream_upsert_buckets(spark, f"{base}/src", SCHEMA, f"{base}/target", f"{base}/ckpt", ["k"], "ts", "seq", "op", buckets=4, sort_by="part")
        seen = [r for rs in drops[:drops.index(rows) + 1] for r in rs]
        want = ds.cdc_latest(spark.createDataFrame(seen, SCHEMA), ["k"], "ts", "seq", "op")
        assert sorted(map(str, out.collect())) == sorted(map(str, want.select(*out.columns).collect()))
    again = stream_upsert_buckets(spark, f"{base}/src", SCHEMA, f"{base}/target", f"{base}/ckpt", ["k"], "ts", "seq", "op", buckets=4)
    assert again.count() == out.count() and versions(spark, f"{base}/target") == [0, 1, 2, 3]  # nothing new: no batch


def test_bucket_upsert_rewrites_what_it_touches(spark, tmp_path):
    target = f"{tmp_path}/target"
    apply = upsert_buckets(target, ["k"], "ts", "seq", "op", buckets=32)
    apply(spark.range(20_000).selectExpr("int(id) AS k", "'a' AS part", "uuid() AS v", "'2024-01-01 00:00:00' AS ts", "1 AS seq", "'U' AS op"), 0)
    for batch, keys in ((1, 1), (2, 3), (3, 0)):
        apply(spark.range(keys).selectExpr("int(id * 7) AS k", "'b' AS part", "'new' AS v", "'2024-01-02 00:00:00' AS ts", "1 AS seq", "'U' AS op"), batch)
    cost = {r.version: (r.n_buckets, r.n_bytes) for r in rewritten(spark, target).collect()}
    assert cost[0][0] == 32 and cost[1][0] == 1 and cost[2][0] <= 3 and 3 not in cost
    assert cost[1][1] < cost[0][1] / 16 and cost[2][1] < cost[0][1] * 3 / 16
    schema = spark.createDataFrame([], SCHEMA).schema
    assert read_buckets(spark, target, schema).where("v = 'new'").count() == 3 and read_buckets(spark, target, schema).count() == 20_000
    # batch 2 touched the bucket of batch 1 again, so that version and the first ones go
    assert vacuum(spark, target, keep=1) == cost[2][0] + 1 and vacuum(spark, target, keep=1) == 0
    assert read_buckets(spark, target, schema).count() == 20_000 and versions(spark, target) == [2]


def test_bucket_upsert_commits_whole_batches(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/target"
    apply = upsert_buckets(target, ["k"], "ts", "seq", "op", buckets=4)
    schema = spark.createDataFrame([], SCHEMA).schema
    apply(spark.createDataFrame([(k, "a", "x", "2024-01-01 00:00:00", 1, "U") for k in range(20)], SCHEMA), 0)
    later = spark.createDataFrame([(k, "a", "y", "2024-01-02 00:00:00", 1, "U") for k in range(5)], SCHEMA)

    def fail(*_):
        raise OSError("store is away")

    with monkeypatch.context() as m:  # the files are there, the commit isn't
        m.setattr("tidewater.streaming.buckets._commit", fail)
        with pytest.raises(OSError):
            apply(later, 1)
    assert read_buckets(spark, target, schema).where("v = 'y'").count() == 0
    apply(later, 1)
    apply(later.withColumn("v", F.lit("z")), 1)  # committed: a batch that runs again changes nothing
    assert sorted((r.v, r["count"]) for r in read_buckets(spark, target, schema).groupBy("v").count().collect()) == [("x", 15), ("y", 5)]


def test_late_rows_and_windows_make_the_input(spark, tmp_path):
    src, schema = f"{tmp_path}/src", "ts TIMESTAMP, node_name STRING, status STRING, elapsed_ms DOUBLE"
    t0 = 1_700_000_000
    drops = [[0, 100, 4000, 9000], [9500, 20_000, 300, 8000, None], [20_500, 4100, 19_000, 15_000, 40_000], [40_001, 36_000, 100, None], [400_000]]
    n = 0
    for times in drops:
        rows = [(None if t is None else t0 + t, f"n{t or 0}") for t in times]
        spark.createDataFrame(rows, "t long, node_name string").selectExpr("timestamp_seconds(t) AS ts", "node_name", "'ok' AS status", "1.0 AS elapsed_ms").repartition(2).write.mode("append").parquet(src)
        windows = jobs.node_health(spark, src, schema, f"{tmp_path}/sink", f"{tmp_path}/ckpt")
        late = jobs.late_rows(spark, src, schema, f"{tmp_path}/late", f"{tmp_path}/late-ckpt")
        n += len(times)
    counted = windows.agg(F.sum("n_runs")).first()[0]
    reasons = {r.reason: r["count"] for r in late.groupBy("reason").count().collect()}
    assert reasons["no_time"] == 2 and reasons["late"] >= 3
    assert counted + sum(reasons.values()) + 1 == n  # the last row's window is still open
