"""One declared dataset, end to end, as one Spark job graph:

read (S07/S08) -> schema enforce (P10) -> registered steps (X01) ->
completeness observed *during* the write (``Observation``, no extra scan) ->
guarded, partitioned sync (S13-S15) -> uniqueness over the written rows -> report (A10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as rd
from ..sources import sinks as sk
from .datasets import schema_enforce, step_pipeline
from .quality import report_row, row_fails, uniqueness, with_verdict


def run_dataset(spark: SparkSession, name: str, section: dict, source_path: str, target_path: str,
                file_type: str = "parquet", read_schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The target read back and the quality report (A10), one row per expectation."""
    schema = section["metadata"]["schema"]
    if file_type == "parquet":
        raw = rd.read_parquet_task(spark, source_path, read_schema)
    elif read_schema:
        raw = rd.read_csv_task(spark, source_path, read_schema)
    else:
        raise ValueError(f"a {file_type} source has no schema of its own: declare one")
    typed = schema_enforce(raw, schema)
    stepped = step_pipeline(typed, section.get("transformations", {}).get("steps", []))

    expectations = section.get("quality", {}).get("expectations", [])
    obs = Observation(f"quality of {name}")
    observed = stepped.observe(obs, F.count(F.lit(1)).alias("checked"), *[
        F.coalesce(F.sum(row_fails(e).cast("bigint")), F.lit(0)).alias(f"failed_{k}")
        for k, e in enumerate(expectations) if e["handler"] == "completeness"])

    sync = section.get("sync", {})
    custom = (sync.get("delta_config") or {}).get("custom_config") or {}
    dynamic = custom.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"
    kw = {"mode": sync.get("mode", "overwrite"), "partition_by": sync.get("partition_by") or None, "dynamic": dynamic}
    if not sk.guarded_write(observed, target_path, overwrite_schema=bool(sync.get("overwrite_schema", True)), **kw):
        raise ValueError(f"dataset {name}: the batch's schema differs from the target's and overwrite_schema is false")
    out = spark.read.parquet(target_path)
    seen = obs.get
    # uniqueness needs a shuffle by the key: one grouped aggregate over the written rows
    parts = []
    for pos, e in enumerate(expectations):
        if e["handler"] == "completeness":
            numbers = spark.range(1).select(F.lit(seen["checked"]).cast("bigint").alias("checked"), F.lit(seen[f"failed_{pos}"]).cast("bigint").alias("failed"))
        else:
            numbers = uniqueness(out, e["columns"]).select(F.coalesce("checked", F.lit(0)).alias("checked"), F.col("surplus_rows").alias("failed"))
        parts.append(report_row(name, pos, e, numbers))
    report = reduce(DataFrame.unionByName, parts) if parts else with_verdict(report_row(name, 0, {"title": "", "handler": "", "columns": []}, spark.range(0).select(
        F.lit(0).cast("bigint").alias("checked"), F.lit(0).cast("bigint").alias("failed"))))
    return out, with_verdict(report) if parts else report
