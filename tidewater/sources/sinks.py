"""Declared sync sinks.

Parquet targets (Delta / Iceberg jars are not available here); the declared
``partitionOverwriteMode=dynamic`` is honoured with Spark's own dynamic partition
overwrite, so only the partitions present in a batch are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import path_exists


def sync_write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
               dynamic: bool = False) -> None:
    """Write with the declared mode and partition columns.

    ``REBALANCE`` by the partition columns brings the rows of a value into few files,
    and splits a hot value over as many tasks as its size needs."""
    w = df
    if partition_by:
        w = w.hint("rebalance", *partition_by)
    writer = w.write.mode(mode)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def schema_diff(target: StructType, batch: StructType, spark: SparkSession) -> DataFrame:
    """One row per differing field (full outer on the field name):
    added / removed / type_changed.  Empty means the batch may be written."""
    t = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in target.fields],
                              "field STRING, target_type STRING")
    b = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in batch.fields],
                              "field STRING, batch_type STRING")
    j = t.join(b, "field", "full_outer")
    change = (F.when(F.col("target_type").isNull(), F.lit("added"))
              .when(F.col("batch_type").isNull(), F.lit("removed"))
              .when(F.col("target_type") != F.col("batch_type"), F.lit("type_changed")))
    return j.select("field", "target_type", "batch_type", change.alias("change")).where(F.col("change").isNotNull())


def guarded_write(df: DataFrame, path: str, overwrite_schema: bool, **kw) -> bool:
    """Refuse a batch whose schema differs from that of the target's files unless
    ``overwrite_schema`` is set; then the whole target is replaced.  Returns whether the
    write happened.  A target that isn't there yet takes any schema."""
    spark = df.sparkSession
    if path_exists(spark, path):
        target = spark.read.parquet(path).schema
        if not schema_diff(_nullable(target), _nullable(df.schema), spark).isEmpty():
            if not overwrite_schema:
                return False
            kw["dynamic"] = False
            kw["mode"] = "overwrite"
    sync_write(df, path, **kw)
    return True


def _nullable(schema: StructType) -> StructType:
    """The same fields by name: partition columns come last when files are read, and come back
    with the type that their folder names suggest."""
    return StructType(sorted(schema.fields, key=lambda f: f.name))


def write_state_json(df: DataFrame, path: str) -> None:
    """Persist run records as JSON lines (one object per row)."""
    df.write.mode("overwrite").json(path)


def landed_counts(df: DataFrame, phase: str, path: str) -> DataFrame:
    """(phase, field, field_type, n_values) of a table as its files are now, written to ``path``
    so that a later change of the files doesn't change the rows."""
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    wide = df.agg(*[F.count(f.name).alias(f.name) for f in df.schema])
    rows = wide.unpivot([], df.columns, "field", "n_values")
    rows.select(F.lit(phase).alias("phase"), "field", types[F.col("field")].alias("field_type"), "n_values").write.parquet(path)
    return df.sparkSession.read.parquet(path)
