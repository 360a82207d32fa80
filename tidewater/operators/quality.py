"""Quality expectations.

* completeness — one aggregate pass computes every listed column of a dataset;
* uniqueness   — one grouped aggregate per key set (partial + final), then a
  second tiny aggregate over the duplicate groups;
* primary key  — null keys and duplicate keys from the declared pk columns;
* report       — one row per expectation.

No ``count()`` action per expectation: each dataset is scanned once per
expectation kind, and the numbers come back as DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .datasets import blank_as_null


def completeness(df: DataFrame, columns: list[str], blank_is_null: bool = False) -> DataFrame:
    """(column_name, checked, non_null, share) — share as decimal(9,6)."""
    aggs = [F.count(F.lit(1)).alias("_checked")]
    for c in columns:
        v = blank_as_null(F.col(c)) if blank_is_null else F.col(c)
        aggs.append(F.count(v).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot(["_checked"], columns, "column_name", "non_null")
    return long.select(
        "column_name", F.col("_checked").cast("bigint").alias("checked"),
        F.col("non_null").cast("bigint").alias("non_null"),
        F.when(F.col("_checked") > 0, (F.col("non_null") / F.col("_checked")).cast("decimal(9,6)")).alias("share"))


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """(checked, distinct_keys, duplicate_groups, surplus_rows) for a key set.
    Rows whose key contains a null are grouped like any other value."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.sum("n").cast("bigint").alias("checked"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"),
    )


def primary_key_check(df: DataFrame, pk: list[str]) -> DataFrame:
    """Null pk rows and duplicate pk groups in one grouped aggregate."""
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in pk]) if len(pk) > 1 else F.col(pk[0]).isNull().cast("int")
    g = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"), F.max(any_null).alias("has_null"))
    return g.agg(
        F.sum("n").cast("bigint").alias("checked"),
        F.coalesce(F.sum(F.when(F.col("has_null") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
        F.count_if((F.col("n") > 1) & (F.col("has_null") == 0)).cast("bigint").alias("duplicate_groups"),
        F.coalesce(F.sum(F.when((F.col("n") > 1) & (F.col("has_null") == 0), F.col("n") - 1)), F.lit(0))
        .cast("bigint").alias("surplus_rows"),
    )


def row_fails(e: dict) -> Column:
    """Whether a row fails a completeness expectation: a null (or blank) in any column."""
    blank = bool((e.get("arguments") or {}).get("blank_as_null"))
    return reduce(lambda a, b: a | b, [(blank_as_null(F.col(c)) if blank else F.col(c)).isNull() for c in e["columns"]])


def report_row(dataset: str, pos: int, e: dict, numbers: DataFrame) -> DataFrame:
    """``numbers`` (checked, failed) of one expectation as a report row."""
    if e["handler"] not in ("completeness", "uniqueness", ""):
        raise ValueError(f"unknown handler {e['handler']!r}")
    return numbers.select(
        F.lit(dataset).alias("dataset"), F.lit(pos).cast("int").alias("exp_pos"), F.lit(e["title"]).alias("title"),
        F.lit(e["handler"]).alias("handler"), F.lit(",".join(e["columns"])).alias("columns"),
        "checked", F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"))


def with_verdict(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("checked") > 0, ((F.col("checked") - F.col("failed")) / F.col("checked")).cast("decimal(9,6)"))
    return rows.select("*", rate.alias("pass_rate"), F.when(F.col("failed") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"))


def expectation_report(dataset: str, df: DataFrame, expectations: list[dict]) -> DataFrame:
    """A10: one row per expectation: dataset, title, handler, columns, checked,
    failed, pass_rate, verdict.  Completeness fails rows with a null (or blank)
    in any listed column, and all completeness expectations of a dataset are one
    aggregate; uniqueness fails the surplus rows of duplicate keys."""
    unknown = [e["handler"] for e in expectations if e["handler"] not in ("completeness", "uniqueness")]
    if unknown:
        raise ValueError(f"unknown handlers {unknown}")
    complete = [(k, e) for k, e in enumerate(expectations) if e["handler"] == "completeness"]
    parts = []
    if complete:
        wide = df.agg(F.count(F.lit(1)).alias("checked"), *[F.coalesce(F.sum(row_fails(e).cast("bigint")), F.lit(0)).alias(f"f{k}") for k, e in complete])
        each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("exp_pos"), F.lit(e["title"]).alias("title"), F.lit(e["handler"]).alias("handler"),
                                            F.lit(",".join(e["columns"])).alias("columns"), F.col(f"f{k}").alias("failed")) for k, e in complete]))
        parts.append(wide.select("checked", each.alias("x")).select(F.lit(dataset).alias("dataset"), "x.exp_pos", "x.title", "x.handler", "x.columns", "checked", "x.failed"))
    for k, e in enumerate(expectations):
        if e["handler"] == "uniqueness":
            parts.append(report_row(dataset, k, e, uniqueness(df, e["columns"]).select("checked", F.col("surplus_rows").alias("failed"))))
    return with_verdict(reduce(DataFrame.unionByName, parts))
