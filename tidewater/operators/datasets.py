"""Declared dataset transformations (SURVEY rows P08-P12, F29, F30, W05, W06,
A05, A06, J08, J09, X01).

``STEPS`` is the step registry: a declared step name maps to a DataFrame ->
DataFrame function chained with ``DataFrame.transform``.  Script / statement text
in a spec is untrusted and is never executed; only registered steps run.

Skew: every "keep one row per key" operator here is a ``min_by`` / ``max_by``
over a struct ordering.  Spark runs it as a partial and a final sort aggregate: each
task sorts its own rows by key, and only one row per key and task is shuffled, so a
key that holds a third of the rows never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rename / upper-case columns."""
    return df.withColumnsRenamed(renames)


def column_mapping_cast(df: DataFrame, mapping: list[tuple[str, str, str]]) -> DataFrame:
    """(source_column, target_column, target_type) -> try_cast select list."""
    return df.select(*[F.col(src).try_cast(typ).alias(tgt) for src, tgt, typ in mapping])


def schema_enforce(df: DataFrame, schema: list[dict]) -> DataFrame:
    """P10: cast to the declared types (``try_cast``: a bad value becomes null)."""
    return df.select(*[F.col(c["name"]).try_cast(c["type"]).alias(c["name"]) for c in schema],
                     *[c for c in df.columns if c not in {x["name"] for x in schema}])


def cast_losses(raw: DataFrame, schema: list[dict]) -> DataFrame:
    """P10 metric: per declared column, values present in the raw drop but lost by
    the cast — one aggregate pass for all columns, then unpivoted."""
    aggs = [F.count_if(F.col(c["name"]).isNotNull() & F.col(c["name"]).try_cast(c["type"]).isNull())
            .cast("bigint").alias(c["name"]) for c in schema]
    wide = raw.agg(*aggs)
    return wide.unpivot([], [c["name"] for c in schema], "column_name", "n_lost")


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows having any null."""
    return df.na.drop(how="any")


def step_filter(df: DataFrame, predicate: str) -> DataFrame:
    """Generic filter step with a SQL predicate (pushed down by Catalyst)."""
    return df.filter(F.expr(predicate))


def to_date_step(df: DataFrame, column: str, format: str = "yyyy-MM-dd") -> DataFrame:
    """parse a date column; an unparsable value becomes null."""
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), format))


def round_step(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """HALF_UP rounding on a decimal view of the measure (double rounding can
    differ in the last digit between engines), returned as double.  Values too large
    for the view have no digits to round and stay as they are."""
    c = F.col(column)
    exact = F.round(c.cast("string").try_cast("decimal(38,12)"), digits).cast("double")
    return df.withColumn(column, F.coalesce(exact, c))


def drop_duplicates(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key; the survivor is the smallest row in ``order`` (default:
    every other column), so the result is deterministic."""
    order = order or [c for c in df.columns if c not in keys]
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def cdc_latest(df: DataFrame, keys: list[str], ts: str, seq: str, op: str, delete_flag: str | None = "D") -> DataFrame:
    """Latest change per primary key by (commit timestamp, sequence, then the
    remaining columns as tie-break); keys whose latest change is a delete vanish
    (``delete_flag`` None keeps them).  A null operation is not a delete."""
    rest = [c for c in df.columns if c not in keys]
    # zone-free ordering: the commit time as a TIMESTAMP_NTZ (no session-zone gaps)
    # the row itself in that order, so that each value is aggregated and shuffled once
    order = [F.col(ts).try_cast("timestamp_ntz").alias("_ts"), F.col(seq),
             *[F.col(c) for c in rest if c not in (ts, seq)], F.col(ts)]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_r"))
    out = last.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    return out if delete_flag is None else out.where(~F.col(op).eqNullSafe(delete_flag))


def region_sum(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Sum a measure by region, as an exact decimal (order-independent); rows keep
    nine digits and nothing is rounded before the sum."""
    return df.groupBy(*keys).agg(
        F.sum(F.col(measure).cast("decimal(28,9)")).cast("double").alias(f"sum_{measure}"))


def step_aggregation(df: DataFrame, keys: list[str], exprs: dict[str, str]) -> DataFrame:
    """Generic aggregation step: keys + named SQL aggregate expressions."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in exprs.items()])


def step_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Generic join step; ``how`` in inner / left / right / full / semi / anti.
    Cross joins are not offered."""
    allowed = {"inner", "left", "right", "full", "left_semi", "left_anti", "semi", "anti"}
    if how not in allowed:
        raise ValueError(f"join type {how!r} not supported")
    return left.join(right, on, how)


def step_enrichment(left: DataFrame, dim: DataFrame, on: list[str], order: list[str] | None = None) -> DataFrame:
    """Lookup enrichment — keeps every left row and never multiplies rows: the
    dimension is first reduced to one row per key (W05), then left-joined."""
    return left.join(drop_duplicates(dim, on, order), on, "left")


# Registered steps: declared name -> function (see testbed.specs.STEP_REGISTRY for the
# names seen in the sample specs).
STEPS: dict[str, Step] = {
    "normalize_date_columns": to_date_step,
    "remove_duplicates": drop_duplicates,
    "standardize_columns": rename_columns,
    "clean_nulls": lambda df: drop_null_rows(df),
    "currency_format": round_step,
    "aggregate_region": region_sum,
    "filter": step_filter,
    "aggregation": step_aggregation,
}


def step_pipeline(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply the declared steps in order; an unregistered step is an error."""
    for step in steps:
        fn = STEPS.get(step["name"]) or STEPS.get(step.get("type", ""))
        if fn is None:
            raise KeyError(f"step {step['name']!r} is not registered")
        df = df.transform(lambda d, f=fn, a=step.get("args", {}): f(d, **a))
    return df


def blank_as_null(c: Column) -> Column:
    return F.when(F.trim(c.cast("string")) == "", F.lit(None)).otherwise(c)
