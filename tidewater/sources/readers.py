"""Declared-task readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python strftime directives used by ``date_format`` -> Spark patterns.
STRFTIME_TO_SPARK = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def read_parquet_task(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S07 + S10: parquet drop; ``key=value`` folders become partition columns
    (``basePath`` keeps discovery anchored), so a filter on them prunes folders."""
    r = spark.read.option("basePath", path)
    if schema:
        r = r.schema(schema)
    return r.parquet(path)


def read_csv_task(spark: SparkSession, path: str, schema: str, *, has_header: bool = False,
                  separator: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """Explicit schema (no inference pass), declared header / separator /
    encoding; every file in the directory (``multiples_files``)."""
    return (spark.read.schema(schema).option("header", str(has_header).lower())
            .option("sep", separator).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))


def read_format(spark: SparkSession, fmt: str, path: str, options: dict[str, str] | None = None,
                schema: str | None = None) -> DataFrame:
    """One reader for any declared ``format`` with free ``options``."""
    r = spark.read.format(fmt).options(**(options or {}))
    if schema:
        r = r.schema(schema)
    return r.load(path)


def expand_date_paths(runs: DataFrame, template: Column, run_date: Column, day_range: Column,
                      date_pattern: Column, backfill_from: Column | None = None, keep_day: str | None = None) -> DataFrame:
    """One row per concrete path of a run: ``:date:`` replaced by every day of
    [run_date - day_range, run_date] (or [backfill_from, run_date] when given),
    formatted with the run's (Spark) pattern, the day itself as ``keep_day`` if named.  Fan-out
    is bounded by the range; ``trees.read_paths`` reads the result in one scan."""
    start = F.date_sub(run_date, day_range.cast("int"))
    if backfill_from is not None:
        start = F.coalesce(backfill_from, start)
    ex = runs.withColumn("_pattern", date_pattern).withColumn(
        "_day", F.explode(F.sequence(start, run_date, F.expr("INTERVAL 1 DAY"))))
    ex = ex.withColumn("path", F.replace(template, F.lit(":date:"), F.expr("date_format(_day, _pattern)"))).drop("_pattern")
    return ex.withColumnRenamed("_day", keep_day) if keep_day else ex.drop("_day")


# Fixed value: the lineage pattern of CDC file names, e.g. TVRO_20240601_213804_cdc_1.parquet
FILE_LINEAGE_PATTERN = r"^(.+)_(\d{8})_(\d{6})_cdc_(\d+)\.[A-Za-z0-9]+$"


def file_lineage(name: Column) -> list[Column]:
    """Entity, extract date / time and CDC sequence recovered from a file name.
    Zone-free: the date is a DATE, the time a validated ``HH:mm:ss`` string."""
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    ent = F.nullif(F.regexp_extract(base, FILE_LINEAGE_PATTERN, 1), F.lit(""))
    day = F.nullif(F.regexp_extract(base, FILE_LINEAGE_PATTERN, 2), F.lit(""))
    tim = F.regexp_extract(base, FILE_LINEAGE_PATTERN, 3)
    seq = F.nullif(F.regexp_extract(base, FILE_LINEAGE_PATTERN, 4), F.lit("")).cast("int")
    valid_time = tim.rlike(r"^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]$")
    hms = F.when(valid_time, F.concat_ws(":", F.substring(tim, 1, 2), F.substring(tim, 3, 2), F.substring(tim, 5, 2)))
    return [ent.alias("entity"), F.try_to_date(day, "yyyyMMdd").alias("extract_date"), hms.alias("extract_time"),
            seq.alias("cdc_seq")]
