"""Folder trees as tables: bulk file contents and listings (S01, S02), scans driven by
computed paths (S09) and lineage from the names of the files that are read (S11).

A tree is listed by Spark's file source, never by a loop of calls: a listing reads no
content, a glob or a filter on ``_metadata`` keeps files out of the scan, and what a job
reads is a plain file scan that Spark splits over its tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import qualified_path
from .readers import file_lineage

#: Rows of named folders that are sent to every task at most; more are shuffled.
BROADCAST_ROWS = 100_000


def _plain(path: Column) -> Column:
    """A file's path as the file system writes it: one slash after the scheme of a path without a
    host, no URL escapes."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^(\\w+):/+(?=/)", "$1:")


def _below(spark: SparkSession, root: str, path: Column) -> Column:
    """``path`` relative to ``root``."""
    base = qualified_path(spark, root).rstrip("/")
    return F.substring(path, len(base) + 2, 1 << 20)


def file_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root`` as (path relative to it, length, modified, content); ``glob``
    filters file names.  ``content`` is only read if it is used.  Spark's file sources leave
    out files of no bytes, so they aren't in the tree."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return files.select(_below(spark, root, F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def repo_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A tree laid out ``<repo>/<ref>/<path>`` as (repo, ref, path, length, content)."""
    parts = F.split("path", "/", 3)
    return file_tree(spark, root, glob).select(F.get(parts, F.lit(0)).alias("repo"), F.get(parts, F.lit(1)).alias("ref"), F.get(parts, F.lit(2)).alias("path"), "length", "content")


def tree_folders(files: DataFrame) -> DataFrame:
    """The folders (repo, ref, path) that hold the files, at every depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where(F.size(parts) > 1).select("repo", "ref", F.explode(above).alias("path")).distinct()


def decode_tree(files: DataFrame, requests: DataFrame) -> DataFrame:
    """S01 in bulk: decoded UTF-8 text per requested (repo, ref, path), with the outcomes ok,
    directory, not_found and bad_payload (bytes that are no UTF-8)."""
    keys = ["repo", "ref", "path"]
    held = files.select(*keys, F.col("content").alias("_bytes"), F.lit(True).alias("_file"))
    folders = tree_folders(files).withColumn("_folder", F.lit(True))
    j = requests.join(held, keys, "left").join(folders, keys, "left")
    text = F.try_validate_utf8(F.col("_bytes").cast("string"))
    outcome = (F.when(F.col("_file") & text.isNotNull(), F.lit("ok")).when(F.col("_file"), F.lit("bad_payload"))
               .when(F.col("_folder"), F.lit("directory")).otherwise(F.lit("not_found")))
    return j.select(*keys, outcome.alias("outcome"), F.when(F.col("_file"), text).alias("text"))


def list_tree(files: DataFrame) -> DataFrame:
    """S02 in bulk: the direct children of every folder as (repo, ref, dir, name, path, type)."""
    entries = files.select("repo", "ref", "path", F.lit("file").alias("type")).unionByName(tree_folders(files).withColumn("type", F.lit("dir")))
    return entries.select("repo", "ref", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.substring_index("path", "/", -1).alias("name"), "path", "type")


def read_paths(spark: SparkSession, root: str, wanted: DataFrame, schema: str, fmt: str = "parquet", options: dict[str, str] | None = None,
               path: str = "path") -> DataFrame:
    """Read the folders that ``wanted`` names (column ``path``, relative to ``root``, with or
    without a slash at the end) in one scan: its other columns beside every row of the folder's files.

    Folders that aren't there are no error.  Those that are there and wanted are listed once
    and become the scan's paths, as many as the file index holds anyway, so files of other
    folders are neither opened nor listed again.  A folder that several rows of ``wanted``
    name gives its rows to each of them; who only sums a folder's rows names it once and joins
    the sums.  How ``wanted`` is joined goes by its counted rows: paths made from ranges of days
    are many times what a planner guesses from the rows that they came from."""
    folder = F.regexp_replace(path, "/+$", "")
    wanted = wanted.withColumn(path, folder)
    there = file_tree(spark, root).select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias(path)).distinct()
    named = wanted.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    found = there.join(named.hint("merge"), path).select(path, "n").collect()  # one row a folder of the index
    fields = spark.createDataFrame([], schema).schema.fields
    if not found:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return wanted.where(F.lit(False)).select(path, *nothing, *[c for c in wanted.columns if c != path])
    base = root.rstrip("/")
    rows = spark.read.format(fmt).schema(schema).options(**(options or {})).load([f"{base}/{r[0]}" for r in found])
    at = F.regexp_extract(_below(spark, root, _plain(F.col("_metadata.file_path"))), r"^(.*)/[^/]*$", 1)
    held = F.broadcast(spark.createDataFrame([(r[0],) for r in found], StructType([StructField(path, StringType())])))
    wanted = wanted.join(held, path, "left_semi")
    how = "broadcast" if sum(r[1] for r in found) <= BROADCAST_ROWS else "merge"
    return rows.select(*[f"`{f.name}`" for f in fields], at.alias(path)).join(wanted.hint(how), path)


def with_file_lineage(rows: DataFrame) -> DataFrame:
    """S11 on files as read: ``rows`` (a file scan) with the entity, extract date, extract time and
    CDC sequence that the name of each row's file tells; null for other names."""
    return rows.select("*", *file_lineage(F.col("_metadata.file_name")))


def extracted_since(rows: DataFrame, day: str) -> DataFrame:
    """The rows of a file scan whose files were extracted on ``day`` or later.  The condition is on
    ``_metadata`` alone, so Spark leaves other files out when it lists them."""
    stamp = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{8})_\d{6}_cdc_\d+\.\w+$", 1)
    return rows.where(stamp >= F.lit(day.replace("-", "")))


def latest_by_lineage(changes: DataFrame, keys: list[str], op: str, tie: list[str], delete_flag: str = "D") -> DataFrame:
    """The last change per key in the order of the files it came in (extract date, time and
    sequence; then ``tie`` within a file); keys whose last change is a delete vanish.  Rows of
    files without lineage have no place in that order and are left out."""
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct("extract_date", "extract_time", "cdc_seq", *tie, *[c for c in rest if c not in tie and not c.startswith("extract_") and c != "cdc_seq"])
    placed = changes.where("extract_date is not null and extract_time is not null and cdc_seq is not null")
    last = placed.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    out = last.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    return out.where(~F.col(op).eqNullSafe(delete_flag))
