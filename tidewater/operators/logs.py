"""Validator-log parsing.

Input ``validation_log(run_id, line_no, line)``.  The source walked one log at a
time; here a corpus of logs is parsed at once:

1. **W01 segmentation** — ``block_no`` is a running count of block-start lines.
   A plain window ``sum().over(partitionBy(run).orderBy(line_no))`` would put a
   whole run in one task, so it is an ordered scan over ranges of lines (``ordered``):
   every task reads about as many lines, however long a single run is.
2. **W03 fields** — one ``groupBy(run, block)`` with ``min_by`` per marker
   (partial + final aggregate; nothing collected).
3. **W02 last-seen file** — the same ordered scan over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    combine_output,
    field_after_last_colon,
    file_type,
    normalize_path,
    text_after_first_colon,
)
from .ordered import ordered_scan

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
BLOCK_TAGS = (
    "ERROR_OCCURRED",
    "DAG_VALIDATION_ERROR_TASK_LEVEL",
    "DAG_VALIDATION_ERROR_BASE_LEVEL",
    "CLI_DAG_VALIDATION_FAILED",
    "DAG_VALIDATION_FAILED",
)
BLOCK_START_PATTERN = r"\[(" + "|".join(BLOCK_TAGS) + r")\]"
FILE_MARKERS = ("Yaml File", "YAML File", "File Name")
FIELD_MARKERS = {
    "error_code": ("Error Code",),
    "category": ("Category",),
    "severity": ("Severity",),
    "yaml_key": ("Yaml Key", "YAML Key"),
    "task_name": ("Task Name",),
}
MESSAGE_MARKERS = ("Error Message:", "Technical Message:", "User Message:")
TAG_DEFAULT_MESSAGES = {
    "DAG_VALIDATION_FAILED": "DAG validation failed",
    "CLI_DAG_VALIDATION_FAILED": "CLI DAG validation failed",
}
# ---------------------------------------------------------------------------

def segment(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """(run_id, line_no, line, block_no, start_tag); lines before the first
    block start are dropped; the start line belongs to its block.  Lines without a run are
    one run's, lines without a number come last."""
    tag = F.regexp_extract("line", BLOCK_START_PATTERN, 1)
    d = log.select("run_id", "line_no", "line", F.nullif(tag, F.lit("")).alias("start_tag"))
    seg = ordered_scan(d, "run_id", [F.col("line_no").asc_nulls_last()], counts={"block_no": F.col("start_tag").isNotNull()}, ranges=ranges)
    return seg.where(F.col("block_no") > 0)


def _first_hit(line_no: Column, line: Column, marker: str) -> Column:
    """The earliest line of the block containing ``marker`` (substring test)."""
    return F.min_by(line, F.when(line.contains(marker), line_no))


def block_fields(seg: DataFrame) -> DataFrame:
    """W03 + F19 + F20: one row per (run, block) with the raw field values."""
    ln, line = F.col("line_no"), F.col("line")
    aggs = [F.min_by("start_tag", F.when(F.col("start_tag").isNotNull(), ln)).alias("tag")]
    for i, m in enumerate(FILE_MARKERS):
        aggs.append(_first_hit(ln, line, m).alias(f"_file{i}"))
    for name, markers in FIELD_MARKERS.items():
        for i, m in enumerate(markers):
            aggs.append(_first_hit(ln, line, m).alias(f"_{name}{i}"))
    for i, m in enumerate(MESSAGE_MARKERS):
        aggs.append(_first_hit(ln, line, m).alias(f"_msg{i}"))
    b = seg.groupBy("run_id", "block_no").agg(*aggs)

    def by_priority(prefix: str, n: int, value) -> Column:
        # the first marker that hits decides, even when its value is empty
        expr = F.lit(None).cast("string")
        for i in reversed(range(n)):
            c = F.col(f"{prefix}{i}")
            expr = F.when(c.isNotNull(), value(c)).otherwise(expr)
        return expr

    cols = [
        "run_id", "block_no", "tag",
        by_priority("_file", len(FILE_MARKERS), field_after_last_colon).alias("file_raw"),
    ]
    for name, markers in FIELD_MARKERS.items():
        cols.append(by_priority(f"_{name}", len(markers), field_after_last_colon).alias(name))
    message = by_priority("_msg", len(MESSAGE_MARKERS), text_after_first_colon)
    default = F.lit(None).cast("string")
    for tag, msg in TAG_DEFAULT_MESSAGES.items():
        default = F.when(F.col("tag") == tag, F.lit(msg)).otherwise(default)
    cols.append(F.coalesce(message, default).alias("message"))
    return b.select(*cols)


def resolve_files(fields: DataFrame, ranges: int | None = None) -> DataFrame:
    """W02 + F17: a block without a file value inherits the last file of an earlier block.
    A block whose own value normalises to nothing (only quotes) has no file at all: it
    inherits none, is dropped later, and is no last file for others."""
    f = fields.withColumn("file_norm", F.nullif(normalize_path("file_raw"), F.lit("")))
    f = ordered_scan(f, "run_id", [F.col("block_no").asc()], lasts={"last_seen_file": F.col("file_norm")}, ranges=ranges)
    return f.withColumn("file_path", F.when(F.col("file_raw").isNotNull(), F.col("file_norm")).otherwise(F.col("last_seen_file")))


def error_records(blocks: DataFrame) -> DataFrame:
    """the 7-field error of each block that has a file; ``kept`` when any
    field besides the tag is non-null."""
    fields = ["error_code", "category", "severity", "yaml_key", "message", "task_name"]
    kept = F.coalesce(*[F.col(c) for c in fields]).isNotNull()
    return blocks.where(F.col("file_path").isNotNull()).select(
        "run_id", "block_no", "file_path", file_type("file_path").alias("file_type"),
        *fields, "tag", kept.alias("kept"))


def errors_by_file(records: DataFrame) -> DataFrame:
    """Per (run, file): number of errors and its first block — files registered by a block
    with no error fields still appear, with zero errors."""
    return records.groupBy("run_id", "file_path", "file_type").agg(
        F.count_if("kept").cast("bigint").alias("n_errors"), F.min("block_no").alias("first_block"))


def file_errors(records: DataFrame) -> DataFrame:
    """The ordered errors of each file as rows (run, file, error_pos, 7 fields), in file
    and block order; a file without errors is one row with a null position.  No list of
    a file's errors is built: one window numbers the errors of a file before its other
    blocks, so a first row that is no error tells that there are none."""
    place = F.row_number().over(Window.partitionBy("run_id", "file_path").orderBy(F.desc("kept"), "block_no"))
    r = records.withColumn("error_pos", place)
    fields = ["error_code", "category", "severity", "yaml_key", "message", "task_name", "tag"]
    shown = r.where(F.col("kept") | (F.col("error_pos") == 1))
    return shown.select("run_id", "file_path", "file_type", F.when(F.col("kept"), F.col("error_pos")).cast("int").alias("error_pos"),
                        *[F.when(F.col("kept"), F.col(c)).alias(c) for c in fields])


def files_sorted(by_file: DataFrame) -> DataFrame:
    """Deterministic file order within a run (binary UTF-8 = code-point order).
    The rank window is per run over its *files* (one row per file)."""
    w = Window.partitionBy("run_id").orderBy("file_path")
    return by_file.select("run_id", "file_path", F.row_number().over(w).cast("int").alias("file_rank"))


def parse_logs(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """W01 -> W03 -> W02 -> F21: the error records of every run."""
    return error_records(resolve_files(block_fields(segment(log, ranges)), ranges))


def validation_verdict(cli: DataFrame, by_file: DataFrame) -> DataFrame:
    """Per run — combined output size, return code, passed = (code = 0), and
    the parsed file / error counts (left join: a clean run has none)."""
    runs = cli.groupBy("run_id").agg(
        F.max("return_code").cast("int").alias("return_code"),
        F.count_if(F.length(combine_output("stdout", "stderr")) > 0).cast("bigint").alias("n_output_parts"),
    )
    counts = by_file.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"), F.sum("n_errors").cast("bigint").alias("n_errors"))
    return runs.join(counts, "run_id", "left").select(
        "run_id", "return_code", (F.col("return_code") == 0).alias("passed"), "n_output_parts",
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
        F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"))


# Line breaks recognised by Python's str.splitlines() (fixed values).
SPLITLINES_PATTERN = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def split_output(raw: DataFrame, run_col: str = "run_id", text_col: str = "output") -> DataFrame:
    """Raw validator output (one text per run) -> ``validation_log(run_id, line_no, line)``
    with ``splitlines()`` semantics: a trailing line break adds no empty line."""
    pieces = F.split(F.col(text_col), SPLITLINES_PATTERN)
    trimmed = F.when(F.size(pieces) > 0, F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1))
                     .otherwise(pieces))
    return (raw.where(F.coalesce(F.length(text_col), F.lit(0)) > 0)
            .select(F.col(run_col).alias("run_id"), F.posexplode(trimmed).alias("line_no", "line"))
            .select("run_id", F.col("line_no").cast("bigint").alias("line_no"), "line"))
