"""Validator-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import artifacts as tb

from ..functions.exprs import combine_output, field_after_last_colon, file_type
from ..operators import logs as lg
from ..sources.tables import Tables
from . import sqlkit as k
from .registry import query


def _log(spark, sf_dir):
    return tb.render_validation_log(Tables(spark, sf_dir))


def _blocks(spark, sf_dir):
    return lg.resolve_files(lg.block_fields(lg.segment(_log(spark, sf_dir))))


def _records(spark, sf_dir):
    return lg.error_records(_blocks(spark, sf_dir))


# ------------------------------- oracle SQL --------------------------------

def _last_colon(x: str) -> str:
    return f"CASE WHEN contains({x}, ':') THEN nullif({k.strip(f'string_split({x}, chr(58))[-1]')}, '') END"


def _first_colon(x: str) -> str:
    return f"CASE WHEN contains({x}, ':') THEN nullif({k.strip(f'substr({x}, instr({x}, chr(58)) + 1)')}, '') END"


def _prio(prefix: str, n: int, fn) -> str:
    whens = " ".join(f"WHEN {prefix}{i} IS NOT NULL THEN {fn(f'{prefix}{i}')}" for i in range(n))
    return f"CASE {whens} END"


def _norm(x: str) -> str:
    p = f"regexp_replace({k.strip(x)}, '^[`''\"]+|[`''\"]+$', '', 'g')"
    return f"CASE WHEN starts_with({p}, '//') THEN substr({p}, 2) ELSE {p} END"


def _ftype(x: str) -> str:
    return (f"CASE WHEN ends_with(lower({x}), '.yaml') OR ends_with(lower({x}), '.yml') THEN 'yaml' "
            f"WHEN ends_with(lower({x}), '.py') THEN 'py' WHEN ends_with(lower({x}), '.ipynb') THEN 'ipynb' "
            f"ELSE 'unknown' END")


_hits = []
for _i, _m in enumerate(lg.FILE_MARKERS):
    _hits.append(f"arg_min(line, line_no) FILTER (WHERE contains(line, '{_m}')) AS _file{_i}")
for _name, _ms in lg.FIELD_MARKERS.items():
    for _i, _m in enumerate(_ms):
        _hits.append(f"arg_min(line, line_no) FILTER (WHERE contains(line, '{_m}')) AS _{_name}{_i}")
for _i, _m in enumerate(lg.MESSAGE_MARKERS):
    _hits.append(f"arg_min(line, line_no) FILTER (WHERE contains(line, '{_m}')) AS _msg{_i}")
_fields = ",\n  ".join(
    f"{_prio(f'_{n}', len(ms), _last_colon)} AS {n}" for n, ms in lg.FIELD_MARKERS.items())
_default = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in lg.TAG_DEFAULT_MESSAGES.items())

LOG_CTES = f"""WITH lines AS ({tb.log_lines_sql()}),
lst AS (SELECT run_id, line_no, line, nullif(regexp_extract(line, '{lg.BLOCK_START_PATTERN}', 1), '') AS start_tag FROM lines),
seg AS (SELECT * FROM (SELECT *, sum(CASE WHEN start_tag IS NOT NULL THEN 1 ELSE 0 END) OVER
  (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block_no FROM lst) WHERE block_no > 0),
raw AS (SELECT run_id, block_no, arg_min(start_tag, line_no) FILTER (WHERE start_tag IS NOT NULL) AS tag,
  {", ".join(_hits)} FROM seg GROUP BY run_id, block_no),
fld AS (SELECT run_id, block_no, tag, {_prio('_file', len(lg.FILE_MARKERS), _last_colon)} AS file_raw,
  {_fields},
  coalesce({_prio('_msg', len(lg.MESSAGE_MARKERS), _first_colon)}, CASE tag {_default} END) AS message FROM raw),
fn AS (SELECT *, nullif({_norm('file_raw')}, '') AS file_norm FROM fld),
blk AS (SELECT *, CASE WHEN file_raw IS NOT NULL THEN file_norm ELSE last_seen_file END AS file_path FROM (SELECT *, last_value(file_norm IGNORE NULLS) OVER
  (PARTITION BY run_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen_file FROM fn)),
rec AS (SELECT run_id, block_no, file_path, {_ftype('file_path')} AS file_type, error_code, category, severity,
  yaml_key, message, task_name, tag,
  coalesce(error_code, category, severity, yaml_key, message, task_name) IS NOT NULL AS kept
  FROM blk WHERE file_path IS NOT NULL),
byf AS (SELECT run_id, file_path, file_type, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS n_errors,
  min(block_no) AS first_block FROM rec GROUP BY run_id, file_path, file_type)
"""

# --------------------------------- queries ---------------------------------


@query("W01", "log_block_segment", LOG_CTES + "SELECT run_id, line_no, CAST(block_no AS BIGINT) AS block_no FROM seg")
def q_log_block_segment(spark, sf_dir):
    return lg.segment(_log(spark, sf_dir)).select("run_id", "line_no", "block_no")


@query("W02", "last_seen_file", LOG_CTES + """
SELECT run_id, CAST(block_no AS BIGINT) AS block_no, file_norm, last_seen_file, file_path FROM blk""")
def q_last_seen_file(spark, sf_dir):
    log = _log(spark, sf_dir)
    b = lg.resolve_files(lg.block_fields(lg.segment(log)))
    return b.select("run_id", "block_no", "file_norm", "last_seen_file", "file_path")


@query("W03", "first_match_in_block", LOG_CTES + """
SELECT run_id, CAST(block_no AS BIGINT) AS block_no, tag, file_raw, error_code, category, severity, yaml_key,
  task_name, message FROM fld""")
def q_first_match(spark, sf_dir):
    f = lg.block_fields(lg.segment(_log(spark, sf_dir)))
    return f.select("run_id", "block_no", "tag", "file_raw", "error_code", "category", "severity",
                    "yaml_key", "task_name", "message")


@query("F17", "normalize_path", LOG_CTES + """
SELECT run_id, CAST(block_no AS BIGINT) AS block_no, file_raw, file_norm FROM fn WHERE file_raw IS NOT NULL""")
def q_normalize_path(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.where(F.col("file_raw").isNotNull()).select("run_id", "block_no", "file_raw", "file_norm")


@query("F18", "file_type", LOG_CTES + "SELECT DISTINCT file_path, file_type FROM rec")
def q_file_type(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("file_path", file_type("file_path").alias("file_type")).distinct()


@query("F19", "field_after_colon", f"WITH lines AS ({tb.log_lines_sql()})\n"
       f"SELECT run_id, line_no, {_last_colon('line')} AS field FROM lines")
def q_field_after_colon(spark, sf_dir):
    return _log(spark, sf_dir).select("run_id", "line_no", field_after_last_colon("line").alias("field"))


@query("F20", "message_text", LOG_CTES + "SELECT run_id, CAST(block_no AS BIGINT) AS block_no, tag, message FROM fld")
def q_message_text(spark, sf_dir):
    f = lg.block_fields(lg.segment(_log(spark, sf_dir)))
    return f.select("run_id", "block_no", "tag", "message")


@query("F21", "error_record", LOG_CTES + """
SELECT run_id, CAST(block_no AS BIGINT) AS block_no, file_path, file_type, error_code, category, severity,
  yaml_key, message, task_name, tag, kept FROM rec""")
def q_error_record(spark, sf_dir):
    return _records(spark, sf_dir)


_E7 = "error_code, category, severity, yaml_key, message, task_name, tag"


@query("A04", "errors_by_file", LOG_CTES + f"""
SELECT run_id, file_path, file_type, CAST(row_number() OVER (PARTITION BY run_id, file_path ORDER BY block_no) AS INTEGER) AS error_pos,
  {_E7} FROM rec WHERE kept
UNION ALL SELECT run_id, file_path, file_type, NULL, {", ".join(["NULL"] * 7)} FROM byf WHERE n_errors = 0""")
def q_errors_by_file(spark, sf_dir):
    """From the raw output of each run (one text), as the validator prints it."""
    raw = tb.render_raw_output(Tables(spark, sf_dir))
    return lg.file_errors(lg.parse_logs(lg.split_output(raw)))


@query("O01", "errors_sorted", LOG_CTES + """
SELECT run_id, file_path, CAST(row_number() OVER (PARTITION BY run_id ORDER BY file_path) AS INTEGER) AS file_rank
FROM byf""")
def q_errors_sorted(spark, sf_dir):
    return lg.files_sorted(lg.errors_by_file(_records(spark, sf_dir)))


_CLI = f"cli AS (SELECT {tb.fixture_sql(tb.CLI_FIXTURE)} FROM events)"
_COMBINE = "coalesce(concat_ws(chr(10), nullif(stdout, ''), nullif(stderr, '')), '')"


VERDICT_SQL = f"""SELECT r.run_id, r.return_code, r.return_code = 0 AS passed, r.n_output_parts,
  CAST(coalesce(b.n_files, 0) AS BIGINT) AS n_files, CAST(coalesce(b.n_errors, 0) AS BIGINT) AS n_errors
FROM (SELECT run_id, CAST(max(return_code) AS INTEGER) AS return_code,
        CAST(count(*) FILTER (WHERE length({_COMBINE}) > 0) AS BIGINT) AS n_output_parts FROM cli GROUP BY run_id) r
LEFT JOIN (SELECT run_id, count(*) AS n_files, sum(n_errors) AS n_errors FROM byf GROUP BY run_id) b
  ON r.run_id = b.run_id"""


def verdicts(spark, sf_dir):
    cli = tb.render_cli_results(Tables(spark, sf_dir))
    return lg.validation_verdict(cli, lg.errors_by_file(_records(spark, sf_dir)))


@query("A11", "validation_verdict", LOG_CTES.rstrip() + ",\n" + _CLI + "\n" + VERDICT_SQL)
def q_validation_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query("F16", "combine_output", f"WITH {_CLI}\nSELECT event_id, {_COMBINE} AS combined FROM cli")
def q_combine_output(spark, sf_dir):
    cli = tb.render_cli_results(Tables(spark, sf_dir))
    return cli.select("event_id", combine_output("stdout", "stderr").alias("combined"))
