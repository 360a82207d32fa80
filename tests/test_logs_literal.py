"""Validator logs of our own, run through the Spark operators end to end."""

from tidewater.operators import logs as lg

LOG = """\
starting up, nothing to see: yet
Yaml File: ignored/before-any-block.yaml
[ERROR_OCCURRED] loader stopped
   Error Code: Z-17
   Category: LOAD
   Severity: LOW
   User Message: the bucket "north" is empty: add files
   Yaml File: `//etl/north.yaml`
10:42 | [DAG_VALIDATION_ERROR_TASK_LEVEL]
   Task Name: copy_north
   Yaml Key: retries
   Error Message: expected a number
[DAG_VALIDATION_ERROR_BASE_LEVEL] | File Name: "jobs/South.IPYNB"
   YAML Key: owner
   Technical Message: unknown owner
[DAG_VALIDATION_FAILED]
   Yaml File: ''
[CLI_DAG_VALIDATION_FAILED]
[ERROR_OCCURRED]
   Yaml File: etl/empty.yml
"""


def records(spark, text, ranges=None):
    raw = spark.createDataFrame([(1, text)], "run_id INT, output STRING")
    return lg.parse_logs(lg.split_output(raw), ranges=ranges)


def test_blocks_files_and_fields(spark):
    got = [(r.block_no, r.file_path, r.file_type, r.error_code, r.yaml_key, r.task_name, r.message, r.kept)
           for r in records(spark, LOG).orderBy("block_no").collect()]
    assert got == [
        (1, "/etl/north.yaml", "yaml", "Z-17", None, None, 'the bucket "north" is empty: add files', True),
        (2, "/etl/north.yaml", "yaml", None, "retries", "copy_north", "expected a number", True),  # inherits the file
        (3, "jobs/South.IPYNB", "ipynb", None, "owner", None, "unknown owner", True),
        # block 4 has a file value of quotes alone: no file, so it is dropped and not inherited
        (5, "jobs/South.IPYNB", "ipynb", None, None, None, "CLI DAG validation failed", True),
        (6, "etl/empty.yml", "yaml", None, None, None, None, False),
    ]


def test_ordered_errors_of_each_file(spark):
    got = [(r.file_path, r.error_pos, r.tag, r.message) for r in lg.file_errors(records(spark, LOG)).orderBy("file_path", "error_pos").collect()]
    assert got == [
        ("/etl/north.yaml", 1, "ERROR_OCCURRED", 'the bucket "north" is empty: add files'),
        ("/etl/north.yaml", 2, "DAG_VALIDATION_ERROR_TASK_LEVEL", "expected a number"),
        ("etl/empty.yml", None, None, None),
        ("jobs/South.IPYNB", 1, "DAG_VALIDATION_ERROR_BASE_LEVEL", "unknown owner"),
        ("jobs/South.IPYNB", 2, "CLI_DAG_VALIDATION_FAILED", "CLI DAG validation failed"),
    ]


def test_chunked_scan_equals_single_pass(spark):
    text = LOG * 4
    a, b = records(spark, text), records(spark, text, ranges=9)  # forces many ranges and carries across them
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_line_breaks_and_lines_before_the_first_block(spark):
    raw = spark.createDataFrame([(7, "noise\r\n[DAG_VALIDATION_FAILED]\rYaml File: a.yaml last\n"), (8, ""), (9, None)], "run_id INT, output STRING")
    lines = lg.split_output(raw)
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [
        (0, "noise"), (1, "[DAG_VALIDATION_FAILED]"), (2, "Yaml File: a.yaml"), (3, "last")]
    assert [r.line_no for r in lg.segment(lines).orderBy("line_no").collect()] == [1, 2, 3]
