"""Audit rows, tables without a rule, notebook lengths and result chunks of any width, on literal rows."""

from pyspark.sql import functions as F

from tidewater.operators import artifacts as ar
from tidewater.operators import telemetry as tm


def test_tables_without_rule(spark):
    rows = [(1, 0, "a", True), (1, 1, "a", False), (1, 2, "b", False), (1, 3, "b", False), (2, 0, "a", False), (2, 1, None, False)]
    lookups = spark.createDataFrame(rows, "trigger_id int, item_pos int, table_name string, rule_found boolean")
    assert sorted(map(tuple, ar.tables_without_rule(lookups).collect()), key=str) == [(1, "b"), (2, "a"), (2, None)]


def test_run_outcomes(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None), (5, 99)], "trigger_id int, run_id int")
    verdicts = spark.createDataFrame([(10, 3, False), (11, 0, True), (None, 7, False)], "run_id int, n_errors long, passed boolean")
    assert sorted(map(tuple, tm.run_outcomes(links, verdicts).collect())) == [(1, 3, False), (2, 3, False), (3, 0, True)]


def test_lengths(spark):
    books = spark.createDataFrame([("r", "abc opflag"), ("r", "ä日本"), ("r", None), ("s", "")], "repo string, content string")
    out = {r.repo: (r.n_notebooks, r.n_opflag, r.total_length, r.max_length) for r in ar.code_flags(books).collect()}
    assert out == {"r": (3, 1, 13, 10), "s": (1, 0, 0, 0)}


def test_rows_of_any_width(spark):
    bodies = ['{"result": {"schema": {"columns": [{"name": "a"}, {"name": "b"}]}, "data_array": [["1", null, "3", "4"], ["5"], []]}}',
              '{"result": {"data_array": [["x", "y"]]}}', '{"result": {}}', "no json", None]
    payloads = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = [(r.names, r["values"]) for r in tm.positional_rows(payloads).collect()]
    assert rows == [(["a", "b", "col_2", "col_3"], ["1", None, "3", "4"]), (["a"], ["5"]), (None, []), (["col_0", "col_1"], ["x", "y"])]
    cut = tm.positional_columns(payloads, 2).where(F.size("values") == 4).first()
    assert (cut.col_0, cut.col_1, cut["values"]) == ("1", None, ["1", None, "3", "4"])


def test_fanin_names_what_is_missing(spark):
    """the barrier tells which items haven't arrived, not only how many."""
    expected = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "c"), (2, "a"), (3, "x"), (3, None), (None, "a")], "g int, i string")
    arrived = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, "a"), (4, "a")], "g int, i string")
    out = tm.fanin(expected, arrived, ["g"], "i")
    got = {r.g: (r.n_expected, r.n_missing, r.missing, r.ready) for r in out.collect()}
    assert got == {1: (3, 2, ["a", "c"], False), 2: (1, 0, [], True), 3: (2, 2, [None, "x"], False), None: (1, 1, ["a"], False)}
