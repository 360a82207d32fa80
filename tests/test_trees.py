"""Scans over real folders: only wanted files are opened, names tell runs and order."""

import os

import duckdb
import pytest
from compare import compare
from pyspark.sql import functions as F

from tidewater.operators import specs as sp
from tidewater.plans import ORACLES, QUERIES
from tidewater.sources import trees as ft


def parquet(spark, path, rows, schema="k INT, v STRING"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def broken(path):
    os.makedirs(path)
    with open(f"{path}/part-0.parquet", "wb") as f:
        f.write(b"no parquet at all")


def test_paths_of_all_runs_in_one_scan(spark, tmp_path):
    for day, rows in {"20240101": [(1, "a")], "20240102": [(2, "b"), (3, "c")], "2024 01+03%": [(4, "d")]}.items():
        parquet(spark, tmp_path / "x" / day / "part", rows)
    broken(str(tmp_path / "x" / "20240109" / "part"))  # nobody wants it, so nobody opens it
    wanted = spark.createDataFrame([("r1", "x/20240101/part/"), ("r1", "x/20240102/part/"), ("r2", "x/20240102/part"), ("r2", "x/20240105/part/"), ("r3", "x/2024 01+03%/part/"),
                                    ("r4", "nothing/here/")], "run string, path string")
    out = ft.read_paths(spark, str(tmp_path), wanted, "k INT, v STRING")
    assert sorted((r.run, r.path, r.k, r.v) for r in out.collect()) == [
        ("r1", "x/20240101/part", 1, "a"), ("r1", "x/20240102/part", 2, "b"), ("r1", "x/20240102/part", 3, "c"), ("r2", "x/20240102/part", 2, "b"), ("r2", "x/20240102/part", 3, "c"),
        ("r3", "x/2024 01+03%/part", 4, "d")]
    none = ft.read_paths(spark, str(tmp_path), wanted.where("run = 'r4'"), "k INT, v STRING")
    assert none.count() == 0 and set(none.columns) == {"k", "v", "path", "run"}
    assert len(ft.read_paths(spark, str(tmp_path), wanted, "k INT, v STRING").inputFiles()) == 3


def test_many_wanted_rows_are_not_broadcast(spark, tmp_path):
    """a planner guesses the rows of a fan-out from what was fanned out, and broadcast them all."""
    parquet(spark, tmp_path / "x" / "day0" / "part", [(1, "a"), (2, "b")])
    parquet(spark, tmp_path / "x" / "day1" / "part", [(3, "c"), (4, "d")])
    wanted = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.lit(60_000))).alias("run"), F.concat(F.lit("x/day"), "id", F.lit("/part/")).alias("path"))
    many = ft.read_paths(spark, str(tmp_path), wanted, "k INT, v STRING")
    few = ft.read_paths(spark, str(tmp_path), wanted.where("run = 5"), "k INT, v STRING")
    joins = ["SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() for df in (many, few)]
    assert joins == [True, False] and (many.count(), few.count()) == (240_000, 4)


def test_a_folder_of_many_runs_is_read_once(spark, tmp_path, monkeypatch):
    """runs name the same folders; the rows of a folder go beside no run, its sums do."""
    spark.range(3000).selectExpr("id AS o_orderkey", "CAST(id / 7 AS DOUBLE) AS o_totalprice", "CAST(date_add(DATE'1992-01-01', CAST(id % 900 AS INT)) AS TIMESTAMP) AS o_orderdate",
                                 "CAST(id % 5 + 1 AS STRING) || '-X' AS o_orderpriority").selectExpr("*", "1L AS o_custkey", "'F' AS o_orderstatus").unionAll(
        spark.sql("SELECT 1L, CAST(NULL AS DOUBLE), TIMESTAMP'1992-02-03', '1-X', 1L, 'F'")).write.parquet(str(tmp_path / "orders.parquet"))
    keys = spark.range(120).unionAll(spark.range(10)).unionAll(spark.sql("SELECT CAST(NULL AS LONG)"))
    keys.selectExpr("id AS s_suppkey", "CAST(1 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    named, read = [], ft.read_paths
    monkeypatch.setattr(ft, "read_paths", lambda s, root, wanted, *rest: named.extend(r.path for r in wanted.select("path").collect()) or read(s, root, wanted, *rest))
    con = duckdb.connect()
    for t in ("orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    r = compare(QUERIES["date_path_read"](spark, str(tmp_path)), ORACLES["date_path_read"], con)
    assert r["ok"] and r["spark_rows"] > 50, r
    assert len(named) == len(set(named)) > 0


def cdc(spark, root, name, rows):
    stage = f"{root}-stage-{name}"
    parquet(spark, stage, rows, "k INT, v STRING, op STRING")
    part = next(f for f in os.listdir(stage) if f.startswith("part-"))
    os.makedirs(root, exist_ok=True)
    os.rename(f"{stage}/{part}", f"{root}/{name}")


def test_lineage_orders_changes(spark, tmp_path):
    root = str(tmp_path / "cdc")
    cdc(spark, root, "TVRO_20240601_213804_cdc_9.parquet", [(1, "old", "U"), (2, "old", "U"), (3, "only", "U")])
    cdc(spark, root, "TVRO_20240601_213804_cdc_10.parquet", [(1, "mid", "U"), (2, "gone", "D")])  # 10 comes after 9
    cdc(spark, root, "TVRO_20240601_230000_cdc_1.parquet", [(1, "new", None)])
    cdc(spark, root, "VBAK_20240530_235959_cdc_99.parquet", [(1, "earlier", "D"), (4, "back", "D")])
    cdc(spark, root, "TVRO_20240602_250000_cdc_1.parquet", [(1, "no such time", "U")])
    cdc(spark, root, "manifest_1.parquet", [(1, "no lineage", "U"), (5, "no lineage", "U")])
    rows = spark.read.schema("k INT, v STRING, op STRING").parquet(root)
    changes = ft.with_file_lineage(rows)
    told = {r.v: (r.entity, str(r.extract_date), r.extract_time, r.cdc_seq) for r in changes.collect()}
    assert told["mid"] == ("TVRO", "2024-06-01", "21:38:04", 10) and told["no lineage"] == (None, "None", None, None)
    last = ft.latest_by_lineage(changes, ["k"], "op", tie=["v"])
    assert sorted((r.k, r.v) for r in last.collect()) == [(1, "new"), (3, "only")]


def test_old_files_are_left_out_of_the_listing(spark, tmp_path):
    root = str(tmp_path / "cdc")
    cdc(spark, root, "TVRO_20240601_213804_cdc_1.parquet", [(1, "new", "U")])
    with open(f"{root}/TVRO_20240531_213804_cdc_1.parquet", "wb") as f:
        f.write(b"broken")
    rows = spark.read.schema("k INT, v STRING, op STRING").parquet(root)
    assert [r.v for r in ft.extracted_since(rows, "2024-06-01").collect()] == ["new"]
    with pytest.raises(Exception):
        rows.collect()


def test_tree(spark, tmp_path):
    for path, body in {"r/main/a/b.txt": b"hello", "r/main/a/c/d.yaml": "ä".encode(), "r/dev/e.txt": b"\xc3\x28", "r/main/a/empty.txt": b""}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(body)
    files = ft.repo_tree(spark, str(tmp_path))
    asked = spark.createDataFrame([("r", "main", p) for p in ("a/b.txt", "a", "a/c", "a/c/d.yaml", "a/none", "a/empty.txt")] + [("r", "dev", "e.txt"), ("q", "main", "a")], "repo string, ref string, path string")
    out = {(r.ref, r.path): (r.outcome, r.text) for r in ft.decode_tree(files, asked).collect() if r.repo == "r"}
    assert out == {("main", "a/b.txt"): ("ok", "hello"), ("main", "a"): ("directory", None), ("main", "a/c"): ("directory", None), ("main", "a/c/d.yaml"): ("ok", "ä"),
                   ("main", "a/none"): ("not_found", None), ("main", "a/empty.txt"): ("not_found", None), ("dev", "e.txt"): ("bad_payload", None)}
    listing = sorted((r.ref, r.dir, r.name, r.type) for r in ft.list_tree(files).collect())
    assert listing == [("dev", "", "e.txt", "file"), ("main", "", "a", "dir"), ("main", "a", "b.txt", "file"), ("main", "a", "c", "dir"), 
                       ("main", "a/c", "d.yaml", "file")]
    plan = ft.list_tree(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan or "content" not in plan  # a listing reads no content
    assert [r.path for r in ft.file_tree(spark, str(tmp_path), "*.yaml").select("path").collect()] == ["r/main/a/c/d.yaml"]


@pytest.mark.parametrize("folder,reference,path", [
    ("pipeline", "../dataset/x/y.yaml", "dataset/x/y.yaml"), ("pipeline", "x.yaml", "pipeline/x.yaml"), ("pipeline", "./a/../b.yaml", "pipeline/b.yaml"), ("a/b", "../../c", "c"),
    ("a", "../../c", None), ("a", "/c//d.yaml", "c/d.yaml"), ("a", "..", None), ("a", "../../a/x", None), ("", "x", "x"), ("a", None, None)])
def test_references(spark, folder, reference, path):
    df = spark.createDataFrame([(folder, reference)], "f string, r string")
    found = df.select(sp.resolve_reference(F.col("f"), F.col("r"))).first()[0]
    assert found == path


def test_includes(spark):
    spec = """{"pipeline": {"tasks": [
      {"name": "t", "sync_include": "../d/s.yaml", "acl_include": "../../up.yaml", "meta_include": "../d/none.yaml", "bad_include": "../d/bad.yaml", "list_include": "../d/s.yaml", "n_include": 5},
      {"name": "lone", "sync_include": "../d/s.yaml"}, {"sync_include": "../d/s.yaml"}, "no object"]},
      "t": {"sync": {"mode": "own", "keep": 1}, "list": [1]}}"""
    files = spark.createDataFrame([("d/s.yaml", "sync: {mode: file, extra: [1]}\nlist: [2]"), ("d/bad.yaml", "a: [unclosed"), ("d/unused.yaml", "x")], "path string, body string")
    out = sp.task_includes(sp.parse_specs(spark.createDataFrame([(1, spec), (2, None), (3, "[]")], "spec_id int, body string")), files)
    got = {(r.task_name, r.section): (r.outcome, r.path, r.m) for r in out.withColumn("m", F.to_json("merged")).collect()}
    assert got == {("t", "sync"): ("found", "d/s.yaml", '{"extra":[1],"mode":"own","keep":1}'), ("t", "acl"): ("outside", None, "{}"), ("t", "meta"): ("missing", "d/none.yaml", "{}"),
                   ("t", "bad"): ("bad_document", "d/bad.yaml", "{}"), ("t", "list"): ("wrong_section", "d/s.yaml", "{}"), ("t", "n"): ("missing", "pipeline/5", "{}"),
                   ("lone", "sync"): ("found", "d/s.yaml", '{"extra":[1],"mode":"file"}'), (None, "sync"): ("found", "d/s.yaml", '{"extra":[1],"mode":"file"}')}
