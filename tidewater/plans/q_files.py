"""Queries over real files: bulk trees (S01, S02), scans of computed paths (S09), lineage
from the names of the files read (S11) and include files (J07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import trees as tr

from ..operators import specs as sp
from ..session import TASKS_PER_CORE
from ..sources import readers as rd
from ..sources import trees as ft
from ..sources.tables import Tables
from . import q_artifacts as qa
from . import q_specs as qp
from .registry import query

_PG = "pg AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in tr.TREE_FIXTURE) + " FROM pages)"


@query("S01", "tree_content_decode", "WITH " + ",\n".join([_PG, qa._FILES, qa._DIRS, qa._REQ]) + """
SELECT req.repo, req.ref, req.path,
  CASE WHEN files.path IS NOT NULL THEN CASE WHEN files.bad THEN 'bad_payload' ELSE 'ok' END
       WHEN dirs.path IS NOT NULL THEN 'directory' ELSE 'not_found' END AS outcome,
  CASE WHEN files.path IS NOT NULL AND NOT files.bad THEN md5(files.html) END AS text_md5
FROM req LEFT JOIN files ON req.repo = files.repo AND req.ref = files.ref AND req.path = files.path
LEFT JOIN dirs ON req.repo = dirs.repo AND req.ref = dirs.ref AND req.path = dirs.path""")
def q_tree_content_decode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = ft.decode_tree(ft.repo_tree(spark, tr.land_tree(spark, t)), tr.tree_requests(t))
    return d.select("repo", "ref", "path", "outcome", F.md5("text").alias("text_md5"))


@query("S02", "tree_dir_listing", "WITH " + ",\n".join([_PG, qa._FILES, qa._DIRS]) + """
SELECT repo, ref, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_split(path, '/')[-1] AS name, path, type
FROM (SELECT repo, ref, path, 'file' AS type FROM files UNION ALL SELECT repo, ref, path, 'dir' FROM dirs)""")
def q_tree_dir_listing(spark, sf_dir):
    return ft.list_tree(ft.repo_tree(spark, tr.land_tree(spark, Tables(spark, sf_dir))))


def _sql(fixture: list[tuple[str, str]], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fixture) + f" FROM {source}"


@query("S09", "date_path_read", f"""WITH d AS ({_sql(tr.DROP_FIXTURE, 'orders')}), r AS ({_sql(tr.RUN_FIXTURE, 'supplier')})
SELECT run_id, CAST(day AS VARCHAR) AS day, count(*) AS n_rows, CAST(sum(o_totalprice) AS DOUBLE) AS total
FROM r JOIN d ON r.prio = d.prio AND d.day <= run_date
  AND d.day >= CASE WHEN backfill THEN run_date - INTERVAL 120 DAY ELSE run_date - CAST(day_range AS INTEGER) * INTERVAL 1 DAY END
WHERE {tr.ARRIVED.replace('prio', 'd.prio')} GROUP BY run_id, day""")
def q_date_path_read(spark, sf_dir):
    t = Tables(spark, sf_dir)
    root = tr.land_drops(spark, t)
    pattern = F.col("py_format")
    for k, v in rd.STRFTIME_TO_SPARK.items():
        pattern = F.replace(pattern, F.lit(k), F.lit(v))
    # dealt out before it is expanded, into a fixed number of parts: a file of runs is a few splits
    # only, and a run is many times its size in days
    dealt = tr.drop_runs(t).repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "run_id")
    runs = rd.expand_date_paths(dealt, F.col("template"), F.col("run_date"), F.col("day_range"), pattern,
                                backfill_from=F.when(F.col("backfill"), F.date_sub("run_date", 120)), keep_day="day").select("run_id", "day", "path")
    # a folder's rows are read and summed once, however many runs name it, and its sums joined to the runs
    rows = ft.read_paths(spark, root, runs.select("path", F.col("path").alias("named")).distinct(), tr.DROP_SCHEMA)
    sums = rows.groupBy("named").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))
    read = runs.join(F.broadcast(sums), F.col("path") == F.col("named"))
    return read.groupBy("run_id", F.col("day").cast("string").alias("day")).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").cast("double").alias("total"))


@query("S11", "file_lineage_read", f"""WITH c AS ({_sql(tr.CDC_FIXTURE, 'lineitem')})
SELECT l_partkey, entity, strptime(day, '%Y%m%d')::DATE AS extract_date,
  substr(tod, 1, 2) || ':' || substr(tod, 3, 2) || ':' || substr(tod, 5, 2) AS extract_time, seq AS cdc_seq, l_orderkey, l_linenumber, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, tod DESC, seq DESC, l_orderkey DESC, l_linenumber DESC, entity DESC, l_quantity DESC,
  opflag DESC NULLS LAST) AS rn FROM c WHERE named) WHERE rn = 1 AND opflag IS DISTINCT FROM 'D'""")
def q_file_lineage_read(spark, sf_dir):
    rows = spark.read.schema(tr.CDC_SCHEMA).parquet(tr.land_cdc(spark, Tables(spark, sf_dir)))
    changes = ft.with_file_lineage(rows)
    last = ft.latest_by_lineage(changes, ["l_partkey"], "opflag", tie=["l_orderkey", "l_linenumber", "entity", "l_quantity", "opflag"])
    return last.select("l_partkey", "entity", "extract_date", "extract_time", "cdc_seq", "l_orderkey", "l_linenumber", "l_quantity")


_OWN_KEYS = {"metadata": ["dataexpert", "description", "schema"], "sync": ["mode", "overwrite_schema", "partition_by"], "quality": ["expectations"],
             "transformations": ["steps"], "acl": ["access_groups"]}


def _merged(section: str, found: bool) -> str:
    keys = {k: "spec" for k in _OWN_KEYS[section]}
    if found:
        keys = {"mode": "file", f"note_{section}": "file"} | keys
    return ",".join(f"{k}:{keys[k]}" for k in sorted(keys))


_MERGED = " ".join(f"WHEN section = '{s}' AND {'' if f else 'NOT '}(kind IN ('yaml', 'json')) THEN '{_merged(s, f)}'" for s in tr.INCLUDED for f in (True, False))


@query("J07", "task_include_files", qp.SPEC_CTES + qp._rows(f"""
SELECT spec_id, dataset AS task_name, section, 'dataset/' || dataset || '/' || dataset || '_' || section || '.yaml' AS path,
  CASE kind WHEN 'malformed' THEN 'bad_document' WHEN 'yaml' THEN 'found' WHEN 'json' THEN 'found' ELSE kind END AS outcome,
  CASE {_MERGED} END AS merged,
  CASE WHEN section = 'sync' THEN {qp._D('mode_v1')} WHEN kind IN ('yaml', 'json') THEN 'file' END AS mode
FROM (SELECT *, {tr.INCLUDE_KIND} AS kind FROM (SELECT dd.*, k, section FROM dd, (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(tr.INCLUDED))}) v(k, section)))
WHERE (section <> 'quality' OR {qp._D('has_quality_include')}) AND (section <> 'acl' OR {qp._D('has_acl_include')})"""))
def q_task_include_files(spark, sf_dir):
    out = sp.task_includes(qp._v(spark, sf_dir), tr.include_files(Tables(spark, sf_dir)))
    source = F.transform(F.array_sort(F.map_keys("merged")), lambda k: F.concat(k, F.lit(":"), F.when(F.map_contains_key("own_keys", k), "spec").otherwise("file")))
    return out.select("spec_id", "task_name", "section", "path", "outcome", F.array_join(source, ",").alias("merged"),
                      F.try_variant_get(F.col("merged")["mode"], "$", "string").alias("mode"))
