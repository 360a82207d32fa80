"""Folder trees for the file queries: a repository tree from pages, dated order drops, CDC
files with telling names, and the include files of dataset specs.

Files get the names that the queries are about: Spark writes the rows, and where a name
matters the part file is renamed, or the task writes the file through Arrow's file systems,
so any shared store will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import _file_system, qualified_path, scratch_path
from tidewater.sources.tables import Tables

from .artifacts import PAGE_FIXTURE
from .landing import LINEITEM_LANDING

#: Pages as files of a tree: a name with an ending, so that no folder has a file's name.
TREE_FIXTURE = [(n, "CASE WHEN {p} = '' OR substr({p}, length({p}), 1) = '/' THEN {p} || 'index.html' WHEN {p} LIKE '%.%' THEN {p} ELSE {p} || '.txt' END".format(p=f"({e})")
                 if n == "path" else e) for n, e in PAGE_FIXTURE]


def _rows(df: DataFrame, fixture: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in fixture])


def tree_files(t: Tables) -> DataFrame:
    """(repo, ref, path, body): the lowest page id renders a file, every fourth page also on a
    second ref; a bad payload is no UTF-8."""
    first = _rows(t.pages, TREE_FIXTURE).groupBy("repo", "path").agg(F.min_by(F.struct("bad_payload", "html", "page_id"), "page_id").alias("f"))
    refs = F.explode(F.when(F.col("f.page_id") % 4 == 0, F.array(F.lit("main"), F.lit("dev"))).otherwise(F.array(F.lit("main"))))
    body = F.concat(F.when(F.col("ref") == "dev", F.lit("dev ")).otherwise(F.lit("")), F.col("f.html")).cast("binary")
    return first.withColumn("ref", refs).select("repo", "ref", "path", F.when(F.col("f.bad_payload"), F.concat(F.unhex(F.lit("C328")), body)).otherwise(body).alias("body"))


def tree_requests(t: Tables) -> DataFrame:
    rows = _rows(t.pages, TREE_FIXTURE)
    return (rows.selectExpr("repo", "'main' AS ref", "path")
            .unionByName(rows.where("page_id % 2 = 0").selectExpr("repo", "'dev' AS ref", "path"))
            .unionByName(rows.selectExpr("repo", "'main' AS ref", "regexp_extract(path, '^(.*)/[^/]*$', 1) AS path"))
            .unionByName(rows.where("page_id % 9 = 0").selectExpr("repo", "'main' AS ref", "path || '.bak' AS path"))
            .where("path <> ''").distinct())


def land_tree(spark: SparkSession, t: Tables) -> str:
    """Write the tree ``<root>/<repo>/<ref>/<path>``, each file by the task that has its row."""
    root = scratch_path(spark, "tree")
    target = qualified_path(spark, root)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = (fs.LocalFileSystem(), target.removeprefix("file:")) if target.startswith("file:") else fs.FileSystem.from_uri(target)
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{base}/{r['repo']}/{r['ref']}/{r['path']}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(r["body"])
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    tree_files(t).mapInArrow(task, "n long").agg(F.sum("n")).collect()
    return root


# -- dated order drops ---------------------------------------------------------------------

#: An order's row lands in its priority's folder of the first of its month; some months of one
#: priority never arrived.
DROP_FIXTURE = [
    ("o_orderkey", "o_orderkey"),
    ("o_totalprice", "CAST(o_totalprice AS DECIMAL(18,2))"),
    ("prio", "substr(o_orderpriority, 1, 1)"),
    ("day", "CAST(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) || '-01' AS DATE)"),
]
DROP_SCHEMA = "o_orderkey BIGINT, o_totalprice DECIMAL(18,2)"
ARRIVED = "NOT (prio = '2' AND CAST(substr(CAST(day AS STRING), 6, 2) AS INT) % 5 = 0)"
#: How the folder of a day is written, by priority.
DAY_FORMATS = "CASE prio WHEN '3' THEN '%Y/%m/%d' WHEN '2' THEN '%Y-%m-%d' WHEN '5' THEN '%Y-%m-%d' ELSE '%Y%m%d' END"
#: One run per supplier: which days of which priority it reads.
RUN_FIXTURE = [
    ("run_id", "s_suppkey"),
    ("prio", "CAST(s_suppkey % 6 + 1 AS STRING)"),
    ("run_date", "CAST('1992-02-03' AS DATE) + CAST(s_suppkey * 13 % 2400 AS INT)"),
    ("day_range", "CAST(s_suppkey % 150 AS INT)"),
    ("backfill", "s_suppkey % 11 = 0"),
]


def land_drops(spark: SparkSession, t: Tables) -> str:
    root = scratch_path(spark, "drops")
    rows = _rows(t.orders, DROP_FIXTURE).where(ARRIVED)
    # the folder of a day, as the runs' template spells it
    text = F.col("day").cast("string")
    spelled = F.when(F.col("prio") == "3", F.replace(text, F.lit("-"), F.lit("/"))).when(F.col("prio").isin("2", "5"), text).otherwise(F.replace(text, F.lit("-"), F.lit("")))
    rows = rows.withColumn("folder", F.concat(F.lit("landing/p"), "prio", F.lit("/"), spelled, F.lit("/part")))
    stage = scratch_path(spark, "drops-stage")
    rows.select("o_orderkey", "o_totalprice", "folder").repartition("folder").write.partitionBy("folder").parquet(stage)
    _, fs = _file_system(spark, stage)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in rows.select("folder").distinct().collect():  # a folder a month and priority
        fs.mkdirs(hadoop(f"{root}/{r.folder}").getParent())
        fs.rename(hadoop(f"{stage}/folder={r.folder.replace('/', '%2F')}"), hadoop(f"{root}/{r.folder}"))
    return root


def drop_runs(t: Tables) -> DataFrame:
    """runs(run_id, prio, run_date, day_range, backfill, py_format, template)."""
    return _rows(t.supplier, RUN_FIXTURE).withColumn("py_format", F.expr(DAY_FORMATS)).withColumn("template", F.concat(F.lit("landing/p"), "prio", F.lit("/:date:/part/")))


# -- CDC files -------------------------------------------------------------------------------

#: Changes of parts, the file that each came in (its name tells the order) and a file without lineage.
CDC_FIXTURE = [
    ("l_partkey", "l_partkey"), ("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_quantity", "l_quantity"),
    ("opflag", dict(LINEITEM_LANDING)["opflag"]),
    ("entity", "CASE l_returnflag WHEN 'A' THEN 'VBAK' WHEN 'N' THEN 'LIKP' ELSE 'TVRO' END"),
    ("day", "substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 4) || CASE l_suppkey % 2 WHEN 0 THEN '0601' ELSE '1231' END"),
    ("tod", "CASE l_linenumber % 2 WHEN 0 THEN '000000' ELSE '213804' END"),
    ("seq", "CAST(l_linenumber % 3 AS INT) + 9"),
    ("named", "l_suppkey % 17 <> 3"),
]
CDC_SCHEMA = "l_partkey BIGINT, l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, opflag STRING"


def land_cdc(spark: SparkSession, t: Tables) -> str:
    root, stage = scratch_path(spark, "cdc"), scratch_path(spark, "cdc-stage")
    rows = _rows(t.lineitem, CDC_FIXTURE)
    name = F.when(F.col("named"), F.concat_ws("_", "entity", "day", "tod", F.lit("cdc"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("manifest_"), "entity"))
    rows = rows.withColumn("name", name).select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"), "opflag", "name")
    rows.repartition("name").write.partitionBy("name").parquet(stage)
    _, fs = _file_system(spark, stage)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(hadoop(root))
    for r in rows.select("name").distinct().collect():  # some two hundred names
        for part in fs.globStatus(hadoop(f"{stage}/name={r.name}/part-*")):
            fs.rename(part.getPath(), hadoop(f"{root}/{r.name}.parquet"))
    return root


# -- include files of specs --------------------------------------------------------------------

#: Sections that a task may include, and what becomes of the file of (spec, dataset j, section number k).
INCLUDED = ("metadata", "sync", "quality", "transformations", "acl")
INCLUDE_KIND = "CASE (spec_id + j * 2 + k) % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'wrong_section' WHEN 2 THEN 'malformed' WHEN 3 THEN 'yaml' ELSE 'json' END"


def include_files(t: Tables) -> DataFrame:
    """spec_files(path, body): the include files of every spec's datasets, JSON or YAML; some
    are missing, hold another section or can't be parsed."""
    from .specs import _spec_rows, ds

    rows = _spec_rows(t).selectExpr("*", "explode(sequence(0, n_ds - 1)) AS j").selectExpr("*", f"posexplode(array({', '.join(repr(x) for x in INCLUDED)})) AS (k, section)")
    rows = rows.selectExpr("*", f"{ds('name')} AS name", f"{INCLUDE_KIND} AS kind").where("kind <> 'missing'")
    return rows.selectExpr("'dataset/' || name || '/' || name || '_' || section || '.yaml' AS path", """
        CASE kind WHEN 'wrong_section' THEN '{"other":{"mode":"file"}}' WHEN 'malformed' THEN section || ': [unclosed'
          WHEN 'yaml' THEN section || ':' || chr(10) || '  mode: file' || chr(10) || '  note_' || section || ': 2024-01-01'
          ELSE '{"' || section || '":{"mode":"file","note_' || section || '":1}}' END AS body""")
