"""Declared-dataset queries (SURVEY §2 rows S07-S16, P08-P12, F29, F30, W05, W06,
A05-A10, J08, J09, X01, X03).  File-writing rows write to a fresh folder under
the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import landing as ld

from ..operators import datasets as ds
from ..operators import quality as dq
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.tables import Tables
from . import q_signals as qs
from .registry import query

ORDERS_SCHEMA = ld.ORDERS_DATASET["metadata"]["schema"]
_OL = f"ol AS ({ld.landing_sql(ld.ORDERS_LANDING, 'orders')})"
_LL = f"ll AS ({ld.landing_sql(ld.LINEITEM_LANDING, 'lineitem')})"
_CL = f"cl AS ({ld.landing_sql(ld.CUSTOMER_LANDING, ld.CUSTOMER_SOURCE_SQL)})"
_OT = """ot AS (SELECT TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_custkey AS BIGINT) AS o_custkey,
  o_orderstatus, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, TRY_CAST(o_orderdate AS DATE) AS o_orderdate,
  o_orderpriority, __process_date FROM ol)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _orders_typed(spark, sf_dir):
    return ds.schema_enforce(ld.orders_landing(_t(spark, sf_dir)), ORDERS_SCHEMA)


# ----------------------------- sources / sinks -----------------------------


@query("S07", "read_parquet_task", W(_OL) + "SELECT * FROM ol")
def q_read_parquet_task(spark, sf_dir):
    path = ld.land_orders_parquet(spark, _t(spark, sf_dir))
    df = rd.read_parquet_task(spark, path)
    return df.select(*[c for c in df.columns if c != "__process_date"],
                     F.col("__process_date").cast("string").alias("__process_date"))


@query("S08", "read_csv_task", W(_LL) + "SELECT * FROM ll")
def q_read_csv_task(spark, sf_dir):
    path = ld.land_lineitem_csv(spark, _t(spark, sf_dir))
    return rd.read_csv_task(spark, path, ld.LINEITEM_SCHEMA, has_header=False, separator="\t", encoding="UTF-8")


_RUNS = [
    ("o_orderkey", "o_orderkey"),
    ("run_date", "CAST(o_orderdate AS DATE)"),
    ("day_range", "CAST(o_orderkey % 3 AS INT)"),
    ("py_format", "CASE o_orderkey % 3 WHEN 0 THEN '%Y%m%d' WHEN 1 THEN '%Y-%m-%d' ELSE '%Y/%m/%d' END"),
    ("template", "'landing/p' || substr(o_orderpriority, 1, 1) || '/:date:/part/'"),
    ("backfill", "o_orderkey % 11 = 0"),
]


@query("S09", "date_path_expand", f"""WITH r AS ({ld.landing_sql(_RUNS, 'orders')})
SELECT o_orderkey, replace(template, ':date:', CASE py_format WHEN '%Y%m%d' THEN strftime(d, '%Y%m%d')
  WHEN '%Y-%m-%d' THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y/%m/%d') END) AS path
FROM (SELECT r.*, unnest(generate_series(CASE WHEN backfill THEN run_date - INTERVAL 7 DAY
        ELSE run_date - CAST(day_range AS INTEGER) * INTERVAL 1 DAY END, CAST(run_date AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM r)""")
def q_date_path_expand(spark, sf_dir):
    runs = _t(spark, sf_dir).orders.selectExpr(*[f"{e} AS {n}" for n, e in _RUNS])
    pattern = F.col("py_format")
    for k, v in rd.STRFTIME_TO_SPARK.items():
        pattern = F.replace(pattern, F.lit(k), F.lit(v))
    out = rd.expand_date_paths(runs, F.col("template"), F.col("run_date"), F.col("day_range"), pattern,
                               backfill_from=F.when(F.col("backfill"), F.date_sub("run_date", 7)))
    return out.select("o_orderkey", "path")


@query("S10", "partition_discovery", W(_OL) + """
SELECT __process_date AS process_date, count(*) AS n FROM ol WHERE __process_date >= '1998-01-01' GROUP BY 1""")
def q_partition_discovery(spark, sf_dir):
    path = ld.land_orders_parquet(spark, _t(spark, sf_dir))
    df = rd.read_parquet_task(spark, path)
    # the predicate on the partition column prunes folders (PartitionFilters)
    return (df.where(F.col("__process_date") >= F.lit("1998-01-01").cast("date"))
            .groupBy(F.col("__process_date").cast("string").alias("process_date"))
            .agg(F.count(F.lit(1)).alias("n")))


_NAMES = [
    ("o_orderkey", "o_orderkey"),
    ("file_path", "'data/maz/' || lower(o_orderstatus) || '/' || CASE WHEN o_orderkey % 13 = 0 "
                  "THEN 'manifest_' || CAST(o_orderkey AS STRING) || '.json' "
                  "ELSE upper(substr(o_orderpriority, 3, 4)) || '_' || replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') "
                  "|| '_' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') "
                  "|| '00_cdc_' || CAST(o_orderkey % 7 AS STRING) || '.parquet' END"),
    ("ok_name", "o_orderkey % 13 <> 0"),
    ("ent", "upper(substr(o_orderpriority, 3, 4))"),
    ("d", "CAST(o_orderdate AS DATE)"),
    ("hh", "lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')"),
    ("mm", "lpad(CAST(o_custkey % 60 AS STRING), 2, '0')"),
    ("seq", "CAST(o_orderkey % 7 AS INT)"),
]


@query("S11", "file_lineage_parse", f"""WITH n AS ({ld.landing_sql(_NAMES, 'orders')})
SELECT o_orderkey, CASE WHEN ok_name THEN ent END AS entity, CASE WHEN ok_name THEN d END AS extract_date,
  CASE WHEN ok_name THEN hh || ':' || mm || ':00' END AS extract_time, CASE WHEN ok_name THEN seq END AS cdc_seq FROM n""")
def q_file_lineage_parse(spark, sf_dir):
    names = _t(spark, sf_dir).orders.selectExpr(*[f"{e} AS {n}" for n, e in _NAMES[:2]])
    return names.select("o_orderkey", *rd.file_lineage(F.col("file_path")))


@query("S12", "format_options_reader", W(_CL) + "SELECT * FROM cl")
def q_format_options_reader(spark, sf_dir):
    path = ld.land_customer_json(spark, _t(spark, sf_dir))
    return rd.read_format(spark, "json", path, {"mode": "PERMISSIVE"}, ld.CUSTOMER_SCHEMA)


@query("S13", "sync_append_overwrite", W(_CL) + "SELECT region, 2 * count(*) AS n FROM cl GROUP BY region")
def q_sync_append_overwrite(spark, sf_dir):
    path = scratch_path(spark, "sync-customer")
    batch = ld.customer_landing(_t(spark, sf_dir))
    sk.sync_write(batch, path, mode="overwrite", partition_by=["region"])
    sk.sync_write(batch, path, mode="append", partition_by=["region"])
    return spark.read.parquet(path).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("S14", "sync_dynamic_overwrite", W(_OL) + """
SELECT __process_date AS process_date,
  CASE WHEN __process_date >= '2000-01-01' AND count(*) FILTER (WHERE CAST(o_orderkey AS BIGINT) % 2 = 0) > 0
       THEN count(*) FILTER (WHERE CAST(o_orderkey AS BIGINT) % 2 = 0) ELSE count(*) END AS n_rows,
  CASE WHEN __process_date >= '2000-01-01' THEN count(*) FILTER (WHERE CAST(o_orderkey AS BIGINT) % 2 = 0)
       ELSE 0 END AS n_replaced
FROM ol GROUP BY 1""")
def q_sync_dynamic_overwrite(spark, sf_dir):
    path = scratch_path(spark, "sync-orders")
    full = ld.orders_landing(_t(spark, sf_dir))
    sk.sync_write(full, path, mode="overwrite", partition_by=["__process_date"])
    batch = (full.where((F.col("__process_date") >= "2000-01-01") & (F.col("o_orderkey").cast("bigint") % 2 == 0))
             .withColumn("o_orderpriority", F.lit("REPLACED")))
    sk.sync_write(batch, path, mode="overwrite", partition_by=["__process_date"], dynamic=True)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("__process_date").cast("string").alias("process_date")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("o_orderpriority") == "REPLACED").cast("bigint").alias("n_replaced"))


# the target's files after a refused batch and after the same batch replaced the schema
@query("S15", "sync_schema_guard", W(_OL, _OT) + "\nUNION ALL ".join(
    [f"SELECT 'refused' AS phase, '{c['name']}' AS field, '{c['type']}' AS field_type, count({c['name']}) AS n_values FROM ot" for c in ORDERS_SCHEMA]
    + [f"SELECT 'replaced', '{c['name']}', 'string', count({c['name']}) FROM ol WHERE o_orderkey IS NOT NULL" for c in ORDERS_SCHEMA if c["name"] != "o_orderpriority"]
    + ["SELECT 'replaced', 'load_note', 'string', count(*) FROM ol"]))
def q_sync_schema_guard(spark, sf_dir):
    path = scratch_path(spark, "guarded-orders")
    raw = ld.orders_landing(_t(spark, sf_dir))
    batch = raw.drop("o_orderpriority", "__process_date").withColumn("load_note", F.lit("x"))
    sk.guarded_write(_orders_typed(spark, sf_dir).drop("__process_date"), path, overwrite_schema=False)
    out = None
    for phase, overwrite in (("refused", False), ("replaced", True)):
        if sk.guarded_write(batch, path, overwrite_schema=overwrite) != overwrite:
            raise AssertionError(f"schema guard: {phase} expected")
        # counts are taken now, while the files are those of this phase
        files = spark.read.parquet(path)
        rows = sk.landed_counts(files, phase, scratch_path(spark, f"guard-{phase}"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("S16", "state_snapshot_json", qs.with_("pl") + "SELECT * FROM pl")
def q_state_snapshot_json(spark, sf_dir):
    pl = qs.ctx(spark, sf_dir).pipeline()
    path = scratch_path(spark, "state-json")
    sk.write_state_json(pl, path)
    return spark.read.schema(pl.schema).json(path)


# ------------------------------ projections --------------------------------


@query("P08", "rename_columns", W(_CL) + """
SELECT c_custkey, c_name AS NAME, region, c_acctbal, c_mktsegment AS SEGMENT FROM cl""")
def q_rename_columns(spark, sf_dir):
    return ds.rename_columns(ld.customer_landing(_t(spark, sf_dir)), {"c_name": "NAME", "c_mktsegment": "SEGMENT"})


_MAPPING = [("o_orderkey", "order_id", "bigint"), ("o_totalprice", "total", "double"),
            ("o_orderdate", "order_date", "date")]


@query("P09", "column_mapping_cast", W(_OL) + """
SELECT TRY_CAST(o_orderkey AS BIGINT) AS order_id, TRY_CAST(o_totalprice AS DOUBLE) AS total,
  TRY_CAST(o_orderdate AS DATE) AS order_date FROM ol""")
def q_column_mapping_cast(spark, sf_dir):
    return ds.column_mapping_cast(ld.orders_landing(_t(spark, sf_dir)), _MAPPING)


_LOST = "\nUNION ALL ".join(
    f"SELECT '{c['name']}' AS column_name, count(*) FILTER (WHERE {c['name']} IS NOT NULL AND "
    f"TRY_CAST({c['name']} AS {c['type'].upper()}) IS NULL) AS n_lost FROM ol" for c in ORDERS_SCHEMA)


@query("P10", "schema_enforce", W(_OL) + _LOST)
def q_schema_enforce(spark, sf_dir):
    return ds.cast_losses(ld.orders_landing(_t(spark, sf_dir)), ORDERS_SCHEMA)


@query("P11", "drop_null_rows", W(_OL, _OT) + """
SELECT * FROM ot WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
  AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_drop_null_rows(spark, sf_dir):
    return ds.drop_null_rows(_orders_typed(spark, sf_dir))


_PRED = "o_totalprice > 100000 AND o_orderstatus = 'F'"


@query("P12", "step_filter", W(_OL, _OT) + f"SELECT * FROM ot WHERE {_PRED}")
def q_step_filter(spark, sf_dir):
    return ds.step_filter(_orders_typed(spark, sf_dir), _PRED)


@query("F29", "to_date_step", W(_OL) + """
SELECT o_orderkey, o_orderdate AS raw_date, TRY_CAST(o_orderdate AS DATE) AS o_orderdate FROM ol""")
def q_to_date_step(spark, sf_dir):
    raw = ld.orders_landing(_t(spark, sf_dir)).select("o_orderkey", F.col("o_orderdate").alias("raw_date"),
                                                      "o_orderdate")
    return ds.to_date_step(raw, "o_orderdate", "yyyy-MM-dd")


@query("F30", "round_step", W(_CL) + """
SELECT c_custkey, CAST(round(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38,12)), 2) AS DOUBLE) AS c_acctbal FROM cl""")
def q_round_step(spark, sf_dir):
    c = ld.customer_landing(_t(spark, sf_dir)).select("c_custkey", "c_acctbal")
    return ds.round_step(c, "c_acctbal", 2)


# ------------------------------ survivors -----------------------------------
_W05_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]


@query("W05", "drop_duplicates", f"""SELECT {', '.join(_W05_COLS)} FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_W05_COLS[2:])}) AS rn FROM lineitem) WHERE rn = 1""")
def q_drop_duplicates(spark, sf_dir):
    li = _t(spark, sf_dir).lineitem.select(*_W05_COLS)
    return ds.drop_duplicates(li, ["l_orderkey", "l_linenumber"])


_W06_ORDER = ("strptime(commit_ts, '%Y-%m-%d %H:%M:%S') DESC, seq DESC, l_partkey DESC NULLS LAST, l_suppkey DESC, "
              "l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_shipdate DESC, opflag DESC NULLS LAST")


@query("W06", "cdc_latest", W(_LL) + f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey, l_linenumber ORDER BY {_W06_ORDER}) AS rn FROM ll) WHERE rn = 1 AND opflag IS DISTINCT FROM 'D'""")
def q_cdc_latest(spark, sf_dir):
    li = ld.lineitem_landing(_t(spark, sf_dir))
    return ds.cdc_latest(li, ["l_orderkey", "l_linenumber"], ts="commit_ts", seq="seq", op="opflag")


# ------------------------------ aggregates ----------------------------------


@query("A05", "region_sum", W(_CL) + """
SELECT region, CAST(sum(CAST(c_acctbal AS DECIMAL(28,9))) AS DOUBLE) AS sum_c_acctbal FROM cl GROUP BY region""")
def q_region_sum(spark, sf_dir):
    return ds.region_sum(ld.customer_landing(_t(spark, sf_dir)), ["region"], "c_acctbal")


_A06 = {"sum_qty": "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)", "n_lines": "count(1)",
        "max_price": "max(l_extendedprice)"}


@query("A06", "step_aggregation", """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  count(1) AS n_lines, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL""")
def q_step_aggregation(spark, sf_dir):
    return ds.step_aggregation(_t(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"], _A06)


def _blank_null(c: str) -> str:
    return f"CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN NULL ELSE {c} END"


@query("A07", "dq_completeness", W(_OL, _OT) + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS checked, count({_blank_null(c)}) AS non_null, "
    f"CAST(count({_blank_null(c)}) / count(*) AS DECIMAL(9,6)) AS share FROM ot" for c in ["o_custkey", "o_orderstatus"]))
def q_dq_completeness(spark, sf_dir):
    return dq.completeness(_orders_typed(spark, sf_dir), ["o_custkey", "o_orderstatus"], blank_is_null=True)


@query("A08", "dq_uniqueness", """
SELECT sum(n) AS checked, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
  coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS surplus_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def q_dq_uniqueness(spark, sf_dir):
    return dq.uniqueness(_t(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("A09", "dq_primary_key", W(_OL, _OT) + """
SELECT sum(n) AS checked, coalesce(sum(n) FILTER (WHERE has_null), 0) AS null_key_rows,
  count(*) FILTER (WHERE n > 1 AND NOT has_null) AS duplicate_groups,
  coalesce(sum(n - 1) FILTER (WHERE n > 1 AND NOT has_null), 0) AS surplus_rows
FROM (SELECT o_orderkey, o_custkey, count(*) AS n, bool_or(o_orderkey IS NULL OR o_custkey IS NULL) AS has_null
      FROM ot GROUP BY ALL)""")
def q_dq_primary_key(spark, sf_dir):
    pk = [c["name"] for c in ORDERS_SCHEMA if c.get("primary_key")]
    return dq.primary_key_check(_orders_typed(spark, sf_dir), pk)


def _rep(dataset: str, pos: int, title: str, handler: str, cols: str, checked: str, failed: str, src: str) -> str:
    return (f"SELECT '{dataset}' AS dataset, {pos} AS exp_pos, '{title}' AS title, '{handler}' AS handler, "
            f"'{cols}' AS columns, CAST({checked} AS BIGINT) AS checked, CAST({failed} AS BIGINT) AS failed FROM {src}")


_UNIQ = "(SELECT sum(n) AS c, coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS f FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY ALL))"
_REPORT = "\nUNION ALL ".join([
    _rep("orders", 0, "order keys filled in", "completeness", "o_custkey,o_orderstatus", "count(*)",
         f"count(*) FILTER (WHERE ({_blank_null('o_custkey')}) IS NULL OR ({_blank_null('o_orderstatus')}) IS NULL)", "ot"),
    _rep("orders", 1, "one row per order", "uniqueness", "o_orderkey", "c", "f",
         _UNIQ.format(k="o_orderkey", t="ot")),
    _rep("lineitem", 0, "parts known", "completeness", "l_partkey", "count(*)",
         "count(*) FILTER (WHERE l_partkey IS NULL)", "ll"),
    _rep("lineitem", 1, "one row per order line", "uniqueness", "l_orderkey,l_linenumber", "c", "f",
         _UNIQ.format(k="l_orderkey, l_linenumber", t="ll")),
    _rep("customer", 0, "balance and segment filled in", "completeness", "c_acctbal,c_mktsegment", "count(*)",
         f"count(*) FILTER (WHERE ({_blank_null('c_acctbal')}) IS NULL OR ({_blank_null('c_mktsegment')}) IS NULL)", "cl"),
])


@query("A10", "dq_report", W(_OL, _OT, _LL, _CL) + f"""
SELECT *, CASE WHEN checked > 0 THEN CAST((checked - failed) / checked AS DECIMAL(9,6)) END AS pass_rate,
  CASE WHEN failed = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM ({_REPORT})""")
def q_dq_report(spark, sf_dir):
    t = _t(spark, sf_dir)
    parts = [
        dq.expectation_report("orders", _orders_typed(spark, sf_dir), ld.ORDERS_DATASET["quality"]["expectations"]),
        dq.expectation_report("lineitem", ld.lineitem_landing(t), ld.LINEITEM_DATASET["quality"]["expectations"]),
        dq.expectation_report("customer", ld.customer_landing(t), ld.CUSTOMER_DATASET["quality"]["expectations"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------ joins / runs --------------------------------


@query("J08", "step_join", W(_OL, _OT, _CL) + """
SELECT ot.o_orderkey, cl.c_name, cl.region FROM ot JOIN cl ON ot.o_custkey = cl.c_custkey""")
def q_step_join(spark, sf_dir):
    o = _orders_typed(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("cust"))
    c = ld.customer_landing(_t(spark, sf_dir)).select(F.col("c_custkey").alias("cust"), "c_name", "region")
    return ds.step_join(o, c, ["cust"], "inner").select("o_orderkey", "c_name", "region")


@query("J09", "step_enrichment", """
SELECT o_orderkey, l.l_linenumber, l.l_partkey FROM orders LEFT JOIN (
  SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1) l ON o_orderkey = l.l_orderkey""")
def q_step_enrichment(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey"))
    dim = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return ds.step_enrichment(o, dim, ["o_orderkey"], order=["l_linenumber", "l_partkey"])


@query("X01", "step_pipeline", W(_CL) + """
SELECT region, CAST(sum(CAST(round(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38,12)), 2) AS DECIMAL(28,9))) AS DOUBLE) AS sum_c_acctbal
FROM cl WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY region""")
def q_step_pipeline(spark, sf_dir):
    c = ld.customer_landing(_t(spark, sf_dir))
    return ds.step_pipeline(c, ld.CUSTOMER_DATASET["transformations"]["steps"])


@query("X03", "dataset_run", W(_OL, _OT) + f"""
SELECT *, CASE WHEN checked > 0 THEN CAST((checked - failed) / checked AS DECIMAL(9,6)) END AS pass_rate,
  CASE WHEN failed = 0 THEN 'pass' ELSE 'fail' END AS verdict, (SELECT count(*) FROM ot) AS rows_written FROM (
{_rep("orders", 0, "order keys filled in", "completeness", "o_custkey,o_orderstatus", "count(*)",
      f"count(*) FILTER (WHERE ({_blank_null('o_custkey')}) IS NULL OR ({_blank_null('o_orderstatus')}) IS NULL)", "ot")}
UNION ALL
{_rep("orders", 1, "one row per order", "uniqueness", "o_orderkey", "c", "f", _UNIQ.format(k="o_orderkey", t="ot"))})""")
def q_dataset_run(spark, sf_dir):
    """The run's quality report, with the rows that its target's files hold afterwards."""
    from ..operators.dataset_run import run_dataset
    path = ld.land_orders_parquet(spark, _t(spark, sf_dir))
    target = scratch_path(spark, "dataset-orders")
    out, report = run_dataset(spark, "orders", ld.ORDERS_DATASET, path, target)
    return report.withColumn("rows_written", F.lit(out.count()).cast("bigint"))
