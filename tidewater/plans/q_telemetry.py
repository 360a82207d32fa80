"""Telemetry, routing, forms and audit queries (SURVEY §2 rows A12-A16, W07, W08,
F10, F11, F22, F23, F31, P02-P04, P15, U04, S04-S06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import artifacts as tb
from testbed import telemetry as te

from ..functions.exprs import framework_from_env, key_or_default
from ..operators import telemetry as tm
from ..sources.tables import Tables, capped, read_table
from . import q_artifacts as qa
from . import q_logs as ql
from . import q_signals as qs
from . import q_specs as qp
from .registry import query


def _nr(spark, sf_dir):
    return te.node_runs(Tables(spark, sf_dir))


NR = f"nr AS ({te.fixture_sql(te.NODE_FIXTURE)})"
_FW = "CASE WHEN environment IN ('brz', 'slv') THEN 'hopsflow' WHEN environment = 'gld' THEN 'brewtiful' ELSE 'unknown' END"


@query("F10", "framework_from_env", f"WITH {NR}\nSELECT event_id, environment, {_FW} AS framework FROM nr")
def q_framework_from_env(spark, sf_dir):
    return _nr(spark, sf_dir).select("event_id", "environment", framework_from_env("environment").alias("framework"))


@query("F31", "common_tags", f"""WITH {NR}
SELECT event_id, coalesce(nullif(pipeline, ''), 'unknown') AS pipeline,
  coalesce(nullif(environment, ''), 'unknown') AS environment, {_FW} AS framework FROM nr""")
def q_common_tags(spark, sf_dir):
    return _nr(spark, sf_dir).select("event_id", *tm.common_tags(F.col("pipeline"), F.col("environment")))


@query("P15", "environment_check", f"""WITH {NR}
SELECT event_id, environment, environment IS NULL OR environment IN ('brz', 'slv', 'gld') AS valid,
  CASE WHEN NOT (environment IS NULL OR environment IN ('brz', 'slv', 'gld'))
       THEN 'invalid environment_type: ' || environment END AS reason FROM nr""")
def q_environment_check(spark, sf_dir):
    valid, reason = tm.environment_check(F.col("environment"))
    return _nr(spark, sf_dir).select("event_id", "environment", valid.alias("valid"), reason.alias("reason"))


@query("A13", "node_run_summary", f"""WITH {NR}
SELECT coalesce(nullif(pipeline, ''), 'unknown') AS pipeline, node_name, node_type, {_FW} AS framework,
  count(*) AS n_runs, count(*) FILTER (WHERE status = 'error') AS n_errors,
  CAST(sum(CAST(elapsed_ms AS DECIMAL(28,9))) AS DOUBLE) AS total_ms,
  CAST(sum(CAST(elapsed_ms AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS avg_ms,
  CAST(max(CAST(elapsed_ms AS DECIMAL(28,9))) AS DOUBLE) AS max_ms
FROM nr GROUP BY ALL""")
def q_node_run_summary(spark, sf_dir):
    return tm.node_run_summary(_nr(spark, sf_dir))


W08_SQL = f"""WITH {NR},
w8 AS (SELECT user_id, event_id, status,
  CASE WHEN at_start > coalesce(at_end, -1) THEN last_start END AS run_id, coalesce(at_start, -1) <= coalesce(at_end, -1) AS standalone
  FROM (SELECT *, last_value(CASE WHEN marker = 'start' THEN event_id END IGNORE NULLS) OVER w AS last_start,
          last_value(CASE WHEN marker = 'start' THEN pos END IGNORE NULLS) OVER w AS at_start,
          last_value(CASE WHEN marker = 'end' THEN pos END IGNORE NULLS) OVER w AS at_end
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM nr) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE marker IS NULL)
"""


@query("W08", "nested_runs", W08_SQL + "SELECT * FROM w8")
def q_nested_runs(spark, sf_dir):
    return tm.nested_runs(_nr(spark, sf_dir))


@query("A14", "pipeline_status", W08_SQL + """
SELECT run_id, count(*) AS n_nodes, CASE WHEN bool_or(status = 'error') THEN 'failed' ELSE 'success' END AS status
FROM w8 WHERE run_id IS NOT NULL GROUP BY run_id""")
def q_pipeline_status(spark, sf_dir):
    return tm.pipeline_status(tm.nested_runs(_nr(spark, sf_dir)))


@query("W07", "retry_loop_state", f"""WITH {NR},
per AS (SELECT user_id AS run_id, attempt, count(*) FILTER (WHERE val_error) AS n_errors FROM nr GROUP BY ALL),
pa AS (SELECT run_id, min(attempt) AS passed_at FROM per WHERE n_errors = 0 GROUP BY run_id)
SELECT per.run_id, attempt, n_errors,
  CASE WHEN passed_at IS NOT NULL AND attempt > passed_at THEN 'SKIPPED' WHEN n_errors = 0 THEN 'PASS'
       WHEN attempt - 1 < 3 THEN 'RETRY' ELSE 'EXHAUSTED' END AS state, passed_at
FROM per LEFT JOIN pa ON per.run_id = pa.run_id""")
def q_retry_loop_state(spark, sf_dir):
    a = _nr(spark, sf_dir).select(F.col("user_id").alias("run_id"), "attempt", F.col("val_error").alias("has_error"))
    return tm.retry_loop_state(a)


_LIMIT = " ".join(f"WHEN '{k}' THEN {v}" for k, v in tm.PROBE_ATTEMPTS.items())


@query("A12", "readiness_gate", f"""WITH {NR},
per AS (SELECT user_id AS run_id, service, bool_or(probe_ok AND probe_attempt <= CASE service {_LIMIT} END) AS any_ok,
  bool_and(has_creds) AS has_creds FROM nr GROUP BY ALL),
up AS (SELECT run_id, service, CASE WHEN service = 'github' THEN has_creds AND any_ok ELSE NOT has_creds OR any_ok END AS up FROM per),
g AS (SELECT run_id, {', '.join(f"max(CASE WHEN service = '{s}' THEN up END) AS {s}_up" for s in tm.PROBE_ATTEMPTS)}
      FROM up GROUP BY run_id)
SELECT *, coalesce(github_up, false) AND coalesce(datafactory_up, true) AND coalesce(databricks_up, true)
  AND coalesce(llm_up, true) AS ready FROM g""")
def q_readiness_gate(spark, sf_dir):
    p = _nr(spark, sf_dir).select(F.col("user_id").alias("run_id"), "service",
                                  F.col("probe_attempt").alias("attempt"), F.col("probe_ok").alias("ok"), "has_creds")
    return tm.readiness_gate(p)


FL = f"fl AS ({te.fixture_sql(te.FAILURE_FIXTURE)})"
_NOT_RUNNING = " OR ".join(f"contains(lower(m), '{p}')" for p in tm.WAREHOUSE_NOT_RUNNING_PATTERNS)
_NOT_FOUND = " OR ".join(f"contains(lower(m), '{p}')" for p in tm.TABLE_NOT_FOUND_PATTERNS)


@query("F22", "failure_class_poll", f"""WITH {FL}
SELECT event_id, m AS message, CASE WHEN {_NOT_RUNNING} THEN 'warehouse_not_running' WHEN {_NOT_FOUND}
  THEN 'table_not_found' ELSE 'execution' END AS failure_class
FROM (SELECT event_id, coalesce(nullif(poll_message, ''), 'Execution failed') AS m FROM fl)""")
def q_failure_class_poll(spark, sf_dir):
    f = te.failures(Tables(spark, sf_dir))
    msg, cls = tm.failure_class_poll(F.col("poll_message"))
    return f.select("event_id", msg.alias("message"), cls.alias("failure_class"))


@query("F23", "failure_class_http", f"""WITH {FL}
SELECT event_id, CASE WHEN NOT (status_code >= 200 AND status_code < 300) THEN m END AS message,
  CASE WHEN status_code >= 200 AND status_code < 300 THEN 'ok' WHEN {_NOT_RUNNING} THEN 'warehouse_not_running'
       WHEN status_code IN (401, 403) THEN 'auth' WHEN status_code = 404 THEN 'table_not_found'
       ELSE 'execution' END AS failure_class
FROM (SELECT *, coalesce(nullif(http_message, ''), nullif(http_error, ''), 'HTTP ' || CAST(status_code AS VARCHAR)) AS m FROM fl)""")
def q_failure_class_http(spark, sf_dir):
    f = te.failures(Tables(spark, sf_dir))
    msg, cls = tm.failure_class_http(F.col("status_code"), F.col("http_message"), F.col("http_error"))
    return f.select("event_id", msg.alias("message"), cls.alias("failure_class"))


SN = f"sn AS ({te.fixture_sql(te.SNAPSHOT_FIXTURE)})"
_SNAP_PARTS = [("environment_type", "k_env"), ("pipeline_info", "k_pipeline_info"),
               ("normalized_schema_v4", "k_schema"), ("pipeline_template", "k_pipeline_template"),
               ("transform_template", "k_transform_template"), ("notebook_template", "k_notebook_template")]
_SNAP_JSON = "'{' || concat_ws(',', " + ", ".join(
    f"CASE WHEN {v} = 'NULL' THEN '\"{k}\":null' WHEN {v} IS NOT NULL THEN '\"{k}\":\"' || {v} || '\"' END"
    for k, v in _SNAP_PARTS) + ") || '}'"


@query("P04", "snapshot_projection", f"WITH {SN}\nSELECT event_id, {_SNAP_JSON} AS snapshot FROM sn")
def q_snapshot_projection(spark, sf_dir):
    s = te.state_snapshots(Tables(spark, sf_dir))
    return s.select("event_id", tm.snapshot_projection(F.col("state")).alias("snapshot"))


@query("U04", "framework_set", f"""WITH {NR}
SELECT user_id % 20 AS manifest_id, coalesce(bool_or(contains(lower(pipeline), 'gld')), false) AS needs_gold,
  coalesce(bool_or(contains(lower(pipeline), 'brz') OR contains(lower(pipeline), 'slv')), false) AS needs_lake,
  concat_ws(',', CASE WHEN coalesce(bool_or(contains(lower(pipeline), 'gld')), false) THEN 'brewtiful' END,
    CASE WHEN coalesce(bool_or(contains(lower(pipeline), 'brz') OR contains(lower(pipeline), 'slv')), false)
    THEN 'hopsflow' END) AS frameworks
FROM nr GROUP BY 1""")
def q_framework_set(spark, sf_dir):
    n = _nr(spark, sf_dir).select((F.col("user_id") % 20).alias("manifest_id"), "pipeline")
    return tm.framework_set(n, "manifest_id", "pipeline")


# ---------------------------- forms and audit --------------------------------

def _forms(spark, sf_dir):
    c = qs.ctx(spark, sf_dir).landed()
    tabs = c.tables()
    pl = c.pipeline().select("trigger_id", "zone", "landing_zone", "schedule", "pipeline",
                             F.col("source_system").alias("pl_source_system"), "source_entity")
    j = tabs.join(pl, "trigger_id")
    keys = [("zone", "zone"), ("landing_zone", "landing_zone"), ("domain", "domain"), ("schedule", "schedule"),
            ("table_name", "table_name"), ("owner", "owner"), ("connector", "connector"),
            ("source_system", "pl_source_system"), ("source_entity", "source_entity"),
            ("target_entity", "target_entity"), ("connection_id", "connection_id"), ("acl", "acl"),
            ("transformations", "transformations")]
    schema = F.create_map(*[x for k, v in keys for x in (F.lit(k), F.col(v))])
    meta = F.create_map(F.lit("pipeline_name"), F.col("pipeline"))
    env = F.when(F.col("trigger_id") % 5 == 0, F.lit("gld")).otherwise(F.col("target_layer"))
    # behind a Generate: a form looks up every key, and each look-up would else build the maps again
    return j.select("trigger_id", "target_entity", env.alias("environment"),
                    F.inline(F.array(F.struct(schema.alias("schema"), meta.alias("metadata")))))


_NL = " || chr(10) || "
_SCHED = "coalesce(pl.schedule, 'None')"
_INGEST = _NL.join(["pl.zone", "pl.landing_zone", "''", "ts.domain", "pl.pipeline", _SCHED, "ts.table_name",
                    "'platform'", "'blob'", "pl.source_system", "pl.source_entity", "ts.target_entity",
                    "(" + qs._CONN + ")"])
_GLD = _NL.join(["pl.zone", "pl.landing_zone", "'mz'", "ts.domain", "pl.pipeline", _SCHED, "ts.table_name",
                 "'platform'", "'transformation'", "''", "'default'", "(" + qs._ACL + ") || 'n'"])
FORMS_SQL = qs.with_("ts").rstrip() + f""",
fm AS (SELECT ts.trigger_id, ts.target_entity,
  CASE WHEN ts.trigger_id % 5 = 0 THEN 'gld' ELSE ts.target_layer END AS environment,
  CASE WHEN ts.trigger_id % 5 = 0 THEN {_GLD} || chr(10)
       WHEN ts.target_layer = 'brz' THEN {_INGEST}{_NL}'n' || ({qs._ACL}) || chr(10)
       ELSE {_INGEST}{_NL}ts.transformations || ({qs._ACL}) || chr(10) END AS form,
  {_SCHED} AS schedule_text
  FROM ts JOIN pl ON ts.trigger_id = pl.trigger_id JOIN t ON ts.trigger_id = t.trigger_id WHERE ts.rn = 1)
"""


@query("F11", "render_forms", FORMS_SQL + "SELECT trigger_id, target_entity, environment, form FROM fm")
def q_render_forms(spark, sf_dir):
    f = _forms(spark, sf_dir)
    return f.select("trigger_id", "target_entity", "environment",
                    tm.render_form(F.col("schema"), F.col("metadata"), F.col("environment")).alias("form"))


@query("P03", "missing_default", FORMS_SQL + """
SELECT trigger_id, target_entity, schedule_text, CASE WHEN environment = 'gld' THEN 'mz' ELSE '' END AS country_text
FROM fm""")
def q_missing_default(spark, sf_dir):
    f = _forms(spark, sf_dir)
    country = F.when(F.col("environment") == "gld", key_or_default("schema", "country", "mz")) \
        .otherwise(key_or_default("schema", "country", ""))
    return f.select("trigger_id", "target_entity",
                    key_or_default("schema", "schedule", "* * * * *").alias("schedule_text"),
                    country.alias("country_text"))


@query("P02", "truthy_fallback", qs.with_("pl") + "SELECT trigger_id, zone, landing_zone, domain, source_system FROM pl")
def q_truthy_fallback(spark, sf_dir):
    return qs.ctx(spark, sf_dir).pipeline().select("trigger_id", "zone", "landing_zone", "domain", "source_system")


# arrivals(spec_id, translator): what the order lines of a part say has arrived
_ALL_TRANSLATORS = [*qp.sp.COMMON_TRANSLATORS, *qp.sp.LAKE_TRANSLATORS, qp.sp.GOLD_TRANSLATORS[1]]
_ARRIVED = "CASE (l_orderkey + l_linenumber) % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_ALL_TRANSLATORS)) + " END"


def _a15_sql() -> str:
    from .registry import ORACLES
    return (f"WITH u AS ({ORACLES['translator_fanout']}), a AS (SELECT DISTINCT l_partkey AS spec_id, {_ARRIVED} AS translator FROM lineitem)\n"
            f"SELECT u.spec_id, count(*) AS n_expected, count(*) FILTER (WHERE a.translator IS NULL) AS n_missing, "
            f"coalesce(string_agg(u.translator, ',' ORDER BY u.translator) FILTER (WHERE a.translator IS NULL), '') AS missing, "
            f"count(*) FILTER (WHERE a.translator IS NULL) = 0 AS ready FROM u LEFT JOIN a "
            f"ON u.spec_id = a.spec_id AND u.translator = a.translator GROUP BY u.spec_id")


@query("A15", "fanin_completeness", _a15_sql())
def q_fanin_completeness(spark, sf_dir):
    from ..operators.specs import translator_fanout
    exp = translator_fanout(qp._v(spark, sf_dir)).select("spec_id", "translator")
    arrived = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("spec_id"), F.expr(_ARRIVED).alias("translator"))
    return tm.fanin(exp, arrived, ["spec_id"], "translator").withColumn("missing", F.array_join("missing", ","))


_RUN_CTES = (ql.LOG_CTES.strip().removeprefix("WITH "), ql._CLI, f"vd AS ({ql.VERDICT_SQL})",
             f"links AS (SELECT {tb.fixture_sql(tb.TRIGGER_RUN_FIXTURE)} FROM orders)", f"norule AS ({qa._NO_RULE})")


@query("A16", "migration_summary", qa._w(*qa._PARAMS, qa._GOV, qa._RULES, qa._LK, qa._NBL, qa._SCR, *_RUN_CTES, base="ts") + """
SELECT st.trigger_id, st.n_items, coalesce(a.n, 0) AS n_tables, coalesce(b.n, 0) AS n_rules_found, coalesce(d.n, 0) AS n_tables_without_rule,
  CAST(coalesce(vd.n_errors, 0) AS BIGINT) AS n_errors, CASE WHEN vd.passed THEN 'passed' WHEN NOT vd.passed THEN 'failed' ELSE 'not_run' END AS validation,
  coalesce(c.n, 0) AS n_missing_scripts, CASE WHEN coalesce(c.n, 0) = 0 THEN 'complete' ELSE 'incomplete' END AS verdict
FROM st LEFT JOIN (SELECT trigger_id, count(*) AS n FROM ts WHERE rn = 1 GROUP BY 1) a ON st.trigger_id = a.trigger_id
LEFT JOIN (SELECT trigger_id, count(*) FILTER (WHERE rule_found) AS n FROM lk GROUP BY 1) b ON st.trigger_id = b.trigger_id
LEFT JOIN (SELECT trigger_id, count(*) AS n FROM scr WHERE NOT EXISTS (SELECT 1 FROM nbl WHERE nbl.repo = scr.repo_adb
  AND nbl.path = scr.path) GROUP BY 1) c ON st.trigger_id = c.trigger_id
LEFT JOIN (SELECT trigger_id, count(*) AS n FROM norule GROUP BY 1) d ON st.trigger_id = d.trigger_id
LEFT JOIN links ON st.trigger_id = links.trigger_id LEFT JOIN vd ON links.run_id = vd.run_id
WHERE st.status = 'ok'""")
def q_migration_summary(spark, sf_dir):
    from ..operators.telemetry import migration_summary
    c = qa.ctx(spark, sf_dir).landed()
    outcomes = tm.run_outcomes(tb.render_trigger_runs(Tables(spark, sf_dir)), ql.verdicts(spark, sf_dir))
    return migration_summary(c.status, c.tables(), c.lookups(), c.ok_items, c.notebooks, outcomes)


# ------------------------------- SQL client ----------------------------------
_LI_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
            "l_returnflag, l_linestatus, l_shipdate")


@query("S04", "table_scan_limit", f"SELECT {_LI_COLS} FROM lineitem ORDER BY {_LI_COLS} LIMIT 1000")
def q_table_scan_limit(spark, sf_dir):
    # LIMIT is the feature (a capped table read); a total order makes it
    # deterministic and Spark plans it as a per-partition top-k.
    cols = [c.strip() for c in _LI_COLS.split(",")]
    return capped(read_table(spark, sf_dir, "lineitem").select(*cols), limit="1000", order_by=cols)


@query("S05", "sql_statement", """
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,9))) AS DOUBLE) AS qty
FROM lineitem WHERE l_quantity >= 0 GROUP BY l_returnflag""")
def q_sql_statement(spark, sf_dir):
    return spark.sql(
        "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,9))) AS DOUBLE) AS qty "
        "FROM {lines} WHERE l_quantity >= :q GROUP BY l_returnflag",
        args={"q": 0}, lines=read_table(spark, sf_dir, "lineitem"))


@query("S06", "positional_columns", """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'col_0,col_1,col_2' ELSE 'id,status,col_2' END || CASE WHEN o_orderkey % 5 = 0 THEN ',col_3,col_4' ELSE '' END AS names,
  CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority ||
  CASE WHEN o_orderkey % 5 = 0 THEN '|' || CAST(o_custkey AS VARCHAR) || '|~' ELSE '' END AS row_values,
  CAST(o_orderkey AS VARCHAR) AS col_0, o_orderstatus AS col_1, o_orderpriority AS col_2 FROM orders""")
def q_positional_columns(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    three = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    wide = F.concat(three, F.array(F.col("o_custkey").cast("string"), F.lit(None).cast("string")))  # two columns more
    data = F.array(F.when(F.col("o_orderkey") % 5 == 0, wide).otherwise(three)).alias("data_array")
    name = lambda x: F.struct(F.lit(x).alias("name"))
    schema = F.when(F.col("o_orderkey") % 2 == 1, F.struct(F.array(name("id"), name("status")).alias("columns"))).alias("schema")
    payload = o.select(F.to_json(F.struct(F.struct(schema, data).alias("result"))).alias("body"))
    rows = tm.positional_columns(payload, 3)
    return rows.withColumn("names", F.array_join("names", ",")).withColumn("row_values", F.array_join("values", "|", "~")).drop("values")
