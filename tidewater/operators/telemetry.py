"""Run telemetry, routing and audit (SURVEY rows A12-A16, W07, W08, F10, F11,
F22, F23, F31, P02-P04, P15, U04).

Ordered per-run scans (W08) reuse the chunked carry of ``logs._carry_last`` so a
very long run never becomes one window partition; everything else is a grouped
aggregate (partial + final) or a row-local expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_truthy, framework_from_env
from .ordered import ordered_scan

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
WAREHOUSE_NOT_RUNNING_PATTERNS = (
    "warehouse is not running",
    "sql warehouse is not running",
    "warehouse is in state stopped",
    "warehouse is in state starting",
    "cluster is not ready",
    "cluster not ready",
    "warehouse unavailable",
    "warehouse failed",
)
TABLE_NOT_FOUND_PATTERNS = ("table not found", "table or view not found", "object does not exist")
DEFAULT_FAILURE_MESSAGE = "Execution failed"
VALID_ENVIRONMENTS = ("brz", "slv", "gld")
SNAPSHOT_KEYS = ("environment_type", "pipeline_info", "normalized_schema_v4", "pipeline_template",
                 "transform_template", "notebook_template")
PROBE_ATTEMPTS = {"github": 3, "datafactory": 3, "databricks": 3, "llm": 2}  # llm: primary + fallback
REQUIRED_SERVICE = "github"
MAX_VALIDATION_RETRIES = 3
# ---------------------------------------------------------------------------


def _contains_any(msg: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(msg)
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(low.contains(p), F.lit(False))
    return out


def failure_class_poll(message: Column) -> tuple[Column, Column]:
    """(effective message, class) of a failed statement:
    warehouse_not_running > table_not_found > execution."""
    msg = first_truthy(message, default=DEFAULT_FAILURE_MESSAGE)
    cls = (F.when(_contains_any(msg, WAREHOUSE_NOT_RUNNING_PATTERNS), F.lit("warehouse_not_running"))
           .when(_contains_any(msg, TABLE_NOT_FOUND_PATTERNS), F.lit("table_not_found"))
           .otherwise(F.lit("execution")))
    return msg, cls


def failure_class_http(code: Column, message: Column, error: Column) -> tuple[Column, Column]:
    """2xx ok; not-running text first, then 401/403 auth, 404 not-found,
    else execution; message = message or error or 'HTTP <code>'."""
    msg = first_truthy(message, error, default=F.concat(F.lit("HTTP "), code.cast("string")))
    cls = (F.when((code >= 200) & (code < 300), F.lit("ok"))
           .when(_contains_any(msg, WAREHOUSE_NOT_RUNNING_PATTERNS), F.lit("warehouse_not_running"))
           .when(code.isin(401, 403), F.lit("auth"))
           .when(code == 404, F.lit("table_not_found"))
           .otherwise(F.lit("execution")))
    return F.when(~((code >= 200) & (code < 300)), msg), cls


def common_tags(pipeline: Column, environment: Column) -> list[Column]:
    """F31 (+F10): pipeline / environment / framework tags with 'unknown' defaults."""
    return [first_truthy(pipeline, default="unknown").alias("pipeline"),
            first_truthy(environment, default="unknown").alias("environment"),
            framework_from_env(environment).alias("framework")]


def environment_check(environment: Column) -> tuple[Column, Column]:
    """Null or one of brz / slv / gld is valid; otherwise rejected with a reason."""
    valid = environment.isNull() | environment.isin(*VALID_ENVIRONMENTS)
    reason = F.when(~valid, F.concat(F.lit("invalid environment_type: "), environment))
    return valid, reason


def node_run_summary(runs: DataFrame) -> DataFrame:
    """Count, errors, total / avg / max elapsed by pipeline, node, node type
    and framework (exact decimal totals).  Only mergeable aggregates: an exact
    percentile would hold every value of a group in one task."""
    tagged = runs.select(*common_tags(F.col("pipeline"), F.col("environment")), "node_name", "node_type",
                         "status", F.col("elapsed_ms").cast("decimal(28,9)").alias("ms"))
    g = tagged.groupBy("pipeline", "node_name", "node_type", "framework").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("status") == "error").cast("bigint").alias("n_errors"),
        F.sum("ms").cast("double").alias("total_ms"),
        F.max("ms").cast("double").alias("max_ms"),
    )
    return g.withColumn("avg_ms", F.col("total_ms") / F.col("n_runs"))


def nested_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Attach each node run to the pipeline run that encloses it.  A 'start'
    marker opens a run (and implicitly closes any open one); an 'end' marker closes
    it; a node outside any open run stands alone.  Rows are ordered by (ts, event_id),
    those without a ts last, and the last marker is carried as one value: a run is open if
    it is a start.  Rows without a user are one user's.  A task scans a ``ranges``-th of
    the rows, however many of them one user has."""
    # the zone-less timestamp: no session-zone shifts
    d = runs.withColumn("_o", F.col("ts").cast("timestamp_ntz"))
    mark = F.when(F.col("marker").isNotNull(), F.struct(F.col("marker").alias("kind"), F.col("event_id").alias("id")))
    d = ordered_scan(d, "user_id", [F.col("_o").asc_nulls_last(), F.col("event_id").asc_nulls_last()], lasts={"_last": mark}, ranges=ranges)
    open_run = F.coalesce(F.col("_last.kind") == "start", F.lit(False))
    nodes = d.where(F.col("marker").isNull())
    return nodes.select("user_id", "event_id", "status",
                        F.when(open_run, F.col("_last.id")).alias("run_id"),
                        (~open_run).alias("standalone"))


def pipeline_status(nested: DataFrame) -> DataFrame:
    """A pipeline run is failed if any of its nodes failed, else success."""
    return nested.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.when(F.bool_or(F.col("status") == "error"), F.lit("failed")).otherwise(F.lit("success")).alias("status"))


def retry_loop_state(attempts: DataFrame) -> DataFrame:
    """Per (run, attempt): PASS (no errors), RETRY (errors, retries left),
    EXHAUSTED (errors, no retries left) or SKIPPED (after a pass), plus the attempt
    at which the run passed."""
    per = attempts.groupBy("run_id", "attempt").agg(F.count_if("has_error").alias("n_errors"))
    passed = F.min(F.when(F.col("n_errors") == 0, F.col("attempt"))).over(Window.partitionBy("run_id"))
    per = per.withColumn("passed_at", passed)
    state = (F.when(F.col("passed_at").isNotNull() & (F.col("attempt") > F.col("passed_at")), F.lit("SKIPPED"))
             .when(F.col("n_errors") == 0, F.lit("PASS"))
             .when(F.col("attempt") - 1 < MAX_VALIDATION_RETRIES, F.lit("RETRY"))
             .otherwise(F.lit("EXHAUSTED")))
    return per.select("run_id", "attempt", F.col("n_errors").cast("bigint").alias("n_errors"), state.alias("state"),
                      "passed_at")


def readiness_gate(probes: DataFrame) -> DataFrame:
    """A service is up if one of its first allowed attempts succeeded; the run
    is ready if the required service is up and each optional service that has
    credentials is up (an optional service without credentials is excused)."""
    limit = F.create_map(*[F.lit(x) for kv in PROBE_ATTEMPTS.items() for x in kv])
    per = probes.groupBy("run_id", "service").agg(
        F.bool_or(F.col("ok") & (F.col("attempt") <= limit[F.col("service")])).alias("any_ok"),
        F.bool_and("has_creds").alias("has_creds"))
    up = F.when(F.col("service") == REQUIRED_SERVICE, F.col("has_creds") & F.col("any_ok")) \
        .otherwise(~F.col("has_creds") | F.col("any_ok"))
    per = per.withColumn("up", up)
    aggs = [F.max(F.when(F.col("service") == s, F.col("up"))).alias(f"{s}_up") for s in PROBE_ATTEMPTS]
    gate = per.groupBy("run_id").agg(*aggs)
    ready = F.coalesce(F.col(f"{REQUIRED_SERVICE}_up"), F.lit(False))
    for s in PROBE_ATTEMPTS:
        if s != REQUIRED_SERVICE:
            ready = ready & F.coalesce(F.col(f"{s}_up"), F.lit(True))
    return gate.withColumn("ready", ready)


def snapshot_projection(state: Column) -> Column:
    """Keep only the keys of interest that are present (a present null stays),
    rendered as JSON."""
    keys = F.array(*[F.lit(k) for k in SNAPSHOT_KEYS])
    return F.to_json(F.map_filter(state, lambda k, v: F.array_contains(keys, k)))


def framework_set(pipelines: DataFrame, group: str, name: str) -> DataFrame:
    """Frameworks needed by a list of pipelines (case-insensitive substring;
    a pipeline without a name contributes nothing)."""
    low = F.lower(F.col(name))
    g = pipelines.groupBy(group).agg(
        F.coalesce(F.bool_or(low.contains("gld")), F.lit(False)).alias("needs_gold"),
        F.coalesce(F.bool_or(low.contains("brz") | low.contains("slv")), F.lit(False)).alias("needs_lake"))
    return g.select(group, "needs_gold", "needs_lake", F.concat_ws(",", F.when(
        F.col("needs_gold"), F.lit("brewtiful")), F.when(F.col("needs_lake"), F.lit("hopsflow")))
        .alias("frameworks"))


# ------------------------------ generator forms -----------------------------
# Fixed values that must equal the source behaviour: generator-form defaults.
INGEST_FORM_DEFAULTS = {
    "zone": "maz", "country": "", "domain": "unknown", "schedule": "* * * * *", "table_name": "raw_table",
    "owner": "platform", "connector": "blob", "source_system": "sap", "source_entity": "sap",
    "target_entity": "sap", "connection_id": "sap-secret", "transformations": "y", "acl": "n",
}
GOLD_FORM_DEFAULTS = {
    "zone": "maz", "country": "mz", "domain": "unknown", "schedule": "* * * * *", "table_name": "feature_table",
    "owner": "platform", "table_scope": "transformation", "data_product_subdomain": "default", "acl": "n",
    "trigger": "n",
}
DEFAULT_PIPELINE_NAME = "unknown_pipeline"


def _g(m: Column, key: str, default: str | Column) -> Column:
    """``schema.get(key, default)`` as text (present null -> 'None')."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(m.isNull() | ~F.map_contains_key(m, F.lit(key)), d).otherwise(F.coalesce(m[key], F.lit("None")))


def render_form(schema: Column, metadata: Column, environment: Column) -> Column:
    """the multi-line generator input for one table; layout by environment:
    brz (ends ``n{acl}``), slv (ends ``{transformations}{acl}``), anything else gold
    (12 lines with one blank line).  ``landing_zone`` defaults to the zone value."""
    pipeline = _g(metadata, "pipeline_name", DEFAULT_PIPELINE_NAME)

    def ingest(last: Column) -> Column:
        d = INGEST_FORM_DEFAULTS
        zone = _g(schema, "zone", d["zone"])
        lines = [zone, _g(schema, "landing_zone", zone), _g(schema, "country", d["country"]),
                 _g(schema, "domain", d["domain"]), pipeline, _g(schema, "schedule", d["schedule"])]
        lines += [_g(schema, k, d[k]) for k in ("table_name", "owner", "connector", "source_system",
                                                 "source_entity", "target_entity", "connection_id")]
        return F.concat(F.concat_ws("\n", *lines, last), F.lit("\n"))

    acl = _g(schema, "acl", INGEST_FORM_DEFAULTS["acl"])
    brz = ingest(F.concat(F.lit("n"), acl))
    slv = ingest(F.concat(_g(schema, "transformations", INGEST_FORM_DEFAULTS["transformations"]), acl))
    g = GOLD_FORM_DEFAULTS
    gzone = _g(schema, "zone", g["zone"])
    gold_lines = [gzone, _g(schema, "landing_zone", gzone), _g(schema, "country", g["country"]),
                  _g(schema, "domain", g["domain"]), pipeline, _g(schema, "schedule", g["schedule"]),
                  _g(schema, "table_name", g["table_name"]), _g(schema, "owner", g["owner"]),
                  _g(schema, "table_scope", g["table_scope"]), F.lit(""),
                  _g(schema, "data_product_subdomain", g["data_product_subdomain"]),
                  F.concat(_g(schema, "acl", g["acl"]), _g(schema, "trigger", g["trigger"]))]
    gld = F.concat(F.concat_ws("\n", *gold_lines), F.lit("\n"))
    return F.when(environment == "brz", brz).when(environment == "slv", slv).otherwise(gld)


def run_outcomes(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(trigger, errors, passed) of the triggers that a validation run looked at: ``links`` names
    the run of a trigger, ``verdicts`` is one row per run (A11)."""
    return links.where("run_id is not null").join(verdicts.select("run_id", "n_errors", "passed"), "run_id").select("trigger_id", "n_errors", "passed")


def migration_summary(status: DataFrame, tables: DataFrame, lookups: DataFrame, ok_items: DataFrame,
                      notebooks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One audit row per extracted pipeline: items, tables, rules found, silver tables
    without a rule, missing scripts, errors and outcome of its validation run, verdict.

    The inputs are unioned as (trigger, metric, value) rows and folded by a single
    grouped aggregate — one shuffle on ``trigger_id`` instead of a chain of
    sort-merge joins whose sorters would all live in the same task."""
    from .artifacts import item_scripts, tables_without_rule

    scripts = item_scripts(ok_items)
    nb = notebooks.select(F.col("repo").alias("repo_adb"), "path")
    missing = scripts.join(nb, ["repo_adb", "path"], "left_anti")
    one = F.lit(1).cast("bigint")
    parts = [
        status.where(F.col("status") == "ok").select("trigger_id", F.lit("ok").alias("m"),
                                                     F.col("n_items").cast("bigint").alias("v")),
        tables.select("trigger_id", F.lit("n_tables").alias("m"), one.alias("v")),
        lookups.where("rule_found").select("trigger_id", F.lit("n_rules_found").alias("m"), one.alias("v")),
        missing.select("trigger_id", F.lit("n_missing_scripts").alias("m"), one.alias("v")),
        tables_without_rule(lookups).select("trigger_id", F.lit("n_tables_without_rule").alias("m"), one.alias("v")),
        outcomes.select("trigger_id", F.lit("n_errors").alias("m"), F.col("n_errors").alias("v")),
        outcomes.select("trigger_id", F.lit("passed").alias("m"), F.col("passed").cast("bigint").alias("v")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    metric = lambda name: F.coalesce(F.sum(F.when(F.col("m") == name, F.col("v"))), F.lit(0)).cast("bigint")
    g = u.groupBy("trigger_id").agg(
        F.max(F.when(F.col("m") == "ok", F.col("v"))).alias("n_items"),
        metric("n_tables").alias("n_tables"), metric("n_rules_found").alias("n_rules_found"),
        metric("n_missing_scripts").alias("n_missing_scripts"), metric("n_tables_without_rule").alias("n_tables_without_rule"),
        metric("n_errors").alias("n_errors"), F.min(F.when(F.col("m") == "passed", F.col("v"))).alias("_passed"))
    g = g.withColumn("validation", F.when(F.col("_passed") == 1, "passed").when(F.col("_passed") == 0, "failed").otherwise("not_run")).drop("_passed")
    return g.where(F.col("n_items").isNotNull()).withColumn(
        "verdict", F.when(F.col("n_missing_scripts") == 0, F.lit("complete")).otherwise(F.lit("incomplete")))


def fanin(expected: DataFrame, arrived: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per group, how many expected items there are, how many haven't arrived, which ones
    (``missing``, in order) and whether all have.  One grouped aggregate per item over both
    tables, one per group; a group's list is never longer than what it expects."""
    both = expected.select(*keys, item, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        arrived.select(*keys, item, F.lit(0).alias("e"), F.lit(1).alias("a")))
    each = both.groupBy(*keys, item).agg(F.max("e").alias("e"), F.max("a").alias("a")).where("e = 1")
    late = F.when(F.col("a") == 0, F.struct(F.col(item).alias("item")))  # a struct, so that a null item is listed too
    return each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_expected"), F.count(late).alias("n_missing"),
        F.sort_array(F.collect_list(late)).getField("item").alias("missing")).withColumn("ready", F.col("n_missing") == 0)


def positional_rows(payloads: DataFrame) -> DataFrame:
    """Warehouse result chunks -> rows of any width as two arrays, (names, values); each
    chunk is read by its own column names, and columns without one are col_0 .. col_n."""
    doc = F.try_parse_json("body")
    d = payloads.select(F.try_variant_get(doc, "$.result.schema.columns", "array<struct<name:string>>").alias("c"),
                        F.explode(F.try_variant_get(doc, "$.result.data_array", "array<array<string>>")).alias("r"))
    names = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.coalesce(
        F.get(F.transform("c", lambda x: x["name"]), i), F.concat(F.lit("col_"), i.cast("string"))))
    return d.select(F.when(F.size("r") > 0, names).alias("names"), F.col("r").alias("values"))


def positional_columns(payloads: DataFrame, width: int) -> DataFrame:
    """S06 with the first ``width`` values as columns; wider rows keep the others in ``values``."""
    return positional_rows(payloads).select("names", "values", *[F.get("values", F.lit(i)).alias(f"col_{i}") for i in range(width)])
