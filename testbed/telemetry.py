"""Run-telemetry corpora rendered from ``events`` (SURVEY §5.3 node_runs, failure
messages, probe logs, state snapshots)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewater.sources.tables import Tables

_ENV3 = "CASE user_id % 3 WHEN 0 THEN 'brz' WHEN 1 THEN 'slv' ELSE 'gld' END"

NODE_FIXTURE: list[tuple[str, str]] = [
    ("event_id", "event_id"),
    ("user_id", "user_id"),
    ("ts", "ts"),
    ("pipeline", f"CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 13 = 0 THEN '' "
                 f"ELSE 'pl_' || {_ENV3} || '_' || CAST(user_id % 30 AS STRING) END"),
    ("environment", f"CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'GLD' WHEN 2 THEN 'dev' ELSE {_ENV3} END"),
    ("node_name", "event_type"),
    ("node_type", "CASE WHEN event_type IN ('click', 'view') THEN 'agent' ELSE 'tool' END"),
    ("status", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END"),
    ("elapsed_ms", "value * 10"),
    ("marker", "CASE WHEN event_type = 'signup' THEN 'start' "
               "WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'end' END"),
    # retry loop attempt and probe-log columns
    ("attempt", "CAST(day(ts) % 4 AS INT) + 1"),
    ("val_error", "event_type = 'error' AND value > 250"),
    ("service", "CASE event_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'datafactory' WHEN 2 THEN 'databricks' "
                "ELSE 'llm' END"),
    ("probe_attempt", "CAST(minute(ts) % 4 AS INT) + 1"),
    ("probe_ok", "value > 50"),
    ("has_creds", "(user_id + event_id % 4) % 4 <> 0"),
]

FAILURE_FIXTURE: list[tuple[str, str]] = [
    ("event_id", "event_id"),
    ("poll_message", "CASE event_id % 11 WHEN 0 THEN 'SQL warehouse is not running' "
                     "WHEN 1 THEN 'Warehouse is in state STOPPED' "
                     "WHEN 2 THEN '[TABLE_OR_VIEW_NOT_FOUND] Table or view not found: t_' || CAST(event_id AS STRING) "
                     "WHEN 3 THEN 'Object does not exist in catalog' WHEN 4 THEN '' WHEN 5 THEN NULL "
                     "WHEN 6 THEN 'Cluster is not ready yet' WHEN 7 THEN 'WAREHOUSE FAILED to start' "
                     "ELSE 'Syntax error near ' || event_type END"),
    ("status_code", "CASE event_id % 11 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 "
                    "WHEN 4 THEN 500 WHEN 5 THEN 503 WHEN 6 THEN 204 WHEN 7 THEN 404 ELSE 400 END"),
    ("http_message", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' "
                     "ELSE 'request ' || event_type || ' rejected' END"),
    ("http_error", "CASE WHEN event_type = 'error' THEN 'Warehouse unavailable' "
                   "WHEN event_type = 'view' THEN 'table not found' END"),
]

SNAPSHOT_FIXTURE: list[tuple[str, str]] = [
    ("event_id", "event_id"),
    ("k_env", f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_ENV3} END"),
    ("k_pipeline_info", "'{repo_name: repo-' || CAST(user_id % 25 AS STRING) || '}'"),
    ("k_schema", "CASE WHEN event_id % 2 = 0 THEN 'schema_v4_' || CAST(event_id % 9 AS STRING) END"),
    ("k_pipeline_template", "CASE WHEN event_id % 5 = 0 THEN 'NULL' WHEN event_id % 5 = 1 THEN NULL "
                            "ELSE 'pipeline template ' || event_type END"),
    ("k_transform_template", "CASE WHEN event_id % 3 = 0 THEN 'transform ' || CAST(value AS STRING) END"),
    ("k_notebook_template", "CASE WHEN event_type = 'purchase' THEN 'notebook' END"),
    ("k_credentials", "'token-' || CAST(event_id AS STRING)"),
]


def _select(df: DataFrame, fixture: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in fixture])


def node_runs(t: Tables) -> DataFrame:
    return _select(t.events, NODE_FIXTURE)


def failures(t: Tables) -> DataFrame:
    return _select(t.events, FAILURE_FIXTURE)


def state_snapshots(t: Tables) -> DataFrame:
    """state(event_id, state MAP<STRING,STRING>): run-state records.  The literal
    'NULL' marks a key present with a null value; a SQL NULL means absent."""
    s = _select(t.events, SNAPSHOT_FIXTURE)
    keys = [("environment_type", "k_env"), ("pipeline_info", "k_pipeline_info"), ("credentials", "k_credentials"),
            ("normalized_schema_v4", "k_schema"), ("pipeline_template", "k_pipeline_template"),
            ("raw_artifacts", "k_credentials"), ("transform_template", "k_transform_template"),
            ("notebook_template", "k_notebook_template")]
    m = "map(" + ", ".join(f"'{k}', {v}" for k, v in keys) + ")"
    return s.selectExpr("event_id", f"transform_values(map_filter({m}, (k, v) -> v IS NOT NULL), "
                                    f"(k, v) -> nullif(v, 'NULL')) AS state")


def fixture_sql(fixture: list[tuple[str, str]], source: str = "events") -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fixture) + f" FROM {source}"
