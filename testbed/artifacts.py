"""Test-bed corpora rendered from the driver tables.

The source system works on documents (trigger JSON, manifests, factory files,
notebooks, validator logs, dataset specs).  The driver ships relational tables,
so each corpus here is *rendered* from them inside the query: a fixture decides,
row by row, which value every document field takes (including empty strings,
absent keys, explicit nulls and malformed bodies), and Spark serialises the
document.  The operators then parse the documents back.

The fixture rules are plain SQL expressions in the subset Spark SQL and DuckDB
share (CASE, %, ||, CAST AS STRING, lpad, lower, replace, substr), so the DuckDB
oracle evaluates the *same input* and derives the expected output directly from
the relational columns, independently of any parsing.

Every corpus is a per-row (or per-order, bounded by lines per order) projection
of a driver table, so it grows linearly with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.tables import Tables


def _select(df: DataFrame, fixture: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    return df.selectExpr(*keep, *[f"{expr} AS {name}" for name, expr in fixture])


def fixture_sql(fixture: list[tuple[str, str]]) -> str:
    """The fixture as a DuckDB select list (used by the oracle)."""
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in fixture)


# ---------------------------------------------------------------------------
# Triggers: one legacy trigger document per order.
# ---------------------------------------------------------------------------

TRIGGER_FROM = (
    "orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)

_HH = "lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')"
_MM = "lpad(CAST(o_custkey % 60 AS STRING), 2, '0')"

TRIGGER_FIXTURE: list[tuple[str, str]] = [
    ("trigger_id", "o_orderkey"),
    ("repo", "'repo-' || CAST(c_nationkey AS STRING) || '-repo-adf'"),
    ("t_name", "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'trg_' || lower(replace(r_name, ' ', '_')) "
               "|| '_' || substr(o_orderpriority, 1, 1) || '_' || CAST(o_orderkey AS STRING) END"),
    ("t_prop_type", "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ScheduleTrigger' ELSE 'BlobEventsTrigger' END"),
    ("t_top_type", "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 'ScheduleTrigger' END"),
    ("t_malformed", "o_orderkey % 97 = 0"),
    ("t_no_pipelines", "o_orderkey % 53 = 0"),
    ("p_ref", "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'pl_gone_' || CAST(o_custkey AS STRING) ELSE 'pl_' || CAST(o_custkey AS STRING) END"),
    ("p_source_system_zone", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE lower(replace(r_name, ' ', '_')) END"),
    ("p_target_zone", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'lz_' || CAST(r_regionkey AS STRING) END"),
    ("p_domain", "CASE c_custkey % 5 WHEN 0 THEN c_mktsegment "
                 "WHEN 1 THEN '  ' || lower(c_mktsegment) || ' ' "
                 "WHEN 2 THEN CASE c_mktsegment WHEN 'MACHINERY' THEN ' Tech ' WHEN 'AUTOMOBILE' THEN 'Sale' "
                 "WHEN 'HOUSEHOLD' THEN 'SALES' ELSE '   ' END "
                 "WHEN 3 THEN '' ELSE NULL END"),
    ("p_source_system", "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'sys_' || CAST(c_nationkey AS STRING) END"),
    ("p_source_system_raw", "'raw_' || CAST(c_nationkey AS STRING)"),
    # schedule: minutes as list / bare int / bare string / absent; hours as list / empty list / absent
    ("s_min_kind", "CASE WHEN o_orderstatus <> 'F' THEN 'none' WHEN o_orderkey % 5 IN (0, 4) THEN 'list' "
                   "WHEN o_orderkey % 5 = 1 THEN 'int' WHEN o_orderkey % 5 = 2 THEN 'str' ELSE 'none' END"),
    ("s_hour_kind", "CASE WHEN o_orderstatus = 'O' THEN 'none' "
                    "WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 4 THEN 'empty' ELSE 'list' END"),
    ("s_min", "CAST(o_orderkey % 60 AS INT)"),
    ("s_hour", "CAST(o_custkey % 24 AS INT)"),
    ("s_start_kind", "CAST(o_orderkey % 3 AS INT)"),
    ("s_start_hh", f"CAST(o_orderkey % 24 AS INT)"),
    ("s_start_mm", f"CAST(o_custkey % 60 AS INT)"),
    ("s_start_utc", "o_custkey % 2 = 0"),
    ("s_start", "CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE o_orderkey % 3 "
                f"WHEN 0 THEN 'T' || {_HH} || ':' || {_MM} || ':00Z' "
                f"WHEN 1 THEN 'T' || {_HH} || ':' || {_MM} || CASE WHEN o_custkey % 2 = 0 THEN ':00 UTC' ELSE 'Z' END ELSE '' END"),
    # manifest document of the trigger: its case, and whether it is block-style YAML or JSON
    ("m_case", "CASE o_orderkey % 43 WHEN 1 THEN 'empty' WHEN 2 THEN 'no_repo' WHEN 3 THEN 'wrong_type' WHEN 4 THEN 'broken' ELSE 'ok' END"),
    ("m_yaml", "o_orderkey % 2 = 1"),
    ("m_access_kind", "CAST(o_custkey % 4 AS INT)"),  # 0 absent, 1 empty list, else two groups
    ("m_group_r", "'grp-' || lower(replace(r_name, ' ', '_')) || '-r'"),
    ("m_group_rw", "'grp-nation' || CAST(c_nationkey AS STRING) || '-rw'"),
    ("m_platform", "CASE WHEN o_orderkey % 31 = 0 THEN 'cobos' WHEN o_orderkey % 2 = 0 THEN 'platform_3_0' END"),
    ("m_quality_repo", "CASE WHEN o_orderkey % 3 = 0 THEN 'governance-repo' END"),
    ("m_connection_id", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' "
                        "WHEN 2 THEN '  conn_' || CAST(c_nationkey AS STRING) || ' ' "
                        "ELSE 'conn_' || CAST(r_regionkey AS STRING) END"),
    # metadata document: 0 no state, 1 no access_groups key, 2 explicit null, 3 empty list, else list
    ("md_kind", "CAST(o_custkey % 6 AS INT)"),
]

# Item order inside a trigger: a total order over every lineitem column.
ITEM_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)

ITEM_FIXTURE: list[tuple[str, str]] = [
    ("trigger_id", "l_orderkey"),
    ("b_present", "l_returnflag <> 'R'"),
    ("b_empty", "l_returnflag = 'A' AND l_suppkey % 11 = 0"),
    ("b_target_table", "CASE WHEN l_linenumber % 2 = 0 THEN 't_' || CAST(l_partkey % 5 AS STRING) ELSE 't_' || CAST(CAST(floor(l_partkey / 60) AS BIGINT) AS STRING) END"),
    ("b_source_table", "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 's_' || CAST(l_suppkey AS STRING) END"),
    ("b_target_zone", "CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN NULL "
                      "ELSE 'bz_' || CAST(l_suppkey % 3 AS STRING) END"),
    ("b_domain", "CASE l_partkey % 4 WHEN 0 THEN 'tech' WHEN 1 THEN ' Retail ' ELSE NULL END"),
    ("b_source_system", "CASE WHEN l_suppkey % 2 = 0 THEN 'bsys_' || CAST(l_suppkey % 10 AS STRING) ELSE '' END"),
    ("b_source_system_raw", "'braw_' || CAST(l_suppkey % 7 AS STRING)"),
    ("b_country", "CASE WHEN l_linenumber % 2 = 0 THEN 'c' || CAST(l_suppkey % 5 AS STRING) ELSE NULL END"),
    ("b_raw_zone", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'rz_' || CAST(l_partkey % 3 AS STRING) END"),
    ("b_nb_path", "CASE WHEN l_partkey % 50 = 7 THEN '//repo-code' "
                  "WHEN l_partkey % 4 = 0 THEN '//repo-code/notebooks/brz/nb_' || CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS STRING) "
                  "WHEN l_partkey % 4 = 1 THEN 'notebooks/brz/nb_' || CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS STRING) || '.py' "
                  "WHEN l_partkey % 4 = 2 THEN 'notebooks/brz/nb_' || CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS STRING) "
                  "ELSE '' END"),
    ("s_present", "l_linestatus = 'F'"),
    ("s_empty", "l_suppkey % 17 = 0"),
    ("s_target_table", "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE CASE WHEN l_linenumber % 2 = 0 THEN 't_' || CAST(l_partkey % 5 AS STRING) ELSE 't_' || CAST(CAST(floor(l_partkey / 60) AS BIGINT) AS STRING) END END"),
    ("s_source_table", "'ss_' || CAST(l_suppkey AS STRING)"),
    ("s_target_zone", "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'sz_' || CAST(l_partkey % 2 AS STRING) END"),
    ("s_domain", "CASE l_partkey % 3 WHEN 0 THEN 'Sales' WHEN 1 THEN ' tech ' ELSE 'finance' END"),
    ("s_source_system", "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'ssys_' || CAST(l_suppkey % 4 AS STRING) END"),
    ("s_source_system_raw", "'sraw_' || CAST(l_suppkey % 3 AS STRING)"),
    ("s_country", "'sc' || CAST(l_suppkey % 3 AS STRING)"),
    ("s_db_kind", "CAST(l_linenumber % 5 AS INT)"),  # 0 absent, 1 explicit null, else value
    ("s_target_database", "'db_' || CAST(l_partkey % 2 AS STRING)"),
    ("s_nb_path", "'//repo-code/notebooks/slv/ns_' || CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS STRING)"),
]

_BRONZE_KEYS = [
    ("target_table", "b_target_table"), ("source_table", "b_source_table"),
    ("target_zone", "b_target_zone"), ("target_business_domain", "b_domain"),
    ("source_system", "b_source_system"), ("source_system_raw", "b_source_system_raw"),
    ("source_system_country", "b_country"), ("source_raw_zone", "b_raw_zone"),
    ("adb_notebook_path", "b_nb_path"),
]
_SILVER_KEYS = [
    ("target_table", "s_target_table"), ("source_table", "s_source_table"),
    ("target_zone", "s_target_zone"), ("target_business_domain", "s_domain"),
    ("source_system", "s_source_system"), ("source_system_raw", "s_source_system_raw"),
    ("source_system_country", "s_country"), ("adb_notebook_path", "s_nb_path"),
]


def _json_obj(pairs: list[tuple[str, str]], extra: str | None = None) -> str:
    """JSON object text by concatenation (fixture values need no escaping); a
    NULL value leaves its key absent."""
    parts = [f"'\"{k}\":\"' || {v} || '\"'" for k, v in pairs] + ([extra] if extra else [])
    return "concat('{', concat_ws(',', " + ", ".join(parts) + "), '}')"


def _bronze_json() -> str:
    return f"CASE WHEN b_empty THEN '{{}}' ELSE {_json_obj(_BRONZE_KEYS)} END"


def _silver_json() -> str:
    db = ("CASE s_db_kind WHEN 0 THEN NULL WHEN 1 THEN '\"target_database\":null' "
          "ELSE '\"target_database\":\"' || s_target_database || '\"' END")
    return f"CASE WHEN s_empty THEN '{{}}' ELSE {_json_obj(_SILVER_KEYS, db)} END"


ITEM_ENTRY_JSON = ("concat('{', concat_ws(',', "
                   f"CASE WHEN b_present THEN '\"load_to_bronze\":' || {_bronze_json()} END, "
                   f"CASE WHEN s_present THEN '\"load_to_silver\":' || {_silver_json()} END), '}}')")


def trigger_rows(t: Tables) -> DataFrame:
    """Relational fixture of the trigger corpus (one row per order)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    # customer / nation / region are dimension tables; AQE picks broadcast-hash
    # joins from their measured size, sort-merge otherwise.
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))
    # dealt out before anything is rendered: a file of orders is a few splits only, and a
    # document is many times the size of its row
    return _select(base.repartition("o_orderkey"), TRIGGER_FIXTURE)


def item_rows(t: Tables) -> DataFrame:
    cols = [c.strip() for c in ITEM_ORDER.split(",")]
    rows = t.lineitem.select("l_orderkey", *cols).where("l_orderkey IS NOT NULL")
    return _select(rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey"), ITEM_FIXTURE, keep=tuple(cols))


def render_triggers(t: Tables) -> DataFrame:
    """triggers(trigger_id, repo, body): one JSON document per order."""
    # The lines are dealt out and sorted as plain columns and rendered where their trigger is,
    # so no rendered entry is shuffled; lines without an order are in no document.
    items = item_rows(t).selectExpr("trigger_id", f"struct({ITEM_ORDER}, {ITEM_ENTRY_JSON} AS entry) AS item")
    # One document per order: lines per order are bounded by the order itself.
    per_trigger = items.groupBy("trigger_id").agg(
        F.expr("concat('[', array_join(sort_array(collect_list(item)).entry, ','), ']')")
        .alias("items_json")
    )
    # never a broadcast: the estimated size of the lists knows nothing of the rendered text
    trig = trigger_rows(t).join(per_trigger.hint("merge"), "trigger_id", "left")
    minutes = ("CASE s_min_kind WHEN 'list' THEN '[' || CAST(s_min AS STRING) || ']' "
               "WHEN 'int' THEN CAST(s_min AS STRING) "
               "WHEN 'str' THEN '\"' || CAST(s_min AS STRING) || '\"' END")
    hours = ("CASE s_hour_kind WHEN 'list' THEN '[' || CAST(s_hour AS STRING) || ']' "
             "WHEN 'empty' THEN '[]' END")
    schedule = (f"CASE WHEN s_min_kind = 'none' AND s_hour_kind = 'none' THEN NULL ELSE "
                f"concat('{{', concat_ws(',', "
                f"CASE WHEN s_hour_kind <> 'none' THEN '\"hours\":' || {hours} END, "
                f"CASE WHEN s_min_kind <> 'none' THEN '\"minutes\":' || {minutes} END), '}}') END")
    recurrence = (f"concat('{{\"frequency\":\"Day\",\"interval\":1,', "
                  f"coalesce('\"schedule\":' || {schedule} || ',', ''), "
                  f"'\"startTime\":\"', s_start, '\"}}')")
    params = ("to_json(named_struct('source_system_zone', p_source_system_zone, 'target_zone', p_target_zone, "
              "'target_business_domain', p_domain, 'source_system', p_source_system, "
              "'source_system_raw', p_source_system_raw))")
    header = "to_json(named_struct('name', t_name, 'type', t_top_type))"
    # staged: each JSON piece is built once per trigger
    staged = (trig.selectExpr("trigger_id", "repo", "t_malformed", "t_no_pipelines", "t_prop_type", "p_ref",
                              "items_json", f"{params} AS params_json", f"{recurrence} AS rec_json",
                              f"{header} AS header_json")
              .selectExpr("trigger_id", "repo", "t_malformed", "t_no_pipelines", "t_prop_type", "rec_json",
                          "header_json", "concat('{', CASE WHEN p_ref IS NULL THEN '' ELSE "
                          "'\"pipelineReference\":{\"referenceName\":\"' || p_ref || '\"},' END, "
                          "'\"parameters\":', substr(params_json, 1, length(params_json) - 1), "
                          "CASE WHEN length(params_json) > 2 THEN ',' ELSE '' END, "
                          "'\"items_to_process\":{\"pipelines\":', coalesce(items_json, '[]'), '}}}') AS pipe_json")
              .selectExpr("trigger_id", "repo", "t_malformed",
                          "concat(substr(header_json, 1, length(header_json) - 1), ',\"properties\":', "
                          "concat('{\"type\":\"', t_prop_type, '\",\"pipelines\":[', "
                          "CASE WHEN t_no_pipelines THEN '' ELSE pipe_json END, '],', "
                          "'\"typeProperties\":{\"recurrence\":', rec_json, '}}'), '}') AS full_body"))
    return staged.selectExpr(
        "trigger_id", "repo",
        "CASE WHEN t_malformed THEN substr(full_body, 1, CAST(length(full_body) / 2 AS INT)) ELSE full_body END AS body")


def render_manifests(t: Tables) -> DataFrame:
    """manifests(trigger_id, body): the run manifest of every trigger, as YAML or JSON; some
    are empty, broken, lack the repository or give it another type, and all have keys
    that no model knows."""
    rows = trigger_rows(t)
    groups = ("CASE m_access_kind WHEN 0 THEN NULL WHEN 1 THEN CAST(array() AS ARRAY<STRING>) "
              "ELSE array(m_group_r, m_group_rw) END")
    repo = "CASE m_case WHEN 'no_repo' THEN NULL ELSE repo END"
    rest = (f"'access_groups', {groups}, 'source_platform', m_platform, 'quality_repo', m_quality_repo, "
            f"'connection_id', m_connection_id, 'reviewed', true")
    as_json = (f"CASE m_case WHEN 'wrong_type' THEN to_json(named_struct('pipeline_info', named_struct('repo_name', array(repo), "
               f"'trigger_name', nullif(t_name, '')), {rest})) "
               f"ELSE to_json(named_struct('pipeline_info', named_struct('repo_name', {repo}, "
               f"'trigger_name', nullif(t_name, '')), {rest})) END")
    line = lambda key, value: f"CASE WHEN {value} IS NOT NULL THEN '{key}: ' || {value} END"
    as_yaml = ("concat_ws(chr(10), '# run manifest', 'pipeline_info:', '  kind: legacy', "
               "CASE m_case WHEN 'no_repo' THEN NULL WHEN 'wrong_type' THEN '  repo_name: [' || repo || ']' ELSE '  repo_name: ' || repo END, "
               "CASE WHEN t_name <> '' THEN '  trigger_name: \"' || t_name || '\"' END, "
               "CASE m_access_kind WHEN 0 THEN NULL WHEN 1 THEN 'access_groups: []' "
               "ELSE 'access_groups:' || chr(10) || '  - ' || m_group_r || chr(10) || '  - ' || m_group_rw END, "
               + line("source_platform", "m_platform") + ", " + line("quality_repo", "m_quality_repo") + ", "
               "CASE WHEN m_connection_id IS NOT NULL THEN 'connection_id: \"' || m_connection_id || '\"' END, 'reviewed: yes')")
    body = f"CASE WHEN m_case = 'empty' THEN '' WHEN m_case = 'broken' THEN 'pipeline_info: [not closed' WHEN m_yaml THEN {as_yaml} ELSE {as_json} END"
    return rows.selectExpr("trigger_id", f"{body} AS body")


def render_metadata(t: Tables) -> DataFrame:
    """metadata(trigger_id, body): run-state metadata carrying access groups."""
    rows = trigger_rows(t)
    body = ("CASE md_kind WHEN 0 THEN '{\"owner\":\"platform\"}' "
            "WHEN 1 THEN '{\"state\":{\"metadata\":{\"owner\":\"platform\"}}}' "
            "WHEN 2 THEN '{\"state\":{\"metadata\":{\"access_groups\":null}}}' "
            "WHEN 3 THEN '{\"state\":{\"metadata\":{\"access_groups\":[]}}}' "
            "ELSE '{\"state\":{\"metadata\":{\"access_groups\":[\"' || m_group_r || '\"]}}}' END")
    return rows.selectExpr("trigger_id", f"{body} AS body")


# ---------------------------------------------------------------------------
# Factory (global-parameter) files: several per orchestration repo, from supplier.
# ---------------------------------------------------------------------------

FACTORY_FIXTURE: list[tuple[str, str]] = [
    ("repo", "'repo-' || CAST(s_nationkey AS STRING) || '-repo-adf'"),
    ("file_name", "CASE s_suppkey % 3 WHEN 0 THEN 'sap-adf-' || CAST(s_suppkey AS STRING) || '.json' "
                  "WHEN 1 THEN 'factory-' || CAST(s_suppkey AS STRING) || '.json' "
                  "ELSE 'notes-' || CAST(s_suppkey AS STRING) || '.md' END"),
    ("f_zone", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'maz' END"),
    ("f_domain", "CASE s_suppkey % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'tech' ELSE NULL END"),
    ("f_owner", "'owner_' || CAST(s_suppkey % 5 AS STRING)"),
    ("f_retries", "CAST(s_suppkey % 5 AS INT)"),
    ("f_bad_param", "s_suppkey % 7 = 3"),
    ("f_prod_nonempty", "s_suppkey % 2 = 0"),
    ("f_prod_domain", "CASE WHEN s_suppkey % 4 = 0 THEN 'tech' ELSE 'sales' END"),
    ("f_prod_landing", "'lz_' || CAST(s_suppkey % 3 AS STRING)"),
    ("f_dev_domain", "'tech'"),
    ("f_dev_zone", "'maz'"),
]


def _param(name: str, json_value: str, typ: str, when: str | None = None) -> str:
    """One ``"name": {"type": ..., "value": ...}`` global-parameter entry."""
    entry = f"'\"{name}\":{{\"type\":\"{typ}\",\"value\":' || {json_value} || '}}'"
    return f"CASE WHEN {when} THEN {entry} END" if when else entry


def render_factories(t: Tables) -> DataFrame:
    """factories(repo, path, name, body): files under ``factory/`` of each repo."""
    rows = _select(t.supplier, FACTORY_FIXTURE)
    prod = ("CASE WHEN f_prod_nonempty THEN '{\"project_business_domain\":\"' || f_prod_domain || "
            "'\",\"landing_zone\":\"' || f_prod_landing || '\"}' ELSE '{}' END")
    dev = ("'{\"project_business_domain\":\"' || f_dev_domain || "
           "'\",\"project_zone\":\"' || f_dev_zone || '\"}'")
    parts = ", ".join([
        _param("project_zone", "'\"' || f_zone || '\"'", "String", "f_zone IS NOT NULL"),
        _param("project_business_domain", "'\"' || f_domain || '\"'", "String", "f_domain IS NOT NULL"),
        _param("owner", "'\"' || f_owner || '\"'", "String"),
        _param("retries", "CAST(f_retries AS STRING)", "Int"),
        "CASE WHEN f_bad_param THEN '\"legacy_flag\":7' END",
        _param("default_parameters_per_environment",
               f"'{{\"prod\":' || {prod} || ',\"dev\":' || {dev} || '}}'", "Object"),
    ])
    body = ("'{\"name\":\"' || replace(file_name, '.json', '') || '\",\"properties\":{\"globalParameters\":{' "
            f"|| concat_ws(',', {parts}) || '}}}}}}'")
    return rows.selectExpr("repo", "'factory/' || file_name AS path", "file_name AS name", f"{body} AS body")


# ---------------------------------------------------------------------------
# Pipeline definitions referenced by triggers, from customer.
# ---------------------------------------------------------------------------

PIPELINE_DEF_FIXTURE: list[tuple[str, str]] = [
    ("repo", "'repo-' || CAST(c_nationkey AS STRING) || '-repo-adf'"),
    ("name", "'pl_' || CAST(c_custkey AS STRING)"),
    ("def_key", "c_custkey"),
]


def render_pipeline_defs(t: Tables) -> DataFrame:
    """pipeline_defs(repo, name, body): one definition per customer; triggers also refer to
    names that no definition has."""
    return _select(t.customer, PIPELINE_DEF_FIXTURE).selectExpr(
        "repo", "name",
        "'{\"name\":\"' || name || '\",\"properties\":{\"activities\":[{\"name\":\"run_' || "
        "CAST(def_key AS STRING) || '\"}]}}' AS body")


# ---------------------------------------------------------------------------
# Notebook library of the code repos, from documents.
# ---------------------------------------------------------------------------

NOTEBOOK_FIXTURE: list[tuple[str, str]] = [
    ("repo", "'repo-' || CAST(doc_id % 25 AS STRING) || '-repo-adb'"),
    ("path", "CASE WHEN CAST(floor(doc_id / 25) AS BIGINT) % 3 = 0 THEN 'notebooks/slv/ns_' ELSE 'notebooks/brz/nb_' END "
             "|| CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING) || '.py'"),
    ("content", "CASE doc_id % 6 WHEN 0 THEN 'df = read(opflag)' || chr(10) || text "
                "WHEN 1 THEN text || chr(10) || 'write_stream_delta_table(df)' ELSE text END"),
]


def render_notebooks(t: Tables) -> DataFrame:
    """notebooks(repo, path, content): one file per document; triggers also refer to numbers
    whose notebook is of the other layer or isn't there."""
    return _select(t.documents, NOTEBOOK_FIXTURE)


# ---------------------------------------------------------------------------
# Data-quality rule library of the governance repo, from part.
# ---------------------------------------------------------------------------

RULE_FIXTURE: list[tuple[str, str]] = [
    ("path", "'src/maz/maz/' || CASE p_partkey % 2 WHEN 0 THEN 'sales' ELSE 'tech' END || '/' || "
             "CASE p_partkey % 5 WHEN 4 THEN 'unknown' ELSE 'ssys_' || CAST(p_partkey % 5 AS STRING) END || "
             "'/dq_definitions/sc' || CAST(p_partkey % 3 AS STRING) || '/' || "
             "CASE p_partkey % 4 WHEN 2 THEN 'unknown' WHEN 3 THEN 'None' ELSE 'db_' || CAST(p_partkey % 4 AS STRING) END "
             "|| '/t_' || CAST(CAST(floor(p_partkey / 60) AS BIGINT) AS STRING) || '.yaml'"),
    ("content", "'expectations:' || chr(10) || '  - not_null: ' || p_name || chr(10) || '  - brand: ' || p_brand"),
]


def render_quality_rules(t: Tables) -> DataFrame:
    """quality_rules(path, content): one YAML file per part."""
    return _select(t.part, RULE_FIXTURE)


# ---------------------------------------------------------------------------
# Repository file API dumps, from pages.
# ---------------------------------------------------------------------------

PAGE_FIXTURE: list[tuple[str, str]] = [
    ("page_id", "page_id"),
    ("repo", "regexp_extract(url, '^https?://([^/?#]+)', 1)"),
    ("path", "regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1)"),
    ("bad_payload", "page_id % 13 = 5"),
    ("noisy", "page_id % 13 = 7"),
    ("html", "html"),
]


def render_repo_files(t: Tables) -> DataFrame:
    """repo_files(repo, ref, path, name, type, content_b64): one file entry per
    (repo, ref, path) — the lowest page id renders it, every fourth page also on a second
    ref with other content — plus one entry per directory of a ref.  Payloads may hold
    characters outside the alphabet, which decoders skip, or lack their last character."""
    rows = _select(t.pages, PAGE_FIXTURE)
    first = rows.groupBy("repo", "path").agg(F.min_by(F.struct("bad_payload", "noisy", "html", "page_id"), "page_id").alias("f"))
    refs = F.explode(F.when(F.col("f.page_id") % 4 == 0, F.array(F.lit("main"), F.lit("dev"))).otherwise(F.array(F.lit("main"))))
    files = first.withColumn("ref", refs).withColumn("body", F.when(F.col("ref") == "dev", F.concat(F.lit("dev "), "f.html")).otherwise(F.col("f.html"))).selectExpr(
        "repo", "ref", "path", "element_at(split(path, '/'), -1) AS name", "'file' AS type",
        # one character more than whole groups of four can't be decoded
        "CASE WHEN f.bad_payload THEN rtrim('=', base64(body)) || substr('AAAAA', 1, (5 - length(rtrim('=', base64(body))) % 4) % 4) "
        "WHEN f.noisy THEN '!!' || base64(body) || ' -' ELSE base64(body) END AS content_b64")
    dirs = (files.select("repo", "ref", F.explode(F.expr(
        "transform(sequence(1, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))"
    )).alias("path")).where(F.col("path") != "").distinct()
        .join(files.select("repo", "ref", "path"), ["repo", "ref", "path"], "left_anti")
        .selectExpr("repo", "ref", "path", "element_at(split(path, '/'), -1) AS name",
                    "'dir' AS type", "CAST(NULL AS STRING) AS content_b64"))
    return files.unionByName(dirs)


def render_file_requests(t: Tables) -> DataFrame:
    """file_requests(repo, ref, path): every page path on its main ref, every second one on
    the other ref too, its parent folder, and a missing sibling for every ninth page."""
    rows = _select(t.pages, PAGE_FIXTURE)
    return (rows.selectExpr("repo", "'main' AS ref", "path")
            .unionByName(rows.where("page_id % 2 = 0").selectExpr("repo", "'dev' AS ref", "path"))
            .unionByName(rows.selectExpr("repo", "'main' AS ref", "regexp_extract(path, '^(.*)/[^/]*$', 1) AS path"))
            .unionByName(rows.where("page_id % 9 = 0").selectExpr("repo", "'main' AS ref", "path || '.bak' AS path"))
            .where("path <> ''").distinct())


# ---------------------------------------------------------------------------
# Validator logs: 1-6 lines per event; the run is the user, lines ordered by
# (event_id, slot).  The event type decides the block kind.
# ---------------------------------------------------------------------------

_TS = ("CAST(CAST(ts AS DATE) AS STRING) || ' ' || lpad(CAST(hour(ts) AS STRING), 2, '0') || ':' || "
       "lpad(CAST(minute(ts) AS STRING), 2, '0')")
_FILE = ("CASE event_id % 5 WHEN 0 THEN 'maker.py' "
         "WHEN 1 THEN '`/tmp/erp_' || CAST(user_id % 7 AS STRING) || '.yaml`' "
         "WHEN 2 THEN '//tmp/nb_' || CAST(event_id % 11 AS STRING) || '.ipynb' "
         "WHEN 3 THEN '\"dags/d_' || CAST(event_id % 13 AS STRING) || '.YML\"' ELSE 'notes.txt' END")
_YAML = "'/tmp/cfg_' || CAST(user_id % 5 AS STRING) || '_' || CAST(event_id % 3 AS STRING) || '.yaml'"
_MSG = ("CASE event_id % 4 WHEN 0 THEN 'field is empty' WHEN 1 THEN 'wants yes or no' "
        "WHEN 2 THEN 'unknown key k' || CAST(event_id % 17 AS STRING) "
        "ELSE 'value out of range: ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) END")
_T, _L = "'  ├─ ", "'  └─ "

LOG_LINE_SLOTS: list[str] = [
    # slot 0
    f"CASE event_type WHEN 'error' THEN {_TS} || ' UTC | ✗ ERROR | [ERROR_OCCURRED] | File Name: ' || {_FILE} "
    f"WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN '[DAG_VALIDATION_ERROR_TASK_LEVEL]' "
    f"ELSE '2025 | ⚠ WARNING | [DAG_VALIDATION_ERROR_TASK_LEVEL] | File Name: ' || {_FILE} END "
    f"WHEN 'signup' THEN '[DAG_VALIDATION_FAILED]' "
    f"WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN {_TS} || ' UTC | ✗ ERROR   | [CLI_DAG_VALIDATION_FAILED] | File Name: cli.py' "
    f"ELSE '[DAG_VALIDATION_ERROR_BASE_LEVEL]' END "
    f"ELSE 'INFO view event ' || CAST(event_id AS STRING) || ' processed' END",
    # slot 1
    f"CASE event_type WHEN 'error' THEN {_T}Error Code: X' || lpad(CAST(event_id % 100000 AS STRING), 7, '0') "
    f"WHEN 'click' THEN {_T}Task Name: task_' || CAST(event_id % 9 AS STRING) "
    f"WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN {_L}YAML File: ' || {_YAML} END "
    f"WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN {_T}YAML Key: visible' "
    f"WHEN event_id % 3 = 0 THEN {_T}Error Message: ' "
    f"ELSE {_T}Error Message: [X-204] graph check: two nodes share one name' END "
    f"ELSE CASE WHEN event_id % 5 = 0 THEN '    Yaml File: /tmp/info_' || CAST(event_id % 4 AS STRING) || '.yaml' END END",
    # slot 2
    f"CASE event_type WHEN 'error' THEN {_T}Category: ' || CASE event_id % 3 WHEN 0 THEN 'VALIDATION' "
    f"WHEN 1 THEN 'RUNTIME' ELSE 'IO' END "
    f"WHEN 'click' THEN {_T}Yaml Key: ' || CASE WHEN event_id % 2 = 0 THEN 'acl' ELSE 'visible' END "
    f"WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN {_T}Error Message: wants yes or no' "
    f"ELSE {_L}Command: ingestion' END END",
    # slot 3
    f"CASE event_type WHEN 'error' THEN {_T}Severity: ' || CASE WHEN value > 200 THEN 'HIGH' ELSE 'MEDIUM' END "
    f"WHEN 'click' THEN {_L}Error Message: ' || {_MSG} "
    f"WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN {_L}Yaml File: ' "
    f"WHEN event_id % 7 = 3 THEN {_L}Yaml File: ``' END END",
    # slot 4
    f"CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN {_T}User Message: ' || {_MSG} "
    f"WHEN 1 THEN {_T}Technical Message: ' || {_MSG} ELSE {_T}Error Message: ' END END",
    # slot 5
    f"CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN {_L}Yaml File: ' || {_YAML} END",
]


def render_validation_log(t: Tables) -> DataFrame:
    """validation_log(run_id, line_no, line): a pure per-event projection (no sort)."""
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    slots = ", ".join(LOG_LINE_SLOTS)
    return (ev.selectExpr("user_id AS run_id", "event_id", f"posexplode(array({slots})) AS (slot, line)")
            .where("line IS NOT NULL")
            .selectExpr("run_id", "event_id * 10 + slot AS line_no", "line"))


def render_raw_output(t: Tables) -> DataFrame:
    """raw_output(run_id, output): the lines of a run as one text (the unit the validator
    prints, so its size is the input's), with several kinds of line breaks."""
    lines = render_validation_log(t)
    breaks = "CASE line_no % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END"
    each = lines.select("run_id", F.struct("line_no", F.concat("line", F.expr(breaks)).alias("text")).alias("x"))
    return each.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.text), "").alias("output"))


def log_lines_sql() -> str:
    """DuckDB: the same log lines, for the oracle."""
    slots = ", ".join(LOG_LINE_SLOTS)
    return (f"SELECT user_id AS run_id, event_id * 10 + s.slot - 1 AS line_no, s.line FROM events, "
            f"LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS slot "
            f"FROM (SELECT [{slots}] AS l)) s WHERE s.line IS NOT NULL")


# CLI results per event: stdout / stderr pieces (F16) and a per-run return code.
CLI_FIXTURE: list[tuple[str, str]] = [
    ("event_id", "event_id"),
    ("run_id", "user_id"),
    ("stdout", "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'validated ' || event_type || ' ' || CAST(event_id AS STRING) END"),
    ("stderr", "CASE WHEN event_type = 'error' THEN 'error in event ' || CAST(event_id AS STRING) "
               "WHEN event_id % 3 = 0 THEN '' ELSE NULL END"),
    ("return_code", "CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 1 ELSE 0 END"),
]


#: The validation run that looked at a trigger; some triggers were never validated.
TRIGGER_RUN_FIXTURE: list[tuple[str, str]] = [
    ("trigger_id", "o_orderkey"),
    ("run_id", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 2000 END"),
]


def render_trigger_runs(t: Tables) -> DataFrame:
    return _select(t.orders, TRIGGER_RUN_FIXTURE)


def render_cli_results(t: Tables) -> DataFrame:
    return _select(t.events, CLI_FIXTURE)
