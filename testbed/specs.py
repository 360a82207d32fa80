"""Dataset-spec corpora rendered from ``part``: one normalized spec document per
part in two versions (v2 changes, adds and drops keys by modulus), and one
canonical-schema document per part.

Per-dataset and per-column values are SQL templates over the part columns and
the loop variables ``j`` (dataset), ``k`` (column), ``i`` (transformation /
dependency); Spark evaluates them inside ``transform(sequence(...))`` lambdas,
the DuckDB oracle inside ``unnest(range(...))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewater.sources.tables import Tables

P = "p_partkey"

SPEC_FIXTURE: list[tuple[str, str]] = [
    ("spec_id", P),
    ("env_prefix", f"CASE {P} % 4 WHEN 0 THEN 'brz' WHEN 1 THEN 'slv' WHEN 2 THEN 'gld' ELSE 'raw' END"),
    ("dom", "lower(p_type)"),
    ("zone", f"CASE {P} % 2 WHEN 0 THEN 'maz' ELSE 'saz' END"),
    ("country", f"CASE {P} % 3 WHEN 0 THEN 'br' WHEN 1 THEN 'mx' ELSE 'co' END"),
    ("entity", "lower(replace(p_name, ' ', '_'))"),
    ("n_ds", f"CASE WHEN {P} % 3 = 0 THEN 2 ELSE 1 END"),
    ("orphan_task", f"{P} % 7 = 0"),
    ("schedule_v1", f"CAST({P} % 60 AS STRING) || ' ' || CAST(p_size % 24 AS STRING) || ' * * *'"),
    ("schedule_v2", f"CASE WHEN {P} % 7 = 3 THEN '0 ' || CAST((p_size + 1) % 24 AS STRING) || ' * * *' "
                    f"ELSE CAST({P} % 60 AS STRING) || ' ' || CAST(p_size % 24 AS STRING) || ' * * *' END"),
]

SPEC_NAME = "env_prefix || '_' || zone || '_' || dom || '_' || CAST(spec_id AS STRING)"

# dataset-level templates ({j} = dataset index)
DS = {
    "name": "'ds_' || CAST(spec_id AS STRING) || '_' || CAST({j} AS STRING)",
    "n_cols": "2 + (spec_id + {j}) % 4",
    "file_type": "CASE (spec_id + {j}) % 2 WHEN 0 THEN 'parquet' ELSE 'csv' END",
    "has_quality_include": "(spec_id + {j}) % 4 <> 3",
    "has_acl_include": "spec_id % 5 <> 0",
    "mode_v1": "CASE spec_id % 3 WHEN 0 THEN 'overwrite' ELSE 'append' END",
    "mode_v2": "CASE WHEN spec_id % 4 = 0 THEN CASE spec_id % 3 WHEN 0 THEN 'append' ELSE 'overwrite' END "
               "ELSE CASE spec_id % 3 WHEN 0 THEN 'overwrite' ELSE 'append' END END",
    "overwrite_schema": "spec_id % 2 = 0",
    "partitioned": "spec_id % 4 <> 1",
    "vacuum_v2": "spec_id % 5 = 1",
    "blank_as_null": "spec_id % 2 = 0",
    "has_uniqueness": "spec_id % 3 <> 1",
    "obs_type": "CASE spec_id % 2 WHEN 0 THEN 'ms_teams' ELSE 'email' END",
    "receiver0": "'Webhook_' || CAST(spec_id % 4 AS STRING)",
    "has_ops": "spec_id % 3 = 0",
    "escalation_v2": "spec_id % 3 = 2",
    "two_steps": "spec_id % 2 = 0",
    "acl_dropped_v2": "spec_id % 6 = 5",
    "admins": "spec_id % 5 = 0",
    "desc_v1": "'Dataset ds_' || CAST(spec_id AS STRING) || '_' || CAST({j} AS STRING)",
    "desc_changed_v2": "spec_id % 2 = 1",
    "dataexpert": "'team_' || CAST(spec_id % 3 AS STRING)",
}
# column-level templates ({k} = column index)
COL = {
    "name": "'c' || CAST({k} AS STRING)",
    "type": "CASE {k} % 5 WHEN 0 THEN 'smallint' WHEN 1 THEN 'string' WHEN 2 THEN 'date' WHEN 3 THEN 'double' "
            "ELSE 'timestamp' END",
    "pk": "({k} = 0 OR ({k} = 1 AND spec_id % 2 = 0))",
}

# Step names seen in the sample specs and the registered step each maps to.
STEP_REGISTRY = {
    "normalize_date_columns": "to_date_step",
    "remove_duplicates": "drop_duplicates",
    "standardize_columns": "rename_columns",
    "clean_nulls": "drop_null_rows",
    "currency_format": "round_step",
    "aggregate_region": "region_sum",
}


def ds(name: str, j: str = "j") -> str:
    return "(" + DS[name].format(j=j) + ")"


def col(name: str, k: str = "k") -> str:
    return "(" + COL[name].format(k=k) + ")"


def _q(x: str) -> str:
    """JSON string literal of a SQL string expression (values here need no escaping)."""
    return f"'\"' || {x} || '\"'"


def _obj(*pairs: tuple[str, str | None]) -> str:
    """JSON object text from (key, json-text-expr) pairs; a pair whose expr is
    NULL at runtime is absent."""
    parts = ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '\"{k}\":' || ({v}) END" for k, v in pairs)
    return f"('{{' || concat_ws(',', {parts}) || '}}')"


def _arr(items_expr: str) -> str:
    return f"('[' || array_join({items_expr}, ',') || ']')"


def _bool(x: str) -> str:
    return f"CASE WHEN {x} THEN 'true' ELSE 'false' END"


def dataset_json(version: int) -> str:
    """Dataset section (JSON text) as a template over ``j``."""
    j = "j"
    cols = _arr(f"transform(sequence(0, {ds('n_cols')} - 1), k -> " + _obj(
        ("name", _q(col("name"))), ("description", _q("'column ' || " + col("name"))),
        ("type", _q(col("type"))), ("primary_key", f"CASE WHEN {col('pk')} THEN 'true' END")) + ")")
    desc = ds("desc_v1") if version == 1 else (
        f"CASE WHEN {ds('desc_changed_v2')} THEN {ds('desc_v1')} || ' (migrated)' ELSE {ds('desc_v1')} END")
    metadata = _obj(("description", _q(desc)), ("dataexpert", _q(ds("dataexpert"))), ("schema", cols))
    mode = ds("mode_v1") if version == 1 else ds("mode_v2")
    sync = _obj(
        ("mode", _q(mode)), ("overwrite_schema", _bool(ds("overwrite_schema"))),
        ("partition_by", f"CASE WHEN {ds('partitioned')} THEN '[\"c0\"]' ELSE '[]' END"),
        ("vacuum_config", "CAST(NULL AS STRING)" if version == 1 else
         f"CASE WHEN {ds('vacuum_v2')} THEN '{{\"retain_hours\":720}}' END"),
    )
    e0 = _obj(("title", _q("'completeness_' || " + ds("name"))), ("handler", "'\"completeness\"'"),
              ("columns", "'[\"c0\",\"c1\"]'"),
              ("arguments", f"CASE WHEN {ds('blank_as_null')} THEN '{{\"blank_as_null\":true}}' END"))
    e1 = _obj(("title", _q("'uniqueness_' || " + ds("name"))), ("handler", "'\"uniqueness\"'"),
              ("columns", "CASE WHEN spec_id % 2 = 0 THEN '[\"c0\",\"c1\"]' ELSE '[\"c0\"]' END"))
    quality = _obj(("expectations", f"'[' || {e0} || CASE WHEN {ds('has_uniqueness')} THEN ',' || {e1} ELSE '' END || ']'"))
    receivers = (f"'[' || {_q(ds('receiver0'))} || CASE WHEN {ds('has_ops')} THEN ',\"Ops\"' ELSE '' END"
                 + ("" if version == 1 else f" || CASE WHEN {ds('escalation_v2')} THEN ',\"Escalation\"' ELSE '' END")
                 + " || ']'")
    obs = _obj(("type", _q(ds("obs_type"))), ("receivers", receivers))
    s0 = _obj(("name", "'\"normalize_date_columns\"'"), ("type", "'\"python\"'"),
              ("script", _q("'df = df.withColumn(c2, F.to_date(c2, yyyy-MM-dd))'")))
    s1 = _obj(("name", "'\"remove_duplicates\"'"), ("type", "'\"spark\"'"),
              ("statement", _q("'df.dropDuplicates([c0])'")))
    steps = _obj(("steps", f"'[' || {s0} || CASE WHEN {ds('two_steps')} THEN ',' || {s1} ELSE '' END || ']'"))
    group = "'grp-data-' || zone || '-p-' || dom || '-{suffix}'"
    groups = (f"'[' || {_q(group.format(suffix='r'))} || ',' || {_q(group.format(suffix='rw'))}"
              f" || CASE WHEN {ds('admins')} THEN ',\"grp-data-admins\"' ELSE '' END || ']'")
    acl_groups = groups if version == 1 else f"CASE WHEN NOT {ds('acl_dropped_v2')} THEN {groups} END"
    acl = _obj(("access_groups", acl_groups))
    # sections that are no objects, or empty ones
    team = "'team'" if version == 1 else "CASE WHEN spec_id % 6 = 0 THEN 'others' ELSE 'team' END"
    owner = f"CASE WHEN spec_id % 3 = 0 THEN {_q('(' + team + ')')} END"
    tags = "CASE WHEN spec_id % 4 = 1 THEN '[\"a\",\"b\"]' END"
    notes = "CASE WHEN spec_id % 5 = 2 THEN '{}' END" if version == 1 else "CASE WHEN spec_id % 5 = 2 AND spec_id % 2 = 1 THEN '{}' END"
    return _obj(("owner", owner), ("tags", tags), ("notes", notes), ("metadata", metadata), ("sync", sync), ("quality", quality), ("observability", obs),
                ("transformations", steps), ("acl", acl))


def task_json() -> str:
    inc = lambda kind: _q(f"'../dataset/' || {ds('name')} || '/' || {ds('name')} || '_{kind}.yaml'")
    return _obj(
        ("name", _q(ds("name"))), ("connector", "'\"blob\"'"),
        ("target_entity", _q(f"entity || '_' || CAST(j AS STRING)")),
        ("owner_team", "'\"Platform\"'"), ("file_type", _q(ds("file_type"))),
        ("file_path", _q(f"'data/' || zone || '/' || dom || '/' || {ds('name')} || '/'")),
        ("metadata_include", inc("metadata")), ("sync_include", inc("sync")),
        ("quality_include", f"CASE WHEN {ds('has_quality_include')} THEN {inc('quality')} END"),
        ("transformations_include", inc("transformations")),
        ("acl_include", f"CASE WHEN {ds('has_acl_include')} THEN {inc('acl')} END"),
    )


def spec_json(version: int) -> str:
    tasks = (f"array_join(transform(sequence(0, n_ds - 1), j -> {task_json()}), ',') || "
             f"CASE WHEN orphan_task THEN ',' || '{{\"name\":\"orphan_' || CAST(spec_id AS STRING) || "
             f"'\",\"connector\":\"blob\",\"target_entity\":\"orphan\"}}' ELSE '' END")
    schedule = "schedule_v1" if version == 1 else "schedule_v2"
    pipeline = _obj(
        ("scope", "'\"ingestion\"'"), ("domain", _q("dom")), ("schedule", _q(schedule)),
        ("name", _q(SPEC_NAME)), ("zone", _q("zone")), ("country", _q("country")),
        ("tasks", f"'[' || {tasks} || ']'"))
    datasets = f"array_join(transform(sequence(0, n_ds - 1), j -> '\"' || {ds('name')} || '\":' || {dataset_json(version)}), ',')"
    return f"'{{\"pipeline\":' || {pipeline} || ',' || {datasets} || '}}'"


def _spec_rows(t: Tables) -> DataFrame:
    cols = ["p_partkey", "p_name", "p_type", "p_size"]
    # dealt out before anything is rendered: a part is a few dozen bytes and its documents
    # thousands, so a file of parts is one split for far too long
    return t.part.select(*cols).repartition("p_partkey").selectExpr(*[f"{e} AS {n}" for n, e in SPEC_FIXTURE])


def render_specs(t: Tables, version: int) -> DataFrame:
    """specs(spec_id, body) for version 1 or 2."""
    return _spec_rows(t).selectExpr("spec_id", f"{spec_json(version)} AS body")


# ---------------------------------------------------------------------------
# Canonical (normalized schema v4) documents.
# ---------------------------------------------------------------------------

CANON = {
    "has_landing": "spec_id % 3 <> 0",
    "has_env": "spec_id % 4 <> 3",
    "has_schedule": "spec_id % 5 <> 0",
    "has_metadata": "spec_id % 11 <> 0",
    "n_tr": "1 + spec_id % 3",
    "n_dep": "spec_id % 3",
}
TR = {
    "name": "'tr_' || CAST({i} AS STRING)",
    "type": "CASE {i} % 4 WHEN 0 THEN 'filter' WHEN 1 THEN 'aggregation' WHEN 2 THEN 'join' ELSE 'enrichment' END",
    "in0": "CASE WHEN {i} = 0 THEN 'raw_' || CAST(spec_id % 5 AS STRING) ELSE 'mid_' || CAST({i} - 1 AS STRING) END",
    "in1": "CASE WHEN {i} > 0 THEN 'dim_' || CAST(spec_id % 3 AS STRING) END",
    "out0": "'mid_' || CAST({i} AS STRING)",
}
DEP = {
    "type": "CASE WHEN {i} = 0 THEN 'upstream_pipeline' ELSE 'external_system' END",
    "name": "'dep_' || CAST((spec_id + {i}) % 10 AS STRING)",
    "has_details": "(spec_id + {i}) % 2 = 0",
}


def canon(name: str) -> str:
    return "(" + CANON[name] + ")"


def tr(name: str, i: str = "i") -> str:
    return "(" + TR[name].format(i=i) + ")"


def dep(name: str, i: str = "i") -> str:
    return "(" + DEP[name].format(i=i) + ")"


def canonical_json() -> str:
    trs = _arr("transform(sequence(0, " + canon("n_tr") + " - 1), i -> " + _obj(
        ("name", _q(tr("name"))), ("description", _q("'step ' || " + tr("name"))), ("type", _q(tr("type"))),
        ("inputs", f"'[' || {_q(tr('in0'))} || coalesce(',' || {_q(tr('in1'))}, '') || ']'"),
        ("outputs", f"'[' || {_q(tr('out0'))} || ']'")) + ")")
    deps = (f"CASE WHEN {canon('n_dep')} = 0 THEN '[]' ELSE "
            + _arr("transform(sequence(0, " + canon("n_dep") + " - 1), i -> " + _obj(
                ("type", _q(dep("type"))), ("name", _q(dep("name"))),
                ("details", f"CASE WHEN {dep('has_details')} THEN '{{\"sla\":\"daily\"}}' ELSE '{{}}' END")) + ")")
            + " END")
    inputs = "'[' || " + _obj(
        ("source_system", _q("'src_' || CAST(spec_id % 6 AS STRING)")), ("source_entity", _q("entity")),
        ("connection_id", _q("'conn_' || CAST(spec_id % 4 AS STRING)")), ("format", "'\"parquet\"'"),
        ("options", "'{\"header\":\"true\"}'")) + " || ']'"
    outputs = "'[' || " + _obj(
        ("target_entity", _q("entity")), ("table_name", _q(SPEC_NAME)), ("write_mode", "'\"append\"'"),
        ("partition_by", "'[\"c0\"]'"), ("options", "'{}'")) + " || ']'"
    metadata = _obj(("owner", "'\"platform\"'"), ("team", _q("'team_' || CAST(spec_id % 3 AS STRING)")),
                    ("tags", "'[\"t' || CAST(spec_id % 4 AS STRING) || '\"]'"),
                    ("description", _q("'canonical ' || CAST(spec_id AS STRING)")), ("connector", "'\"blob\"'"),
                    ("acl", f"CASE WHEN spec_id % 2 = 0 THEN '\"y\"' ELSE '\"n\"' END"), ("extra", "'{}'"))
    return _obj(
        ("pipeline_name", _q(SPEC_NAME)), ("zone", _q("zone")),
        ("landing_zone", f"CASE WHEN {canon('has_landing')} THEN {_q('zone')} END"),
        ("domain", _q("dom")),
        ("environment_type", f"CASE WHEN {canon('has_env')} THEN {_q('env_prefix')} END"),
        ("schedule", f"CASE WHEN {canon('has_schedule')} THEN {_q('schedule_v1')} END"),
        ("inputs", inputs), ("outputs", outputs), ("transformations", trs), ("dependencies", deps),
        ("metadata", f"CASE WHEN {canon('has_metadata')} THEN {metadata} END"),
    )


def render_canonical(t: Tables) -> DataFrame:
    """canonical(spec_id, body): one normalized-schema-v4 document per part."""
    return _spec_rows(t).selectExpr("spec_id", f"{canonical_json()} AS body")


def spec_fixture_sql() -> str:
    """DuckDB CTE body: the spec fixture over part."""
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SPEC_FIXTURE) + " FROM part"
