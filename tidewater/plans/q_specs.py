"""Dataset-spec queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import specs as sb

from ..functions.exprs import layer_from_name
from ..operators import specs as sp
from ..sources.tables import Tables
from .registry import query


def _v(spark, sf_dir, version=1):
    return sp.parse_specs(sb.render_specs(Tables(spark, sf_dir), version))


def _canon(spark, sf_dir):
    return sb.render_canonical(Tables(spark, sf_dir))


# ------------------------------- oracle SQL --------------------------------
_D = sb.ds
NAME = sb.SPEC_NAME
SPEC_CTES = f"""WITH s AS ({sb.spec_fixture_sql()}),
d0 AS (SELECT s.*, unnest(range(n_ds)) AS j FROM s),
dd AS (SELECT d0.*, {_D('name')} AS dataset FROM d0)
"""


def _rows(*selects: str) -> str:
    return "\nUNION ALL ".join(selects)


_FLAT = _rows(
    f"SELECT spec_id, dataset, 'metadata' AS section, 'description' AS key, 'STRING' AS kind, {_D('desc_v1')} AS value FROM dd",
    f"SELECT spec_id, dataset, 'metadata', 'dataexpert', 'STRING', {_D('dataexpert')} FROM dd",
    "SELECT spec_id, dataset, 'metadata', 'schema', 'ARRAY', NULL FROM dd",
    f"SELECT spec_id, dataset, 'sync', 'mode', 'STRING', {_D('mode_v1')} FROM dd",
    f"SELECT spec_id, dataset, 'sync', 'overwrite_schema', 'BOOLEAN', CASE WHEN {_D('overwrite_schema')} THEN 'true' ELSE 'false' END FROM dd",
    "SELECT spec_id, dataset, 'sync', 'partition_by', 'ARRAY', NULL FROM dd",
    "SELECT spec_id, dataset, 'quality', 'expectations', 'ARRAY', NULL FROM dd",
    f"SELECT spec_id, dataset, 'observability', 'type', 'STRING', {_D('obs_type')} FROM dd",
    "SELECT spec_id, dataset, 'observability', 'receivers', 'ARRAY', NULL FROM dd",
    "SELECT spec_id, dataset, 'transformations', 'steps', 'ARRAY', NULL FROM dd",
    "SELECT spec_id, dataset, 'acl', 'access_groups', 'ARRAY', NULL FROM dd",
    "SELECT spec_id, dataset, 'owner', NULL, 'STRING', 'team' FROM dd WHERE spec_id % 3 = 0",
    "SELECT spec_id, dataset, 'tags', NULL, 'ARRAY', NULL FROM dd WHERE spec_id % 4 = 1",
    "SELECT spec_id, dataset, 'notes', NULL, 'OBJECT', NULL FROM dd WHERE spec_id % 5 = 2",
)


@query("N07", "spec_flatten", SPEC_CTES + _FLAT)
def q_spec_flatten(spark, sf_dir):
    return sp.flatten(_v(spark, sf_dir))


@query("N08", "spec_columns", SPEC_CTES + f"""
SELECT spec_id, dataset, CAST(k AS INTEGER) AS pos, {sb.col('name')} AS name, {sb.col('type')} AS type,
  {sb.col('pk')} AS primary_key
FROM (SELECT dd.*, unnest(range({_D('n_cols')})) AS k FROM dd)""")
def q_spec_columns(spark, sf_dir):
    return sp.columns(_v(spark, sf_dir))


@query("N09", "spec_expectations", SPEC_CTES + _rows(
    f"SELECT spec_id, dataset, 0 AS exp_pos, 'completeness_' || dataset AS title, 'completeness' AS handler, "
    f"c.column_name, CASE WHEN {_D('blank_as_null')} THEN true END AS blank_as_null "
    f"FROM dd, (VALUES ('c0'), ('c1')) c(column_name)",
    f"SELECT spec_id, dataset, 1, 'uniqueness_' || dataset, 'uniqueness', 'c0', NULL FROM dd WHERE {_D('has_uniqueness')}",
    f"SELECT spec_id, dataset, 1, 'uniqueness_' || dataset, 'uniqueness', 'c1', NULL FROM dd "
    f"WHERE {_D('has_uniqueness')} AND spec_id % 2 = 0",
))
def q_spec_expectations(spark, sf_dir):
    e = sp.expectations(_v(spark, sf_dir))
    return e.withColumn("exp_pos", F.col("exp_pos"))


@query("N10", "spec_steps", SPEC_CTES + _rows(
    "SELECT spec_id, dataset, 0 AS step_pos, 'normalize_date_columns' AS name, 'python' AS type, "
    "'df = df.withColumn(c2, F.to_date(c2, yyyy-MM-dd))' AS body, 'to_date_step' AS registered_step FROM dd",
    f"SELECT spec_id, dataset, 1, 'remove_duplicates', 'spark', 'df.dropDuplicates([c0])', 'drop_duplicates' "
    f"FROM dd WHERE {_D('two_steps')}",
))
def q_spec_steps(spark, sf_dir):
    return sp.steps(_v(spark, sf_dir), sb.STEP_REGISTRY)


@query("N13", "alert_routes", SPEC_CTES + _rows(
    f"SELECT spec_id, dataset, {_D('obs_type')} AS channel, {_D('receiver0')} AS receiver FROM dd",
    f"SELECT spec_id, dataset, {_D('obs_type')}, 'Ops' FROM dd WHERE {_D('has_ops')}",
))
def q_alert_routes(spark, sf_dir):
    return sp.alert_routes(_v(spark, sf_dir))


@query("J13", "acl_grants", SPEC_CTES + _rows(
    "SELECT spec_id, dataset, 'grp-data-' || zone || '-p-' || dom || '-r' AS access_group, 'r' AS permission FROM dd",
    "SELECT spec_id, dataset, 'grp-data-' || zone || '-p-' || dom || '-rw', 'rw' FROM dd",
    f"SELECT spec_id, dataset, 'grp-data-admins', NULL FROM dd WHERE {_D('admins')}",
))
def q_acl_grants(spark, sf_dir):
    return sp.acl_grants(_v(spark, sf_dir))


@query("J07", "task_dataset_join", SPEC_CTES + _rows(
    f"SELECT spec_id, dataset AS task_name, entity || '_' || CAST(j AS VARCHAR) AS target_entity, true AS has_dataset, "
    f"CAST(3 + CASE WHEN {_D('has_quality_include')} THEN 1 ELSE 0 END + "
    f"CASE WHEN {_D('has_acl_include')} THEN 1 ELSE 0 END AS INTEGER) AS n_includes FROM dd",
    "SELECT spec_id, 'orphan_' || CAST(spec_id AS VARCHAR), 'orphan', false, 0 FROM s WHERE orphan_task",
))
def q_task_dataset_join(spark, sf_dir):
    return sp.task_dataset_join(_v(spark, sf_dir))


@query("J12", "spec_diff", SPEC_CTES + _rows(
    f"SELECT spec_id, dataset, 'metadata' AS section, 'description' AS key, 'changed' AS change_type FROM dd WHERE {_D('desc_changed_v2')}",
    "SELECT spec_id, dataset, 'sync', 'mode', 'changed' FROM dd WHERE spec_id % 4 = 0",
    f"SELECT spec_id, dataset, 'sync', 'vacuum_config', 'added' FROM dd WHERE {_D('vacuum_v2')}",
    f"SELECT spec_id, dataset, 'observability', 'receivers', 'changed' FROM dd WHERE {_D('escalation_v2')}",
    f"SELECT spec_id, dataset, 'acl', 'access_groups', 'removed' FROM dd WHERE {_D('acl_dropped_v2')}",
    f"SELECT spec_id, dataset, 'acl', NULL, 'added' FROM dd WHERE {_D('acl_dropped_v2')}",  # an empty section is left
    "SELECT spec_id, dataset, 'owner', NULL, 'changed' FROM dd WHERE spec_id % 6 = 0",
    "SELECT spec_id, dataset, 'notes', NULL, 'removed' FROM dd WHERE spec_id % 5 = 2 AND spec_id % 2 = 0",
    "SELECT spec_id, '_pipeline', 'pipeline', 'schedule', 'changed' FROM s WHERE spec_id % 7 = 3",
))
def q_spec_diff(spark, sf_dir):
    return sp.spec_diff(_v(spark, sf_dir, 1), _v(spark, sf_dir, 2))


_ENV = f"CASE WHEN env_prefix IN ('brz', 'slv', 'gld') THEN env_prefix END"


@query("U02", "translator_fanout", SPEC_CTES + f"""
SELECT spec_id, {_ENV} AS environment, tr.translator FROM s, (VALUES {', '.join(f"('{t}')" for t in sp.COMMON_TRANSLATORS)}) tr(translator)
UNION ALL SELECT spec_id, env_prefix, 'PipelineTranslator' FROM s WHERE env_prefix IN ('brz', 'slv', 'gld')
UNION ALL SELECT spec_id, env_prefix, 'TransformationsTranslator' FROM s WHERE env_prefix IN ('brz', 'slv')
UNION ALL SELECT spec_id, env_prefix, 'NotebookTranslator' FROM s WHERE env_prefix = 'gld'""")
def q_translator_fanout(spark, sf_dir):
    return sp.translator_fanout(_v(spark, sf_dir))


@query("F09", "layer_from_name", SPEC_CTES + f"SELECT spec_id, {NAME} AS pipeline_name, {_ENV} AS layer FROM s")
def q_layer_from_name(spark, sf_dir):
    p = _v(spark, sf_dir)
    name = F.try_variant_get(F.col("doc"), "$.pipeline.name", "string")
    return p.select("spec_id", name.alias("pipeline_name"), layer_from_name(name).alias("layer"))


_C = sb.canon


@query("U03", "required_key_gap", SPEC_CTES + _rows(
    f"SELECT spec_id, 'pipeline_name' AS key, true AS present, {NAME} AS value FROM s",
    "SELECT spec_id, 'zone', true, zone FROM s",
    f"SELECT spec_id, 'landing_zone', {_C('has_landing')}, CASE WHEN {_C('has_landing')} THEN zone ELSE 'unknown' END FROM s",
    "SELECT spec_id, 'domain', true, dom FROM s",
    f"SELECT spec_id, 'environment_type', {_C('has_env')}, CASE WHEN {_C('has_env')} THEN env_prefix ELSE 'unknown' END FROM s",
    f"SELECT spec_id, 'schedule', {_C('has_schedule')}, CASE WHEN {_C('has_schedule')} THEN schedule_v1 ELSE 'unknown' END FROM s",
    "SELECT spec_id, 'inputs', true, NULL FROM s",
    "SELECT spec_id, 'outputs', true, NULL FROM s",
    "SELECT spec_id, 'transformations', true, NULL FROM s",
    "SELECT spec_id, 'dependencies', true, NULL FROM s",
    f"SELECT spec_id, 'metadata', {_C('has_metadata')}, NULL FROM s",
))
def q_required_key_gap(spark, sf_dir):
    return sp.required_key_gap(_canon(spark, sf_dir))


_TRS = f"tr AS (SELECT s.spec_id, i, {sb.tr('name')} AS name, {sb.tr('in0')} AS in0, {sb.tr('in1')} AS in1, {sb.tr('out0')} AS out0 FROM (SELECT s.*, unnest(range({_C('n_tr')})) AS i FROM s) s)"


@query("N11", "lineage_edges", SPEC_CTES.rstrip() + ",\n" + _TRS + "\n" + """
SELECT DISTINCT * FROM (
  SELECT spec_id, in0 AS src, name AS dst, 'reads' AS edge_kind FROM tr
  UNION ALL SELECT spec_id, in1, name, 'reads' FROM tr WHERE in1 IS NOT NULL
  UNION ALL SELECT spec_id, name, out0, 'writes' FROM tr)""")
def q_lineage_edges(spark, sf_dir):
    return sp.lineage_edges(_canon(spark, sf_dir))


@query("N12", "dependency_edges", SPEC_CTES + f"""
SELECT spec_id, {NAME} AS pipeline_name, {sb.dep('type')} AS dep_type, {sb.dep('name')} AS dep_name,
  CAST(CASE WHEN {sb.dep('has_details')} THEN 1 ELSE 0 END AS INTEGER) AS n_details
FROM (SELECT s.*, unnest(range({_C('n_dep')})) AS i FROM s)""")
def q_dependency_edges(spark, sf_dir):
    return sp.dependency_edges(_canon(spark, sf_dir))
