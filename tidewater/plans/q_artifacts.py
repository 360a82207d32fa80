"""Artifact queries: repo files, factory parameters, notebook / rule lookups
(SURVEY §2 rows S01-S03, N04, P13, J01-J06, J10, J11, A02, U01, F06, F28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed import artifacts as tb

from ..operators import artifacts as ar
from ..operators import signals as sg
from ..sources.tables import Tables
from . import q_signals as qs
from .registry import query


class ArtifactCtx(qs.SignalCtx):
    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        t = Tables(spark, sf_dir)
        self.factories = tb.render_factories(t)
        self.pipeline_defs = tb.render_pipeline_defs(t)
        self.notebooks = tb.render_notebooks(t)
        self.rules = tb.render_quality_rules(t)
        self.repo_files = tb.render_repo_files(t)
        self.requests = tb.render_file_requests(t)

    @property
    def all_items(self):
        """The items, and a row for each trigger without any."""
        return sg.explode_items(self.header, outer=True)

    @property
    def ok_items(self):
        return self.items.where(F.col("status") == "ok")

    def params(self):
        return ar.repo_params(self.factories)

    def lookups(self):
        return ar.silver_rule_lookup(self.ok_items, self.params(), self.rules)


def ctx(spark, sf_dir) -> ArtifactCtx:
    return ArtifactCtx(spark, sf_dir)


# ------------------------------- oracle CTEs -------------------------------
_F = f"f AS (SELECT {tb.fixture_sql(tb.FACTORY_FIXTURE)} FROM supplier)"
_PICK = """pick AS (SELECT repo, file_name FROM (SELECT repo, file_name, row_number() OVER (PARTITION BY repo
  ORDER BY NOT contains(file_name, 'sap-adf'), file_name) AS rn FROM f WHERE ends_with(file_name, '.json')) WHERE rn = 1)"""
_KV = """kv AS (
  SELECT repo, file_name, 'project_zone' AS key, f_zone AS value, 0 AS side FROM f WHERE f_zone IS NOT NULL
  UNION ALL SELECT repo, file_name, 'project_business_domain', f_domain, 0 FROM f WHERE f_domain IS NOT NULL
  UNION ALL SELECT repo, file_name, 'owner', f_owner, 0 FROM f
  UNION ALL SELECT repo, file_name, 'project_business_domain', f_prod_domain, 1 FROM f WHERE f_prod_nonempty
  UNION ALL SELECT repo, file_name, 'landing_zone', f_prod_landing, 1 FROM f WHERE f_prod_nonempty
  UNION ALL SELECT repo, file_name, 'project_business_domain', f_dev_domain, 1 FROM f WHERE NOT f_prod_nonempty
  UNION ALL SELECT repo, file_name, 'project_zone', f_dev_zone, 1 FROM f WHERE NOT f_prod_nonempty)"""
_FLAT = """flat AS (SELECT repo, file_name, key, arg_max(value, side) AS value,
  CASE WHEN max(side) = 1 THEN 'override' ELSE 'base' END AS winner
  FROM kv WHERE ends_with(file_name, '.json') GROUP BY repo, file_name, key)"""
_RP = """rp AS (SELECT pick.repo, pick.file_name,
  coalesce(max(CASE WHEN key = 'project_zone' THEN value END), 'maz') AS project_zone,
  coalesce(max(CASE WHEN key = 'project_business_domain' THEN value END), 'tech') AS project_business_domain
  FROM pick JOIN flat ON pick.repo = flat.repo AND pick.file_name = flat.file_name GROUP BY pick.repo, pick.file_name)"""
_NBL = f"nbl AS (SELECT {tb.fixture_sql(tb.NOTEBOOK_FIXTURE)} FROM documents)"
_SCR = f"""scr AS (SELECT DISTINCT it.trigger_id, replace(t.repo, '-repo-adf', '-repo-adb') AS repo_adb, p.path
  FROM it JOIN st ON it.trigger_id = st.trigger_id AND st.status = 'ok' JOIN t ON it.trigger_id = t.trigger_id,
  LATERAL (SELECT CASE WHEN it.b_ne THEN {qs.k.clean_nb_path('it.b_nb_path')} END AS path
           UNION ALL SELECT CASE WHEN it.s_ne THEN {qs.k.clean_nb_path('it.s_nb_path')} END) p
  WHERE p.path IS NOT NULL)"""
_RULES = f"rules AS (SELECT {tb.fixture_sql(tb.RULE_FIXTURE)} FROM part)"
_GOV = """gov AS (SELECT it.trigger_id, it.item_pos, it.table_name,
  'src/' || coalesce(rp.project_zone, 'maz') || '/' || coalesce(rp.project_zone, 'maz') || '/' ||
  coalesce(rp.project_business_domain, 'tech') || '/' ||
  CASE WHEN it.s_empty THEN 'unknown' ELSE coalesce(it.s_source_system, 'unknown') END || '/dq_definitions/' ||
  CASE WHEN it.s_empty THEN 'unknown' ELSE it.s_country END || '/' ||
  CASE WHEN it.s_empty OR it.s_db_kind = 0 THEN 'unknown' WHEN it.s_db_kind = 1 THEN 'None'
       ELSE it.s_target_database END || '/' || it.table_name || '.yaml' AS governance_path
  FROM it JOIN st ON it.trigger_id = st.trigger_id AND st.status = 'ok'
  JOIN t ON it.trigger_id = t.trigger_id LEFT JOIN rp ON t.repo = rp.repo
  WHERE it.s_present)"""
_LK = """lk AS (SELECT gov.*, rules.path IS NOT NULL AS rule_found FROM gov LEFT JOIN rules ON gov.governance_path = rules.path)"""
_PG = f"pg AS (SELECT {tb.fixture_sql(tb.PAGE_FIXTURE)} FROM pages)"
_FILES = """files AS (SELECT repo, ref, path, bad, CASE ref WHEN 'dev' THEN 'dev ' || html ELSE html END AS html FROM (
  SELECT repo, path, arg_min(bad_payload, page_id) AS bad, arg_min(html, page_id) AS html, min(page_id) AS id
  FROM pg GROUP BY repo, path), (VALUES ('main'), ('dev')) r(ref) WHERE ref = 'main' OR id % 4 = 0)"""
_DIRS = """dirs AS (SELECT DISTINCT repo, ref, array_to_string(string_split(path, '/')[1:k], '/') AS path
  FROM files, range(1, len(string_split(path, '/'))) r(k)
  EXCEPT SELECT repo, ref, path FROM files)"""
_REQ = """req AS (SELECT DISTINCT repo, ref, path FROM (
  SELECT repo, 'main' AS ref, path FROM pg UNION ALL SELECT repo, 'dev', path FROM pg WHERE page_id % 2 = 0
  UNION ALL SELECT repo, 'main', regexp_extract(path, '^(.*)/[^/]*$', 1) FROM pg
  UNION ALL SELECT repo, 'main', path || '.bak' FROM pg WHERE page_id % 9 = 0) WHERE path <> '')"""


def _w(*extra: str, base: str = "st") -> str:
    head = qs.with_(base)
    return head.rstrip("\n") + (",\n" + ",\n".join(extra) if extra else "") + "\n"


_PARAMS = (_F, _PICK, _KV, _FLAT, _RP)

# --------------------------------- queries ---------------------------------


@query("S01", "file_content_decode", "WITH " + ",\n".join([_PG, _FILES, _DIRS, _REQ]) + """
SELECT req.repo, req.ref, req.path,
  CASE WHEN files.path IS NOT NULL THEN CASE WHEN files.bad THEN 'bad_payload' ELSE 'ok' END
       WHEN dirs.path IS NOT NULL THEN 'directory' ELSE 'not_found' END AS outcome,
  CASE WHEN files.path IS NOT NULL AND NOT files.bad THEN md5(files.html) END AS text_md5
FROM req LEFT JOIN files ON req.repo = files.repo AND req.ref = files.ref AND req.path = files.path
LEFT JOIN dirs ON req.repo = dirs.repo AND req.ref = dirs.ref AND req.path = dirs.path""")
def q_file_content_decode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = ar.decode_files(tb.render_repo_files(t), tb.render_file_requests(t))
    return d.select("repo", "ref", "path", "outcome", F.md5("text").alias("text_md5"))


@query("S02", "dir_listing", "WITH " + ",\n".join([_PG, _FILES, _DIRS]) + """
SELECT repo, ref, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_split(path, '/')[-1] AS name, path, type
FROM (SELECT repo, ref, path, 'file' AS type FROM files UNION ALL SELECT repo, ref, path, 'dir' FROM dirs)""")
def q_dir_listing(spark, sf_dir):
    return ar.list_directory(tb.render_repo_files(Tables(spark, sf_dir)))


@query("S03", "factory_file_pick", "WITH " + ",\n".join([_F, _PICK]) + "\nSELECT repo, file_name FROM pick")
def q_factory_file_pick(spark, sf_dir):
    return ar.pick_factory_file(tb.render_factories(Tables(spark, sf_dir))).select("repo", "file_name")


@query("N04", "params_flatten", "WITH " + ",\n".join([_F, _KV, _FLAT]) + "\nSELECT repo, file_name, key, value FROM flat")
def q_params_flatten(spark, sf_dir):
    fac = tb.render_factories(Tables(spark, sf_dir)).where(F.col("name").endswith(".json"))
    flat = ar.flatten_params(fac)
    return flat.select("repo", F.col("name").alias("file_name"),
                       F.explode(ar.overlay_config(F.col("base"), F.col("overlay"))).alias("key", "value"))


@query("P13", "config_overlay", "WITH " + ",\n".join([_F, _KV, _FLAT]) + "\nSELECT repo, file_name, key, value, winner FROM flat")
def q_config_overlay(spark, sf_dir):
    fac = tb.render_factories(Tables(spark, sf_dir)).where(F.col("name").endswith(".json"))
    flat = ar.flatten_params(fac)
    ex = flat.select("repo", F.col("name").alias("file_name"), "overlay",
                     F.explode(ar.overlay_config(F.col("base"), F.col("overlay"))).alias("key", "value"))
    return ex.select("repo", "file_name", "key", "value",
                     F.when(F.coalesce(F.map_contains_key("overlay", F.col("key")), F.lit(False)), F.lit("override"))
                     .otherwise(F.lit("base")).alias("winner"))


@query("J05", "trigger_params_join", _w(*_PARAMS) + """
SELECT t.trigger_id, rp.file_name AS factory_file, coalesce(rp.project_zone, 'maz') AS project_zone,
  coalesce(rp.project_business_domain, 'tech') AS project_business_domain
FROM t JOIN st ON t.trigger_id = st.trigger_id AND st.status = 'ok' LEFT JOIN rp ON t.repo = rp.repo""")
def q_trigger_params_join(spark, sf_dir):
    from ..functions.exprs import key_or_default
    c = ctx(spark, sf_dir)
    ok = c.header.where(F.col("status") == "ok").select("trigger_id", "repo")
    j = ok.join(c.params(), "repo", "left")
    return j.select("trigger_id", F.col("file_name").alias("factory_file"),
                    key_or_default("params", "project_zone", ar.DEFAULT_PROJECT_ZONE).alias("project_zone"),
                    key_or_default("params", "project_business_domain", ar.DEFAULT_PROJECT_DOMAIN)
                    .alias("project_business_domain"))


@query("J06", "repo_pair_join", "WITH " + ",\n".join([qs.T_CTE, _NBL]) + """
SELECT t.trigger_id, t.repo AS repo_adf, replace(t.repo, '-repo-adf', '-repo-adb') AS repo_adb,
  EXISTS (SELECT 1 FROM nbl WHERE nbl.repo = replace(t.repo, '-repo-adf', '-repo-adb')) AS code_repo_exists
FROM t""")
def q_repo_pair_join(spark, sf_dir):
    c = ctx(spark, sf_dir)
    repos = c.notebooks.select(F.col("repo").alias("repo_adb")).distinct().withColumn("code_repo_exists", F.lit(True))
    t = c.triggers.select("trigger_id", F.col("repo").alias("repo_adf"), ar.code_repo(F.col("repo")).alias("repo_adb"))
    return t.join(repos, "repo_adb", "left").select(
        "trigger_id", "repo_adf", "repo_adb", F.coalesce("code_repo_exists", F.lit(False)).alias("code_repo_exists"))


@query("J01", "item_notebook_join", _w(_NBL, _SCR) + """
SELECT k.repo_adb, k.path, nbl.content IS NOT NULL AS found,
  md5(coalesce(nbl.content, '# ERROR: file not found: ' || k.path)) AS content_md5
FROM (SELECT DISTINCT repo_adb, path FROM scr) k LEFT JOIN nbl ON k.repo_adb = nbl.repo AND k.path = nbl.path""")
def q_item_notebook_join(spark, sf_dir):
    c = ctx(spark, sf_dir)
    j = ar.attach_notebooks(ar.item_scripts(c.ok_items, "repo_adb", "path"), c.notebooks, F.md5)
    return j.select("repo_adb", "path", "found", F.col("content").alias("content_md5"))


@query("J10", "missing_scripts_anti", _w(_NBL, _SCR) + """
SELECT DISTINCT repo_adb, path FROM scr WHERE NOT EXISTS (SELECT 1 FROM nbl WHERE nbl.repo = scr.repo_adb AND nbl.path = scr.path)""")
def q_missing_scripts(spark, sf_dir):
    c = ctx(spark, sf_dir)
    keys = ar.item_scripts(c.ok_items, "repo_adb", "path")
    nb = c.notebooks.select(F.col("repo").alias("repo_adb"), "path")
    return keys.join(nb, ["repo_adb", "path"], "left_anti")


_NO_RULE = "SELECT trigger_id, table_name FROM lk GROUP BY trigger_id, table_name HAVING count(*) FILTER (WHERE rule_found) = 0"


@query("J10", "tables_without_rule", _w(*_PARAMS, _GOV, _RULES, _LK) + _NO_RULE)
def q_tables_without_rule(spark, sf_dir):
    return ar.tables_without_rule(ctx(spark, sf_dir).lookups())


@query("J11", "covered_scripts_semi", _w(_NBL, _SCR) + """
SELECT DISTINCT repo_adb, path FROM scr WHERE EXISTS (SELECT 1 FROM nbl WHERE nbl.repo = scr.repo_adb AND nbl.path = scr.path)""")
def q_covered_scripts(spark, sf_dir):
    c = ctx(spark, sf_dir)
    keys = ar.item_scripts(c.ok_items, "repo_adb", "path")
    nb = c.notebooks.select(F.col("repo").alias("repo_adb"), "path")
    return keys.join(nb, ["repo_adb", "path"], "left_semi")


@query("A02", "unique_scripts", _w(_SCR) + """
SELECT st.trigger_id, CAST(count(DISTINCT scr.path) AS BIGINT) AS n_scripts
FROM st LEFT JOIN scr ON st.trigger_id = scr.trigger_id WHERE st.status = 'ok' GROUP BY st.trigger_id""")
def q_unique_scripts(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return ar.script_counts(c.all_items.where(F.col("status") == "ok"))


@query("U01", "layer_paths_union", _w(_SCR) + "SELECT DISTINCT trigger_id, path FROM scr")
def q_layer_paths_union(spark, sf_dir):
    return ar.item_scripts(ctx(spark, sf_dir).ok_items).select("trigger_id", "path").distinct()


@query("F06", "governance_path", _w(*_PARAMS, _GOV) + "SELECT trigger_id, item_pos, governance_path FROM gov")
def q_governance_path(spark, sf_dir):
    return ctx(spark, sf_dir).lookups().select("trigger_id", "item_pos", "governance_path")


@query("J02", "item_quality_rule_join", _w(*_PARAMS, _GOV, _RULES, _LK) + """
SELECT trigger_id, item_pos, table_name, governance_path, rule_found FROM lk""")
def q_item_quality_rule_join(spark, sf_dir):
    return ctx(spark, sf_dir).lookups().select("trigger_id", "item_pos", "table_name", "governance_path", "rule_found")


@query("J03", "governance_backfill", _w(*_PARAMS, _GOV, _RULES, _LK) + """
SELECT it.trigger_id, it.item_pos, it.table_name, g.governance_path
FROM it JOIN st ON it.trigger_id = st.trigger_id AND st.status = 'ok'
LEFT JOIN (SELECT trigger_id, table_name, arg_max(governance_path, item_pos) AS governance_path
           FROM lk WHERE rule_found GROUP BY trigger_id, table_name) g
  ON it.trigger_id = g.trigger_id AND it.table_name = g.table_name""")
def q_governance_backfill(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return ar.governance_backfill(c.ok_items, c.lookups()).select(
        "trigger_id", "item_pos", "table_name", "governance_path")


_PDEF = f"pdef AS (SELECT {tb.fixture_sql(tb.PIPELINE_DEF_FIXTURE)} FROM customer)"


@query("J04", "trigger_pipeline_join", "WITH " + ",\n".join([qs.T_CTE, _PDEF]) + """
SELECT t.trigger_id, CASE WHEN NOT t.t_no_pipelines THEN t.p_ref END AS pipeline_ref,
  CASE WHEN t.t_no_pipelines OR t.p_ref IS NULL THEN 'no_reference'
       WHEN pdef.name IS NOT NULL THEN 'joined' ELSE 'missing_definition' END AS outcome,
  CASE WHEN NOT t.t_no_pipelines AND pdef.name IS NOT NULL THEN 'run_' || CAST(pdef.def_key AS VARCHAR) END AS first_activity
FROM t LEFT JOIN pdef ON t.repo = pdef.repo AND t.p_ref = pdef.name WHERE NOT t.t_malformed""")
def q_trigger_pipeline_join(spark, sf_dir):
    c = ctx(spark, sf_dir)
    h = c.header.where("parse_ok").select("trigger_id", "repo", "pipeline_ref")
    d = c.pipeline_defs.select("repo", F.col("name").alias("pipeline_ref"), F.lit(True).alias("hit"),
                               F.try_variant_get(F.try_parse_json("body"), "$.properties.activities[0].name",
                                                 "string").alias("first_activity"))
    j = h.join(d, ["repo", "pipeline_ref"], "left")
    outcome = (F.when(F.col("pipeline_ref").isNull(), F.lit("no_reference"))
               .when(F.col("hit"), F.lit("joined")).otherwise(F.lit("missing_definition")))
    return j.select("trigger_id", "pipeline_ref", outcome.alias("outcome"), "first_activity")


@query("F28", "code_flags", "WITH " + _NBL + """
SELECT repo, CAST(count(*) AS BIGINT) AS n_notebooks,
  CAST(count(*) FILTER (WHERE contains(content, 'opflag')) AS BIGINT) AS n_opflag,
  CAST(count(*) FILTER (WHERE contains(content, 'write_stream_delta_table')) AS BIGINT) AS n_stream_write,
  CAST(sum(length(content)) AS BIGINT) AS total_length, CAST(max(length(content)) AS BIGINT) AS max_length
FROM nbl GROUP BY repo""")
def q_code_flags(spark, sf_dir):
    return ar.code_flags(tb.render_notebooks(Tables(spark, sf_dir)))
