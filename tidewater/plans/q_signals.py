"""Trigger corpus queries: parse, explode, signals (SURVEY §2 rows N01-N06, P01,
P05-P07, P14, A01, A03, W04, F01-F03, F05, F07, F08, F26, F27, X02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testbed import artifacts as tb

from ..functions.documents import with_document
from ..operators import manifest as mf
from ..operators import signals as sg
from ..session import scratch_path
from ..sources.tables import Tables
from . import sqlkit as k
from .registry import query

# ---------------------------------------------------------------------------
# Spark side: the shared chain, built lazily per (session, sf_dir)
# ---------------------------------------------------------------------------


class SignalCtx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        t = Tables(spark, sf_dir)
        self.triggers = tb.render_triggers(t)
        self.manifests = tb.render_manifests(t)
        self.metadata = tb.render_metadata(t)
        self.parsed = sg.parse_triggers(self.triggers)
        self._use(sg.trigger_header(self.parsed))

    def landed(self) -> SignalCtx:
        """For rows that use the triggers several times: the parsed headers, written once and
        read back (each document is rendered and parsed once)."""
        spark = self.header.sparkSession
        path = scratch_path(spark, "trigger-headers")
        self.header.write.parquet(path)
        self._use(spark.read.schema(self.header.schema).parquet(path))
        return self

    def _use(self, header: DataFrame) -> None:
        self.header = header
        self.items = sg.explode_items(header)
        self.status = sg.trigger_status(header)

    def pipeline(self) -> DataFrame:
        return sg.pipeline_signal(self.header)

    def tables(self) -> DataFrame:
        return sg.table_signal(self.items, self.manifests, self.metadata)


def ctx(spark: SparkSession, sf_dir: str) -> SignalCtx:
    return SignalCtx(spark, sf_dir)


# ---------------------------------------------------------------------------
# Oracle side: the same fixture, expected values computed relationally
# ---------------------------------------------------------------------------

T_CTE = f"t AS (SELECT {tb.fixture_sql(tb.TRIGGER_FIXTURE)} FROM {tb.TRIGGER_FROM})"
LI_CTE = (f"li AS (SELECT {tb.fixture_sql(tb.ITEM_FIXTURE)}, CAST(row_number() OVER "
          f"(PARTITION BY l_orderkey ORDER BY {tb.ITEM_ORDER}) - 1 AS INTEGER) AS item_pos FROM lineitem)")
IT_CTE = """it AS (SELECT li.*, li.b_present AND NOT li.b_empty AS b_ne, li.s_present AND NOT li.s_empty AS s_ne,
  CASE WHEN li.s_present AND NOT li.s_empty THEN li.s_target_table
       WHEN li.b_present AND NOT li.b_empty THEN li.b_target_table ELSE 'unknown' END AS table_name
  FROM li JOIN t ON li.trigger_id = t.trigger_id WHERE NOT t.t_malformed AND NOT t.t_no_pipelines)"""
ST_CTE = """st AS (SELECT t.trigger_id,
  CASE WHEN t.t_malformed THEN 'malformed_trigger' WHEN t.t_no_pipelines THEN 'no_pipelines'
       WHEN coalesce(x.bad, 0) > 0 THEN 'bad_item' ELSE 'ok' END AS status,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_items
  FROM t LEFT JOIN (SELECT trigger_id, count(*) AS n, count(*) FILTER (WHERE table_name IS NULL) AS bad
                    FROM it GROUP BY trigger_id) x ON t.trigger_id = x.trigger_id)"""
_MIN0 = "CASE WHEN s_min_kind IN ('list', 'int') THEN s_min END"
_HOUR0 = "CASE WHEN s_hour_kind = 'list' THEN s_hour END"
_NEED = f"(({_MIN0}) IS NULL OR ({_HOUR0}) IS NULL)"
_HOURS = f"CASE WHEN {_NEED} AND s_start_kind IN (0, 1) AND ({_HOUR0}) IS NULL THEN s_start_hh ELSE {_HOUR0} END"
_MINUTES = f"CASE WHEN {_NEED} AND (s_start_kind = 0 OR s_start_kind = 1 AND s_start_utc) AND ({_MIN0}) IS NULL THEN s_start_mm ELSE {_MIN0} END"
_SCHED_JSON = ("CASE WHEN s_min_kind = 'none' AND s_hour_kind = 'none' THEN NULL ELSE '{' || concat_ws(',', "
               "CASE WHEN s_hour_kind <> 'none' THEN '\"hours\":' || CASE s_hour_kind WHEN 'list' THEN "
               "'[' || CAST(s_hour AS VARCHAR) || ']' ELSE '[]' END END, "
               "CASE WHEN s_min_kind <> 'none' THEN '\"minutes\":' || CASE s_min_kind WHEN 'list' THEN "
               "'[' || CAST(s_min AS VARCHAR) || ']' WHEN 'int' THEN CAST(s_min AS VARCHAR) "
               "ELSE '\"' || CAST(s_min AS VARCHAR) || '\"' END END) || '}' END")
SCH_CTE = f"""sch AS (SELECT trigger_id,
  coalesce(t_prop_type = 'ScheduleTrigger', false) OR coalesce(t_top_type = 'ScheduleTrigger', false) AS is_sched,
  CASE WHEN ({_MINUTES}) IS NOT NULL OR ({_HOURS}) IS NOT NULL THEN
    coalesce(CAST(({_MINUTES}) AS VARCHAR), '*') || ' ' || coalesce(CAST(({_HOURS}) AS VARCHAR), '*') || ' * * *' END AS cron,
  '{{"frequency":"Day","interval":1,' || coalesce('"schedule":' || ({_SCHED_JSON}) || ',', '') ||
    '"startTime":"' || s_start || '"}}' AS raw_rec
  FROM t WHERE NOT t_malformed)"""
FI_CTE = """fi AS (SELECT trigger_id,
  CASE WHEN s_ne THEN 'slv' WHEN b_ne THEN 'brz' END AS first_layer,
  CASE WHEN s_ne THEN s_target_zone WHEN b_ne THEN b_target_zone END AS fc_zone,
  CASE WHEN s_ne THEN s_domain WHEN b_ne THEN b_domain END AS fc_domain,
  CASE WHEN s_ne THEN s_source_system WHEN b_ne THEN b_source_system END AS fc_ss,
  CASE WHEN s_ne THEN s_source_system_raw WHEN b_ne THEN b_source_system_raw END AS fc_ssraw
  FROM it WHERE item_pos = 0)"""
CNT_CTE = """cnt AS (SELECT trigger_id, CAST(count(*) FILTER (WHERE b_ne) AS BIGINT) AS bronze_count,
  CAST(count(*) FILTER (WHERE s_ne) AS BIGINT) AS silver_count FROM it GROUP BY trigger_id)"""

_ORDER = ["t", "li", "it", "st", "sch", "fi", "cnt", "pl", "ts"]

PL_CTE = f"""pl AS (SELECT t.trigger_id,
  {k.first_truthy('fi.fc_zone', 't.p_source_system_zone', default="'maz'")} AS zone,
  {k.first_truthy('fi.fc_zone', 't.p_target_zone', default="'maz'")} AS landing_zone,
  {k.map_domain(k.first_truthy('fi.fc_domain', 't.p_domain', default="'unknown_domain'"))} AS domain,
  {k.first_truthy('t.t_name', default="'unknown_pipeline'")} AS pipeline,
  CASE WHEN sch.is_sched THEN coalesce(sch.cron, sch.raw_rec) END AS schedule,
  'platform' AS owner, 'blob' AS connector,
  {k.first_truthy('fi.fc_ss', 'fi.fc_ssraw', 't.p_source_system', 't.p_source_system_raw',
                  default="'unknown_source_system'")} AS source_system,
  'remove_later' AS source_entity,
  coalesce(cnt.bronze_count, 0) AS bronze_count, coalesce(cnt.silver_count, 0) AS silver_count
  FROM t JOIN st ON t.trigger_id = st.trigger_id AND st.status = 'ok'
  JOIN sch ON t.trigger_id = sch.trigger_id
  LEFT JOIN fi ON t.trigger_id = fi.trigger_id LEFT JOIN cnt ON t.trigger_id = cnt.trigger_id)"""

_CFG = lambda f_b, f_s: f"CASE WHEN it.b_ne THEN {f_b} ELSE {f_s} END"
_ZONE_L = k.first_truthy(_CFG("it.b_target_zone", "it.s_target_zone"), "pl.zone")
_DOM_L = k.map_domain(k.first_truthy(_CFG("it.b_domain", "it.s_domain"), "pl.domain"))
_SS_L = k.first_truthy(_CFG("it.b_source_system", "it.s_source_system"),
                       _CFG("it.b_source_system_raw", "it.s_source_system_raw"), default="'unknown_source_system'")
_CTRY_L = k.first_truthy(_CFG("it.b_country", "it.s_country"), _CFG("it.b_raw_zone", "NULL"),
                         default="'unknown_country'")
_TE = k.first_truthy(_CFG("it.b_target_table", "it.s_target_table"), default="'unknown_target_table'")
_SLV_NAME = k.first_truthy(_CFG("it.b_target_table", "it.s_target_table"),
                           _CFG("it.b_source_table", "it.s_source_table"), _TE)
TS_CTE = f"""ts AS (SELECT trigger_id, target_entity, CAST(min(item_pos) OVER w AS INTEGER) AS first_pos,
    CAST(max(item_pos) OVER w AS INTEGER) AS last_pos, CAST(count(*) OVER w AS BIGINT) AS n_items,
    target_layer, domain, table_name, transformations,
    row_number() OVER (PARTITION BY trigger_id, target_entity ORDER BY item_pos DESC) AS rn
  FROM (SELECT it.trigger_id, it.item_pos, {_TE} AS target_entity,
          CASE WHEN it.b_ne THEN 'brz' ELSE 'slv' END AS target_layer,
          {_DOM_L} AS domain,
          CASE WHEN it.b_ne THEN 'brz_' || {_ZONE_L} || '_' || {_DOM_L} || '_' || {_SS_L} || '_' || {_CTRY_L}
               ELSE {_SLV_NAME} END AS table_name,
          CASE WHEN it.s_ne THEN 'y' ELSE 'n' END AS transformations
        FROM it JOIN pl ON it.trigger_id = pl.trigger_id WHERE it.b_ne OR it.s_ne) x
  WINDOW w AS (PARTITION BY trigger_id, target_entity))"""

_CTES = {"t": T_CTE, "li": LI_CTE, "it": IT_CTE, "st": ST_CTE, "sch": SCH_CTE, "fi": FI_CTE,
         "cnt": CNT_CTE, "pl": PL_CTE, "ts": TS_CTE}


def with_(*names: str) -> str:
    """WITH clause holding the named CTEs (and, implicitly, everything before them), each
    computed once: they refer to each other often."""
    last = max(_ORDER.index(n) for n in names)
    return "WITH " + ",\n".join(_CTES[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in _ORDER[: last + 1]) + "\n"


_NO_DOC = "t.m_case IN ('empty', 'broken')"
_CONN = (f"CASE WHEN NOT {_NO_DOC} AND t.m_connection_id IS NOT NULL AND t.m_connection_id <> '' "
         f"THEN {k.strip('t.m_connection_id')} ELSE 'sap-test-secret' END")
_ACL = "CASE WHEN t.md_kind IN (3, 4, 5) THEN 'y' ELSE 'n' END"

# ---------------------------------------------------------------------------
# Registered queries
# ---------------------------------------------------------------------------


@query("N01", "trigger_parse", with_("t") + """
SELECT trigger_id, NOT t_malformed AS parse_ok,
  CASE WHEN NOT t_malformed THEN t_name END AS name,
  CASE WHEN NOT t_malformed THEN t_prop_type END AS prop_type,
  CASE WHEN NOT t_malformed THEN t_top_type END AS top_type
FROM t""")
def q_trigger_parse(spark, sf_dir):
    h = ctx(spark, sf_dir).header
    return h.select("trigger_id", "parse_ok", "name", "prop_type", "top_type")


@query("N02", "items_explode", with_("it") + f"""
SELECT trigger_id, item_pos, table_name, b_present AS bronze_present, b_ne AS bronze_nonempty,
  s_present AS silver_present, s_ne AS silver_nonempty,
  CASE WHEN b_ne THEN {k.clean_nb_path('b_nb_path')} END AS notebook_path_brz,
  CASE WHEN s_ne THEN {k.clean_nb_path('s_nb_path')} END AS notebook_path_slv,
  CASE WHEN s_ne THEN s_source_system WHEN b_ne THEN b_source_system END AS source_system
FROM it""")
def q_items_explode(spark, sf_dir):
    return ctx(spark, sf_dir).items.select(
        "trigger_id", "item_pos", "table_name", "bronze_present", "bronze_nonempty", "silver_present",
        "silver_nonempty", "notebook_path_brz", "notebook_path_slv", "source_system")


@query("N03", "trigger_parameters", with_("t") + """
SELECT trigger_id, p_ref AS pipeline_ref, p_source_system_zone, p_target_zone, p_domain,
  p_source_system, p_source_system_raw
FROM t WHERE NOT t_malformed AND NOT t_no_pipelines""")
def q_trigger_parameters(spark, sf_dir):
    h = ctx(spark, sf_dir).header
    return h.where("parse_ok AND has_pipeline").select(
        "trigger_id", "pipeline_ref", "p_source_system_zone", "p_target_zone", "p_domain",
        "p_source_system", "p_source_system_raw")


@query("N05", "table_signal", with_("ts") + f"""
SELECT ts.trigger_id, ts.target_entity, ts.first_pos, ts.last_pos, ts.n_items, ts.target_layer, ts.domain,
  ts.table_name, 'platform' AS owner, 'blob' AS connector, {_CONN} AS connection_id,
  ts.transformations, {_ACL} AS acl
FROM ts JOIN t ON ts.trigger_id = t.trigger_id WHERE ts.rn = 1""")
def q_table_signal(spark, sf_dir):
    return ctx(spark, sf_dir).tables()


@query("N06", "pipeline_signal", with_("pl") + "SELECT * FROM pl")
def q_pipeline_signal(spark, sf_dir):
    return ctx(spark, sf_dir).pipeline()


@query("P05", "skip_unconfigured_items", with_("it") + """
SELECT trigger_id, item_pos, CASE WHEN b_ne THEN 'brz' ELSE 'slv' END AS primary_layer
FROM it WHERE b_ne OR s_ne""")
def q_skip_unconfigured(spark, sf_dir):
    it = ctx(spark, sf_dir).items
    return it.where("bronze_nonempty OR silver_nonempty").select(
        "trigger_id", "item_pos",
        F.when(F.col("bronze_nonempty"), F.lit("brz")).otherwise(F.lit("slv")).alias("primary_layer"))


@query("P06", "schedule_trigger_filter", with_("t") + """
SELECT trigger_id, CASE WHEN t_prop_type = 'ScheduleTrigger' THEN 'properties' ELSE 'top_level' END AS declared_in
FROM t WHERE NOT t_malformed AND (t_prop_type = 'ScheduleTrigger' OR coalesce(t_top_type = 'ScheduleTrigger', false))""")
def q_schedule_filter(spark, sf_dir):
    h = ctx(spark, sf_dir).header
    return h.where(F.col("parse_ok") & sg.is_schedule_trigger(F.col("prop_type"), F.col("top_type"))).select(
        "trigger_id",
        F.when(F.col("prop_type") == sg.SCHEDULE_TRIGGER, F.lit("properties"))
        .otherwise(F.lit("top_level")).alias("declared_in"))


@query("A01", "layer_counts", with_("cnt") + """
SELECT t.trigger_id, coalesce(cnt.bronze_count, 0) AS bronze_count, coalesce(cnt.silver_count, 0) AS silver_count
FROM t LEFT JOIN cnt ON t.trigger_id = cnt.trigger_id WHERE NOT t.t_malformed AND NOT t.t_no_pipelines""")
def q_layer_counts(spark, sf_dir):
    return sg.layer_counts(ctx(spark, sf_dir).header)


@query("A03", "table_last_wins", with_("ts") + """
SELECT trigger_id, target_entity, first_pos, last_pos, n_items FROM ts WHERE rn = 1""")
def q_table_last_wins(spark, sf_dir):
    return ctx(spark, sf_dir).tables().select("trigger_id", "target_entity", "first_pos", "last_pos", "n_items")


@query("W04", "first_config", with_("fi") + """
SELECT trigger_id, first_layer, fc_zone AS first_target_zone, fc_domain AS first_domain,
  fc_ss AS first_source_system FROM fi""")
def q_first_config(spark, sf_dir):
    f = sg.first_config(ctx(spark, sf_dir).header)
    return f.select("trigger_id", "first_layer", F.col("first_cfg")["target_zone"].alias("first_target_zone"),
                    F.col("first_cfg")["target_business_domain"].alias("first_domain"),
                    F.col("first_cfg")["source_system"].alias("first_source_system"))


@query("F01", "clean_notebook_path", with_("it") + f"""
SELECT trigger_id, item_pos, 'brz' AS layer, b_nb_path AS raw_path, {k.clean_nb_path('b_nb_path')} AS clean_path
FROM it WHERE b_ne
UNION ALL
SELECT trigger_id, item_pos, 'slv', s_nb_path, {k.clean_nb_path('s_nb_path')} FROM it WHERE s_ne""")
def q_clean_notebook_path(spark, sf_dir):
    from ..functions.exprs import clean_notebook_path
    it = ctx(spark, sf_dir).items
    layers = F.array(*[F.when(F.col(f"{name}_nonempty"), F.struct(F.lit(layer).alias("layer"), F.col(layer)["adb_notebook_path"].alias("raw_path")))
                       for name, layer in (("bronze", "brz"), ("silver", "slv"))])
    rows = it.select("trigger_id", "item_pos", F.inline(F.array_compact(layers)))
    return rows.withColumn("clean_path", clean_notebook_path("raw_path"))


@query("F02", "map_domain", with_("t") + f"""
SELECT trigger_id, p_domain AS domain_raw, {k.map_domain('p_domain')} AS domain_mapped
FROM t WHERE NOT t_malformed AND NOT t_no_pipelines""")
def q_map_domain(spark, sf_dir):
    from ..functions.exprs import map_domain
    h = ctx(spark, sf_dir).header
    return h.where("parse_ok AND has_pipeline").select(
        "trigger_id", F.col("p_domain").alias("domain_raw"), map_domain("p_domain").alias("domain_mapped"))


@query("F03", "derive_cron", with_("sch") + """
SELECT trigger_id, cron, coalesce(cron, raw_rec) AS schedule FROM sch WHERE is_sched""")
def q_derive_cron(spark, sf_dir):
    h = ctx(spark, sf_dir).header
    h = h.where(F.col("parse_ok") & sg.is_schedule_trigger(F.col("prop_type"), F.col("top_type")))
    return sg.with_cron(h).select("trigger_id", "cron", "schedule")


@query("F05", "bronze_table_name", with_("ts") + """
SELECT trigger_id, target_entity, table_name FROM ts WHERE rn = 1 AND target_layer = 'brz'""")
def q_bronze_table_name(spark, sf_dir):
    return ctx(spark, sf_dir).tables().where("target_layer = 'brz'").select(
        "trigger_id", "target_entity", "table_name")


@query("F07", "item_table_name", with_("it") + "SELECT trigger_id, item_pos, table_name FROM it")
def q_item_table_name(spark, sf_dir):
    return ctx(spark, sf_dir).items.select("trigger_id", "item_pos", "table_name")


@query("F08", "item_source_system", with_("it") + """
SELECT trigger_id, item_pos, CASE WHEN s_ne THEN s_source_system WHEN b_ne THEN b_source_system END AS source_system
FROM it""")
def q_item_source_system(spark, sf_dir):
    return ctx(spark, sf_dir).items.select("trigger_id", "item_pos", "source_system")


@query("F26", "connection_id_pick", with_("t") + f"SELECT t.trigger_id, {_CONN} AS connection_id FROM t")
def q_connection_id(spark, sf_dir):
    m = ctx(spark, sf_dir).manifests
    return with_document(m, "body").select("trigger_id", sg.connection_id(F.col("doc")).alias("connection_id"))


@query("F27", "acl_flag", with_("t") + f"SELECT t.trigger_id, {_ACL} AS acl FROM t")
def q_acl_flag(spark, sf_dir):
    md = ctx(spark, sf_dir).metadata
    return with_document(md, "body").select("trigger_id", sg.acl_flag(F.col("doc")).alias("acl"))


_REJECT = f"(t.t_name = '' OR t.m_case = 'no_repo' OR {_NO_DOC})"
_PLAT = f"CASE WHEN {_NO_DOC} THEN 'platform_3_0' ELSE coalesce(m_platform, 'platform_3_0') END"
_SQL_STATUS = f"""CASE WHEN {_REJECT} THEN 'invalid_input'
  WHEN t.m_platform IS NOT NULL AND t.m_platform <> 'platform_3_0' THEN 'unsupported_platform'
  ELSE st.status END"""


@query("X02", "extract_normalize_job", with_("st") + f"""
SELECT t.trigger_id, {_SQL_STATUS} AS status,
  CASE WHEN ({_SQL_STATUS}) = st.status THEN st.n_items ELSE CAST(0 AS BIGINT) END AS n_items
FROM t JOIN st ON t.trigger_id = st.trigger_id""")
def q_extract_job(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return mf.extraction_job(c.manifests, c.status)


@query("P01", "required_fields", with_("t") + f"""
SELECT trigger_id, concat_ws(',', CASE WHEN m_case = 'no_repo' OR {_NO_DOC} THEN 'repo_name' END,
  CASE WHEN t_name = '' OR {_NO_DOC} THEN 'trigger_name' END) AS missing_fields, {_REJECT} AS rejected FROM t""")
def q_required_fields(spark, sf_dir):
    return mf.required_fields(ctx(spark, sf_dir).manifests)


@query("P07", "platform_split", with_("t") + f"""
SELECT trigger_id, {_PLAT} AS source_platform, CASE WHEN ({_PLAT}) = 'platform_3_0' THEN 'supported' ELSE 'rejected' END AS route
FROM t""")
def q_platform_split(spark, sf_dir):
    return mf.platform_split(ctx(spark, sf_dir).manifests)


@query("P14", "manifest_conformance", with_("t") + f"""
SELECT trigger_id, t_name <> '' AND m_case = 'ok' AS valid,
  CASE WHEN {_NO_DOC} THEN 'document: empty or invalid' ELSE concat_ws('; ',
    CASE m_case WHEN 'no_repo' THEN 'pipeline_info.repo_name: missing' WHEN 'wrong_type' THEN 'pipeline_info.repo_name: not a string' END,
    CASE WHEN t_name = '' THEN 'pipeline_info.trigger_name: missing' END) END AS violations,
  CAST(CASE WHEN {_NO_DOC} OR m_access_kind IN (0, 1) THEN 0 ELSE 2 END AS INTEGER) AS n_access_groups,
  {_PLAT} AS source_platform, CASE WHEN NOT {_NO_DOC} THEN m_quality_repo END AS quality_repo
FROM t""")
def q_manifest_conformance(spark, sf_dir):
    return mf.manifest_conformance(ctx(spark, sf_dir).manifests)
