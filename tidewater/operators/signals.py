"""Legacy-trigger corpus -> items -> per-pipeline and per-table signals.

Shape of the work:

    triggers --from_json (one parse, explicit schema)--> one row per trigger
      * pipeline-level facts (item counts, first config, rejected items, status,
        zone / domain fallbacks) are computed *inside the trigger row* with array
        functions over its own item list: no shuffle, no join back;
    --posexplode--> one row per item (only where item-level output is needed)
      * last-wins per (trigger, target_entity) is a partial + final
        ``max_by`` / ``min`` aggregate hash-partitioned on that key.

A trigger's items come from one document, so they are already co-located in
the row that holds it; aggregating them in the row is the cheapest plan and
never gathers data that was not already together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import with_document_if_used
from ..functions.exprs import (
    clean_notebook_path,
    first_truthy,
    map_domain,
    pystrip,
    truthy,
)

# Explicit document schema (FIXTURES §2).  Config maps are map<string,string>: a
# nested value arrives as its JSON text, an explicit null stays a null value.
TRIGGER_SCHEMA = (
    "name STRING, type STRING, "
    "properties STRUCT<type: STRING, typeProperties: VARIANT, pipelines: ARRAY<STRUCT<"
    "pipelineReference: STRUCT<referenceName: STRING>, "
    "parameters: STRUCT<source_system_zone: STRING, target_zone: STRING, target_business_domain: STRING, "
    "source_system: STRING, source_system_raw: STRING, "
    "items_to_process: STRUCT<pipelines: ARRAY<STRUCT<load_to_bronze: MAP<STRING, STRING>, "
    "load_to_silver: MAP<STRING, STRING>>>>>>>>, "
    "_corrupt_record STRING"
)
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
                "allowSingleQuotes": "false"}

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour (signal defaults).
DEFAULT_ZONE = "maz"
DEFAULT_LANDING_ZONE = "maz"
DEFAULT_OWNER = "platform"
DEFAULT_CONNECTOR = "blob"
DEFAULT_SOURCE_ENTITY = "source_entity_placeholder"
PIPELINE_SOURCE_ENTITY = "remove_later"
DEFAULT_CONNECTION_ID = "sap-test-secret"
SCHEDULE_TRIGGER = "ScheduleTrigger"
# ---------------------------------------------------------------------------


def _cfg_strings(cfg: Column) -> Column:
    """map<string,variant> -> map<string,string>; a JSON null stays a null value."""
    return F.transform_values(cfg, lambda k, v: F.try_variant_get(v, "$", "string"))


def parse_triggers(triggers: DataFrame) -> DataFrame:
    """Parse every trigger once.  Malformed bodies are kept, flagged, not dropped."""
    # The parse runs inside a Generate (inline of a one-element array): filters on
    # its output (status, parse_ok) cannot be pushed below it, so every document
    # is parsed exactly once instead of once per referenced field.
    raw = triggers.select("trigger_id", "repo", F.inline(F.array(F.struct(
        F.from_json("body", TRIGGER_SCHEMA, JSON_OPTIONS).alias("raw")))))
    ok = F.col("raw").isNotNull() & F.col("raw._corrupt_record").isNull()
    # PERMISSIVE parsing keeps fields read before the error; a malformed document
    # must yield none of them.
    return raw.select("trigger_id", "repo", F.when(ok, F.col("raw")).alias("doc"), ok.alias("parse_ok"))


def _nonempty(m: Column) -> Column:
    return F.coalesce(F.size(m) > 0, F.lit(False))


def _item_table_name(x: Column) -> Column:
    """silver target, else bronze target, else 'unknown' (null if the chosen
    config lacks ``target_table`` — that item rejects its trigger)."""
    brz, slv = x["load_to_bronze"], x["load_to_silver"]
    return (F.when(_nonempty(slv), slv["target_table"])
            .when(_nonempty(brz), brz["target_table"])
            .otherwise(F.lit("unknown")))


def trigger_header(parsed: DataFrame) -> DataFrame:
    """Per-trigger scalar fields (N03) plus the facts derived from the trigger's own
    item list (A01 counts, W04 first config, rejected items, extraction status)."""
    d = F.col("doc")
    pipelines = d["properties"]["pipelines"]
    p0 = F.try_element_at(pipelines, F.lit(1))
    params = p0["parameters"]
    items = params["items_to_process"]["pipelines"]
    first = F.try_element_at(items, F.lit(1))
    f_brz, f_slv = first["load_to_bronze"], first["load_to_silver"]
    h = parsed.select(
        "trigger_id", "repo", "parse_ok",
        d["name"].alias("name"),
        d["properties"]["type"].alias("prop_type"),
        d["type"].alias("top_type"),
        F.size(pipelines).alias("n_pipelines"),
        p0["pipelineReference"]["referenceName"].alias("pipeline_ref"),
        params["source_system_zone"].alias("p_source_system_zone"),
        params["target_zone"].alias("p_target_zone"),
        params["target_business_domain"].alias("p_domain"),
        params["source_system"].alias("p_source_system"),
        params["source_system_raw"].alias("p_source_system_raw"),
        d["properties"]["typeProperties"].alias("type_props"),
        items.alias("items"),
        F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("n_items"),
        F.size(F.filter(items, lambda x: _item_table_name(x).isNull())).alias("n_bad_items"),
        F.coalesce(F.size(F.filter(items, lambda x: _nonempty(x["load_to_bronze"]))), F.lit(0))
        .cast("bigint").alias("bronze_count"),
        F.coalesce(F.size(F.filter(items, lambda x: _nonempty(x["load_to_silver"]))), F.lit(0))
        .cast("bigint").alias("silver_count"),
        # The first item's silver config if non-empty, else bronze, else {}
        F.when(_nonempty(f_slv), f_slv).when(_nonempty(f_brz), f_brz).alias("first_cfg"),
        F.when(_nonempty(f_slv), F.lit("slv")).when(_nonempty(f_brz), F.lit("brz")).alias("first_layer"),
    ).withColumn("has_pipeline", F.coalesce(F.col("n_pipelines") > 0, F.lit(False)))
    status = (F.when(~F.col("parse_ok"), F.lit("malformed_trigger"))
              .when(~F.col("has_pipeline"), F.lit("no_pipelines"))
              .when(F.coalesce(F.col("n_bad_items"), F.lit(0)) > 0, F.lit("bad_item"))
              .otherwise(F.lit("ok")))
    h = h.withColumn("status", status)
    # pipeline-level fallbacks (N06), also the table-level fallbacks of N05
    fc = F.col("first_cfg")
    return h.withColumns({
        "pl_zone": first_truthy(fc["target_zone"], "p_source_system_zone", default=DEFAULT_ZONE),
        "pl_landing_zone": first_truthy(fc["target_zone"], "p_target_zone", default=DEFAULT_LANDING_ZONE),
        "pl_domain": map_domain(first_truthy(fc["target_business_domain"], "p_domain", default="unknown_domain")),
        "pl_source_system": first_truthy(fc["source_system"], fc["source_system_raw"], "p_source_system",
                                         "p_source_system_raw", default="unknown_source_system"),
    })


def is_schedule_trigger(prop_type: Column, top_type: Column) -> Column:
    """Schedule-type trigger, declared in ``properties`` or at the top level."""
    return prop_type.eqNullSafe(SCHEDULE_TRIGGER) | top_type.eqNullSafe(SCHEDULE_TRIGGER)


def _first_int(v: Column) -> Column:
    """First element of a non-empty list as int, or a bare JSON integer; else null.
    A bare string (``"9"``) or boolean is null."""
    kind = F.schema_of_variant(v)
    first = F.try_variant_get(v, "$[0]", "string")
    return (F.when(kind.startswith("ARRAY"), pystrip(first).try_cast("bigint"))
            .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")))


def with_cron(df: DataFrame, type_props: str = "type_props", cron: str = "cron",
              schedule: str = "schedule") -> DataFrame:
    """add (cron, schedule) for a schedule trigger.  Always daily ``"m h * * *"``;
    a missing part falls back to ``startTime``; both missing -> raw recurrence JSON.

    Intermediate values are staged as columns so each variant navigation runs
    once per row (a nested expression would be re-inlined at every use)."""
    tp = F.col(type_props)
    d = df.withColumn("_rec", F.try_variant_get(tp, "$.recurrence", "variant"))
    d = d.withColumns({
        "_mv": F.try_variant_get(F.col("_rec"), "$.schedule.minutes", "variant"),
        "_hv": F.try_variant_get(F.col("_rec"), "$.schedule.hours", "variant"),
        "_start_v": F.try_variant_get(F.col("_rec"), "$.startTime", "variant"),
        "_rec_json": F.to_json(F.col("_rec")),
    })
    d = d.withColumns({"_m0": _first_int(F.col("_mv")), "_h0": _first_int(F.col("_hv"))})
    start = F.when(F.schema_of_variant("_start_v") == "STRING", F.try_variant_get(F.col("_start_v"), "$", "string"))
    time_part = F.when(F.instr(start, "T") > 0, F.substr(start, F.instr(start, "T") + 1))
    d = d.withColumn("_pieces", F.split(time_part, ":"))
    # ``h, m, *_ = t.split(':')`` needs two pieces; the hour is assigned before the
    # minute is parsed, and int() only runs for a part that is still missing.
    d = d.withColumns({
        "_usable": F.coalesce(F.size("_pieces") >= 2, F.lit(False)) & (F.col("_m0").isNull() | F.col("_h0").isNull()),
        "_hi": pystrip(F.element_at("_pieces", 1)).try_cast("bigint"),
        "_mi": pystrip(F.element_at("_pieces", 2)).try_cast("bigint"),
    })
    d = d.withColumns({
        "_hours": F.when(F.col("_usable") & F.col("_h0").isNull(), F.col("_hi")).otherwise(F.col("_h0")),
        "_minutes": F.when(F.col("_usable") & (F.col("_h0").isNotNull() | F.col("_hi").isNotNull())
                           & F.col("_m0").isNull(), F.col("_mi")).otherwise(F.col("_m0")),
    })
    c = F.when(F.col("_minutes").isNotNull() | F.col("_hours").isNotNull(),
               F.concat_ws(" ", F.coalesce(F.col("_minutes").cast("string"), F.lit("*")),
                           F.coalesce(F.col("_hours").cast("string"), F.lit("*")), F.lit("* * *")))
    raw = F.when(F.col("_rec").isNotNull() & (F.col("_rec_json") != "{}"), F.col("_rec_json")) \
        .otherwise(F.coalesce(F.to_json(tp), F.lit("{}")))
    d = d.withColumn(cron, c)
    d = d.withColumn(schedule, F.coalesce(F.col(cron), raw))
    return d.drop("_rec", "_mv", "_hv", "_m0", "_h0", "_start_v", "_rec_json", "_pieces", "_usable", "_hi", "_mi", "_hours",
                  "_minutes")


def explode_items(header: DataFrame, outer: bool = False) -> DataFrame:
    """One row per entry of ``items_to_process.pipelines`` with its position; with ``outer``,
    a trigger without entries has one row, its position null.

    ``*_present`` is "key present and not null" (the item's ``has_silver``);
    ``*_nonempty`` is Python truthiness ({} is present but falsy).  Trigger-level
    columns needed downstream (status, pipeline fallbacks) ride along."""
    ex = header.where("parse_ok").select(
        "trigger_id", "repo", "status", "pl_zone", "pl_domain",
        (F.posexplode_outer if outer else F.posexplode)("items").alias("item_pos", "it"))
    brz, slv = F.col("it.load_to_bronze"), F.col("it.load_to_silver")
    b_ok, s_ok = _nonempty(brz), _nonempty(slv)
    return ex.select(
        "trigger_id", "repo", "status", "pl_zone", "pl_domain",
        F.col("item_pos").cast("int").alias("item_pos"), brz.alias("brz"), slv.alias("slv"),
        brz.isNotNull().alias("bronze_present"),
        b_ok.alias("bronze_nonempty"),
        slv.isNotNull().alias("silver_present"),
        s_ok.alias("silver_nonempty"),
        _item_table_name(F.col("it")).alias("table_name"),
        F.when(b_ok, clean_notebook_path(brz["adb_notebook_path"])).alias("notebook_path_brz"),
        F.when(s_ok, clean_notebook_path(slv["adb_notebook_path"])).alias("notebook_path_slv"),
        # silver's source system when silver is non-empty, else bronze's
        F.when(s_ok, slv["source_system"]).when(b_ok, brz["source_system"]).alias("source_system"),
    )


def trigger_status(header: DataFrame) -> DataFrame:
    """Extraction outcome per trigger: ok / malformed_trigger / no_pipelines / bad_item."""
    return header.select("trigger_id", "status", "n_items")


def layer_counts(header: DataFrame) -> DataFrame:
    """Items with non-empty bronze / silver per trigger (before last-wins)."""
    return header.where("parse_ok AND has_pipeline").select("trigger_id", "bronze_count", "silver_count")


def first_config(header: DataFrame) -> DataFrame:
    """The first item's silver config if non-empty, else bronze, else {}."""
    return header.where(F.col("n_items") > 0).select("trigger_id", "first_cfg", "first_layer")


def pipeline_signal(header: DataFrame) -> DataFrame:
    """The per-pipeline record (only for triggers whose extraction succeeded).
    A pure projection of the trigger row."""
    sched = is_schedule_trigger(F.col("prop_type"), F.col("top_type"))
    h = with_cron(header.where(F.col("status") == "ok"), cron="_cron", schedule="_schedule")
    schedule = F.col("_schedule")
    return h.select(
        "trigger_id",
        F.col("pl_zone").alias("zone"),
        F.col("pl_landing_zone").alias("landing_zone"),
        F.col("pl_domain").alias("domain"),
        first_truthy("name", default="unknown_pipeline").alias("pipeline"),
        F.when(sched, schedule).alias("schedule"),
        F.lit(DEFAULT_OWNER).alias("owner"),
        F.lit(DEFAULT_CONNECTOR).alias("connector"),
        F.col("pl_source_system").alias("source_system"),
        F.lit(PIPELINE_SOURCE_ENTITY).alias("source_entity"),
        "bronze_count", "silver_count",
    )


def connection_id(manifest_doc: Column) -> Column:
    """manifest ``connection_id`` stripped, when truthy; else the fixed default.
    The emptiness test comes before the strip, so '  ' gives ''."""
    raw = F.try_variant_get(manifest_doc, "$.connection_id", "string")
    return F.when(truthy(raw).isNotNull(), pystrip(raw)).otherwise(F.lit(DEFAULT_CONNECTION_ID))


def acl_flag(metadata_doc: Column) -> Column:
    """'y' when ``state.metadata.access_groups`` is present and not JSON null
    (an empty list counts)."""
    v = F.try_variant_get(metadata_doc, "$.state.metadata.access_groups", "variant")
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.lit("y")).otherwise(F.lit("n"))


def table_signal(items: DataFrame, manifests: DataFrame, metadata: DataFrame) -> DataFrame:
    """N05 (+P05, A03): one row per (trigger, target_entity) of the successfully
    extracted triggers; the later item wins, the position is the first occurrence.
    ``items`` come from explode_items (they carry the pipeline fallbacks)."""
    # a caller that uses neither (F05, A03) has their documents joined, not parsed
    m = with_document_if_used(manifests, "body").select("trigger_id", connection_id(F.col("doc")).alias("connection_id"))
    md = with_document_if_used(metadata, "body").select("trigger_id", acl_flag(F.col("doc")).alias("acl"))
    it = items.where((F.col("status") == "ok") & (F.col("bronze_nonempty") | F.col("silver_nonempty")))  # P05
    layer = F.when(F.col("bronze_nonempty"), F.lit("brz")).otherwise(F.lit("slv"))
    cfg = F.when(F.col("bronze_nonempty"), F.col("brz")).otherwise(F.col("slv"))
    it = it.select("trigger_id", "item_pos", "pl_zone", "pl_domain", "silver_nonempty",
                   layer.alias("target_layer"), cfg.alias("cfg"))
    c = F.col("cfg")
    zone_local = first_truthy(c["target_zone"], "pl_zone")
    domain_local = map_domain(first_truthy(c["target_business_domain"], "pl_domain"))
    source_system = first_truthy(c["source_system"], c["source_system_raw"], default="unknown_source_system")
    country = first_truthy(c["source_system_country"], c["source_raw_zone"], default="unknown_country")
    target_entity = first_truthy(c["target_table"], default="unknown_target_table")
    brz_name = F.concat_ws("_", F.lit("brz"), zone_local, domain_local, source_system, country)
    slv_name = first_truthy(c["target_table"], c["source_table"], target_entity)
    rows = it.select(
        "trigger_id", "item_pos",
        target_entity.alias("target_entity"),
        F.struct(
            F.col("target_layer"),
            domain_local.alias("domain"),
            F.when(F.col("target_layer") == "brz", brz_name).otherwise(slv_name).alias("table_name"),
            F.when(F.col("silver_nonempty"), F.lit("y")).otherwise(F.lit("n")).alias("transformations"),
        ).alias("v"),
    )
    # Last writer's values, first writer's position (partial+final aggregate).
    lw = rows.groupBy("trigger_id", "target_entity").agg(
        F.max_by("v", "item_pos").alias("v"),
        F.min("item_pos").alias("first_pos"),
        F.max("item_pos").alias("last_pos"),
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
    )
    return lw.join(m, "trigger_id", "left").join(md, "trigger_id", "left").select(
        "trigger_id", "target_entity", "first_pos", "last_pos", "n_items",
        F.col("v.target_layer").alias("target_layer"),
        F.col("v.domain").alias("domain"),
        F.col("v.table_name").alias("table_name"),
        F.lit(DEFAULT_OWNER).alias("owner"),
        F.lit(DEFAULT_CONNECTOR).alias("connector"),
        F.coalesce("connection_id", F.lit(DEFAULT_CONNECTION_ID)).alias("connection_id"),
        F.col("v.transformations").alias("transformations"),
        F.coalesce("acl", F.lit("n")).alias("acl"),
    )
