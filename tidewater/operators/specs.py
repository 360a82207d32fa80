"""Declarative dataset specs as tables (SURVEY rows N07-N13, J07, J12, J13, U02,
U03, F09).

A spec document has one ``pipeline`` key plus one dynamic key per dataset; it is
parsed once into ``map<string,variant>`` and exploded — every output is a narrow
projection of the documents except the two joins (J07 tasks x datasets, J12
v1 x v2), which are equi-joins on (spec_id, ...) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import with_document
from ..functions.exprs import layer_from_name

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
COMMON_TRANSLATORS = ("ACL_Translator", "Meta_Translator", "Quality_Translator",
                      "Sync_Translator", "Observability_Translator")
LAKE_TRANSLATORS = ("PipelineTranslator", "TransformationsTranslator")  # brz / slv
GOLD_TRANSLATORS = ("PipelineTranslator", "NotebookTranslator")  # gld
CANONICAL_REQUIRED_KEYS = ("pipeline_name", "zone", "landing_zone", "domain", "environment_type", "schedule",
                           "inputs", "outputs", "transformations", "dependencies", "metadata")
CANONICAL_SCALAR_KEYS = CANONICAL_REQUIRED_KEYS[:6]
MISSING_PLACEHOLDER = "unknown"
# ---------------------------------------------------------------------------

_VMAP = "map<string,variant>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _scalar_text(v: Column) -> Column:
    return F.when(~_kind(v).isin("ARRAY", "OBJECT"), F.try_variant_get(v, "$", "string"))


def parse_specs(specs: DataFrame) -> DataFrame:
    """Parse each spec once.  The parse runs inside a Generate (inline of a
    one-element array) so no later filter or projection re-inlines it."""
    return with_document(specs.select("spec_id", "body"), "body").select("spec_id", "doc")


def datasets(parsed: DataFrame) -> DataFrame:
    """(spec_id, dataset, ds): one row per dataset section (every top-level key but ``pipeline``)."""
    m = F.try_variant_get(F.col("doc"), "$", _VMAP)
    return (parsed.select("spec_id", F.explode(m).alias("dataset", "ds"))
            .where(F.col("dataset") != "pipeline"))


def tasks(parsed: DataFrame) -> DataFrame:
    """(spec_id, task_pos, task) from ``pipeline.tasks``."""
    t = F.try_variant_get(F.col("doc"), "$.pipeline.tasks", "array<variant>")
    return parsed.select("spec_id", F.posexplode(t).alias("task_pos", "task"))


def _section_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sec`` as one row per key (key, v); a section that is no object, or an
    empty one, stays as one row with a null key and itself as the value."""
    keys = F.try_variant_get("sec", "$", _VMAP)
    some = F.coalesce(F.size(keys) > 0, F.lit(False))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("sec").alias("value")))
    return rows.withColumn("_kv", F.explode(F.when(some, F.map_entries(keys)).otherwise(whole))).select(
        *[c for c in rows.columns if c != "sec"], F.col("_kv.key").alias("key"), F.col("_kv.value").alias("v"))


def flatten(parsed: DataFrame) -> DataFrame:
    """(spec_id, dataset, section, key, kind, value) for every key of every
    dataset section; ``value`` is the text of a scalar, null for a container.  A section
    that is a scalar, a list or empty is a row with a null key."""
    d = datasets(parsed).select("spec_id", "dataset",
                                F.explode(F.try_variant_get("ds", "$", _VMAP)).alias("section", "sec"))
    kv = _section_keys(d)
    return kv.select("spec_id", "dataset", "section", "key", _kind(F.col("v")).alias("kind"),
                     _scalar_text(F.col("v")).alias("value"))


def columns(parsed: DataFrame) -> DataFrame:
    """Declared columns with position, type and primary-key flag."""
    t = "array<struct<name:string,type:string,primary_key:boolean>>"
    d = datasets(parsed)
    ex = d.select("spec_id", "dataset",
                  F.posexplode(F.try_variant_get("ds", "$.metadata.schema", t)).alias("pos", "c"))
    return ex.select("spec_id", "dataset", F.col("pos").cast("int").alias("pos"), F.col("c.name").alias("name"),
                     F.col("c.type").alias("type"),
                     F.coalesce(F.col("c.primary_key"), F.lit(False)).alias("primary_key"))


def expectations(parsed: DataFrame) -> DataFrame:
    """Expectation x column rows."""
    t = ("array<struct<title:string,handler:string,columns:array<string>,"
         "arguments:struct<blank_as_null:boolean>>>")
    d = datasets(parsed)
    ex = d.select("spec_id", "dataset",
                  F.posexplode(F.try_variant_get("ds", "$.quality.expectations", t)).alias("exp_pos", "e"))
    return ex.select("spec_id", "dataset", F.col("exp_pos").cast("int").alias("exp_pos"),
                     F.col("e.title").alias("title"), F.col("e.handler").alias("handler"),
                     F.explode("e.columns").alias("column_name"),
                     F.col("e.arguments.blank_as_null").alias("blank_as_null"))


def steps(parsed: DataFrame, registry: dict[str, str]) -> DataFrame:
    """Ordered transformation steps, with the registered step each maps to
    (script text is never executed)."""
    t = "array<struct<name:string,type:string,script:string,statement:string>>"
    d = datasets(parsed)
    ex = d.select("spec_id", "dataset",
                  F.posexplode(F.try_variant_get("ds", "$.transformations.steps", t)).alias("step_pos", "s"))
    reg = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    return ex.select("spec_id", "dataset", F.col("step_pos").cast("int").alias("step_pos"),
                     F.col("s.name").alias("name"), F.col("s.type").alias("type"),
                     F.coalesce("s.script", "s.statement").alias("body"),
                     reg[F.col("s.name")].alias("registered_step"))


def alert_routes(parsed: DataFrame) -> DataFrame:
    """Dataset -> (channel, receiver)."""
    d = datasets(parsed)
    return d.select("spec_id", "dataset",
                    F.try_variant_get("ds", "$.observability.type", "string").alias("channel"),
                    F.explode(F.try_variant_get("ds", "$.observability.receivers", "array<string>")).alias("receiver"))


def acl_grants(parsed: DataFrame) -> DataFrame:
    """Dataset x access-group grants with the permission suffix (-r / -rw)."""
    d = datasets(parsed)
    g = d.select("spec_id", "dataset",
                 F.explode(F.try_variant_get("ds", "$.acl.access_groups", "array<string>")).alias("access_group"))
    return g.withColumn("permission", F.nullif(F.regexp_extract("access_group", r"-(rw|r)$", 1), F.lit("")))


def task_dataset_join(parsed: DataFrame) -> DataFrame:
    """Each task matched to its dataset section (key = task name)."""
    t = tasks(parsed).select(
        "spec_id", F.try_variant_get("task", "$.name", "string").alias("task_name"),
        F.try_variant_get("task", "$.target_entity", "string").alias("target_entity"),
        F.size(F.filter(F.map_keys(F.try_variant_get("task", "$", _VMAP)), lambda k: k.endswith("_include")))
        .cast("int").alias("n_includes"))
    d = datasets(parsed).select("spec_id", F.col("dataset").alias("task_name"), F.lit(True).alias("has_dataset"))
    return t.join(d.hint("merge"), ["spec_id", "task_name"], "left").select(
        "spec_id", "task_name", "target_entity", F.coalesce("has_dataset", F.lit(False)).alias("has_dataset"),
        "n_includes")


def resolve_reference(folder: Column, reference: Column) -> Column:
    """The path that ``reference`` names from ``folder`` (a leading slash: from the root), its
    ``.`` and ``..`` steps taken; null if it leaves the root or names nothing."""
    whole = F.when(reference.startswith("/"), reference).otherwise(F.concat_ws("/", folder, reference))
    none = F.array().cast("array<string>")
    step = lambda at, x: (F.when(at.isNull() | (x == ".") | (x == ""), at)
                          .when((x == "..") & (F.size(at) == 0), F.lit(None).cast("array<string>"))
                          .when(x == "..", F.slice(at, F.lit(1), F.size(at) - 1))
                          .otherwise(F.concat(at, F.array(x))))
    return F.when(reference.isNotNull(), F.nullif(F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/"), F.lit("")))


def task_includes(parsed: DataFrame, files: DataFrame, folder: str = "pipeline") -> DataFrame:
    """J07, second half: every ``<section>_include`` of every task matched to its file.

    A reference is resolved from the spec's ``folder`` and joined to ``files(path, body)``.
    Outcomes: found, missing (no such file), outside (the reference leaves the tree),
    bad_document (the file can't be parsed) and wrong_section (it has no such section).
    ``merged`` is the section with the file's keys laid under those of the spec's own section:
    the nearer value wins.  Only files that a task refers to are parsed, each once."""
    keys = F.map_filter(F.try_variant_get("task", "$", _VMAP), lambda k, v: k.endswith("_include"))
    refs = (tasks(parsed).select("spec_id", F.try_variant_get("task", "$.name", "string").alias("task_name"), F.explode(keys).alias("_key", "_ref"))
            .select("spec_id", "task_name", F.regexp_replace("_key", "_include$", "").alias("section"), F.try_variant_get("_ref", "$", "string").alias("reference"))
            .withColumn("path", resolve_reference(F.lit(folder), F.col("reference"))))
    used = files.join(refs.select("path").distinct().hint("merge"), "path", "left_semi")
    parsed_files = with_document(used.select("path", "body"), "body", "_doc").select("path", "_doc", F.lit(True).alias("_there"))
    own = datasets(parsed).select("spec_id", F.col("dataset").alias("task_name"), F.explode(F.try_variant_get("ds", "$", _VMAP)).alias("section", "_own"))
    # merge: documents and their sections have no size that a planner could estimate, so none is broadcast
    j = refs.join(parsed_files.hint("merge"), "path", "left").join(own.hint("merge"), ["spec_id", "task_name", "section"], "left")
    held = F.try_variant_get(F.col("_doc"), "$", _VMAP)[F.col("section")]
    from_file = F.when(_kind(held) == "OBJECT", F.try_variant_get(held, "$", _VMAP))
    from_spec = F.when(_kind(F.col("_own")) == "OBJECT", F.try_variant_get("_own", "$", _VMAP))
    outcome = (F.when(F.col("path").isNull(), "outside").when(F.col("_there").isNull(), "missing").when(F.col("_doc").isNull(), "bad_document")
               .when(from_file.isNull(), "wrong_section").otherwise("found"))
    empty = F.create_map().cast(_VMAP)
    return j.select("spec_id", "task_name", "section", "reference", "path", outcome.alias("outcome"),
                    F.coalesce(from_file, empty).alias("file_keys"), F.coalesce(from_spec, empty).alias("own_keys"),
                    F.map_concat(F.coalesce(from_file, empty), F.coalesce(from_spec, empty)).alias("merged"))


def _leaves(parsed: DataFrame) -> DataFrame:
    """(spec_id, dataset, section, key, vjson): dataset section keys plus the
    pipeline keys (dataset ``_pipeline``), from one explode chain."""
    top = parsed.select("spec_id", F.explode(F.try_variant_get("doc", "$", _VMAP)).alias("top_key", "v"))
    is_pl = F.col("top_key") == "pipeline"
    sections = F.when(is_pl, F.create_map(F.lit("pipeline"), F.col("v"))) \
        .otherwise(F.try_variant_get("v", "$", _VMAP))
    d = top.select("spec_id", F.when(is_pl, F.lit("_pipeline")).otherwise(F.col("top_key")).alias("dataset"),
                   F.explode(sections).alias("section", "sec"))
    kv = _section_keys(d)
    return kv.select("spec_id", "dataset", "section", "key", F.to_json("v").alias("vjson"))


def spec_diff(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Added / removed / changed keys between two versions of each spec
    (full outer join on the key path, null-safe value comparison)."""
    keys = ["spec_id", "dataset", "section", "key"]
    a = _leaves(v1).withColumnRenamed("vjson", "before")
    b = _leaves(v2).withColumnRenamed("vjson", "after")
    j = a.join(b, [a[k].eqNullSafe(b[k]) for k in keys], "full_outer").select(
        *[F.coalesce(a[k], b[k]).alias(k) for k in keys], "before", "after")
    change = (F.when(F.col("before").isNull(), F.lit("added"))
              .when(F.col("after").isNull(), F.lit("removed"))
              .when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed")))
    return j.select(*keys, change.alias("change_type")).where(F.col("change_type").isNotNull())


def translator_fanout(parsed: DataFrame) -> DataFrame:
    """U02 + F09: common translators united with the environment-specific ones."""
    name = F.try_variant_get(F.col("doc"), "$.pipeline.name", "string")
    env = layer_from_name(name)
    common = F.array(*[F.lit(x) for x in COMMON_TRANSLATORS])
    extra = (F.when(env.isin("brz", "slv"), F.array(*[F.lit(x) for x in LAKE_TRANSLATORS]))
             .when(env == "gld", F.array(*[F.lit(x) for x in GOLD_TRANSLATORS]))
             .otherwise(F.array().cast("array<string>")))
    return parsed.select("spec_id", env.alias("environment"),
                         F.explode(F.array_union(common, extra)).alias("translator"))


def required_key_gap(canonical: DataFrame) -> DataFrame:
    """Required canonical keys, present or not; missing scalars become 'unknown'."""
    m = F.try_variant_get(F.try_parse_json("body"), "$", _VMAP)
    c = canonical.select("spec_id", m.alias("m"))
    ex = c.select("spec_id", "m", F.explode(F.array(*[F.lit(k) for k in CANONICAL_REQUIRED_KEYS])).alias("key"))
    v = F.col("m")[F.col("key")]
    present = F.coalesce(F.map_contains_key("m", F.col("key")), F.lit(False)) & ~F.coalesce(F.is_variant_null(v), F.lit(False))
    scalar = F.col("key").isin(*CANONICAL_SCALAR_KEYS)
    return ex.select("spec_id", "key", present.alias("present"),
                     F.when(scalar, F.coalesce(F.when(present, F.try_variant_get(v, "$", "string")),
                                               F.lit(MISSING_PLACEHOLDER))).alias("value"))


def lineage_edges(canonical: DataFrame) -> DataFrame:
    """Lineage as a bipartite graph — input -> transformation ('reads') and
    transformation -> output ('writes').  Linear in the declared lists; no
    input x output pairs are materialised."""
    t = "array<struct<name:string,inputs:array<string>,outputs:array<string>>>"
    trs = canonical.select("spec_id", F.explode(
        F.try_variant_get(F.try_parse_json("body"), "$.transformations", t)).alias("t"))
    reads = trs.select("spec_id", F.explode("t.inputs").alias("src"), F.col("t.name").alias("dst"),
                       F.lit("reads").alias("edge_kind"))
    writes = trs.select("spec_id", F.col("t.name").alias("src"), F.explode("t.outputs").alias("dst"),
                        F.lit("writes").alias("edge_kind"))
    return reads.unionByName(writes).distinct()


def dependency_edges(canonical: DataFrame) -> DataFrame:
    """Pipeline -> dependency rows by type."""
    t = "array<struct<type:string,name:string,details:map<string,string>>>"
    doc = F.try_parse_json("body")
    d = canonical.select("spec_id", F.try_variant_get(doc, "$.pipeline_name", "string").alias("pipeline_name"),
                         F.explode(F.try_variant_get(doc, "$.dependencies", t)).alias("d"))
    return d.select("spec_id", "pipeline_name", F.col("d.type").alias("dep_type"), F.col("d.name").alias("dep_name"),
                    F.size("d.details").cast("int").alias("n_details"))
