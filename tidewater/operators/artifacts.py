"""Artifact corpus work: repository file dumps, factory parameters, notebook and
quality-rule lookups (SURVEY rows S01-S03, N04, P13, J01-J06, J10, J11, A02, U01,
F06, F28).

The source fetched one file per HTTP call inside nested loops; here each lookup
is one equi-join between the distinct keys the items need and the landed library.
The libraries grow with the corpus, so no side is force-broadcast: AQE converts a
join to broadcast-hash only when the runtime size of a side is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .signals import _cfg_strings

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
FACTORY_PREFERRED_TOKEN = "sap-adf"
ORCHESTRATION_REPO_SUFFIX = "-repo-adf"
CODE_REPO_SUFFIX = "-repo-adb"
ERROR_PLACEHOLDER_PREFIX = "# ERROR: "
DEFAULT_PROJECT_ZONE = "maz"
DEFAULT_PROJECT_DOMAIN = "tech"
GOVERNANCE_PATH_FORMAT = "src/{zone}/{zone}/{domain}/{system}/dq_definitions/{country}/{db}/{table}.yaml"
# ---------------------------------------------------------------------------


def lenient_base64(payload: Column) -> Column:
    """Bytes of a base64 text: characters outside the alphabet are skipped, the text ends at
    its padding, and a last group that is one character long or lacks padding is an error
    (null)."""
    return _unpadded(F.regexp_replace(payload, "[^A-Za-z0-9+/=]", ""))


def _unpadded(clean: Column) -> Column:
    """``lenient_base64`` of a text that holds the alphabet and padding alone."""
    data = F.substring_index(clean, "=", 1)
    over = F.length(data) % 4
    pads = F.length(F.regexp_extract(F.substring(clean, F.length(data) + 1, F.lit(3)), "^=*", 0))
    good = (over == 0) | (over == 2) & (pads >= 2) | (over == 3) & (pads >= 1)
    return F.when(good, F.try_to_binary(F.concat(data, F.substring(F.lit("==="), F.lit(1), (4 - over) % 4)), F.lit("base64")))


def _decoded(rows: DataFrame, payload: str, out: str) -> DataFrame:
    """``rows`` with the UTF-8 text of column ``payload`` (base64) as ``out``, null if it is none; each step
    stands behind a Generate, so that a payload is cleaned and decoded once however often
    the text is used."""
    keep = [c for c in rows.columns if c != payload]
    clean = rows.select(*keep, F.inline(F.array(F.struct(F.regexp_replace(payload, "[^A-Za-z0-9+/=]", "").alias("_clean")))))
    return clean.select(*keep, F.inline(F.array(F.struct(F.try_validate_utf8(_unpadded(F.col("_clean")).cast("string")).alias(out)))))


def decode_files(repo_files: DataFrame, requests: DataFrame) -> DataFrame:
    """Decoded UTF-8 text per requested (repo, ref, path); outcome is one of
    ok / directory / not_found / bad_payload."""
    f = repo_files.select("repo", "ref", "path", "type", "content_b64")
    j = _decoded(requests.join(f, ["repo", "ref", "path"], "left"), "content_b64", "_text")
    text = F.col("_text")
    outcome = (F.when(F.col("type").isNull(), F.lit("not_found"))
               .when(F.col("type") == "dir", F.lit("directory"))
               .when(text.isNull(), F.lit("bad_payload"))
               .otherwise(F.lit("ok")))
    return j.select("repo", "ref", "path", outcome.alias("outcome"),
                    F.when(outcome == "ok", text).alias("text"))


def list_directory(repo_files: DataFrame) -> DataFrame:
    """Direct children of every directory of a ref: (repo, ref, dir, name, path, type).
    A directory that does not exist, or a file path, simply has no rows."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return repo_files.select("repo", "ref", parent.alias("dir"), "name", "path", "type").distinct()


def pick_factory_file(factories: DataFrame) -> DataFrame:
    """Per repo, the first ``.json`` whose name contains ``sap-adf`` in listing
    (name) order, else the first ``.json``; repos without one have no row.
    A partial min_by aggregate — no per-repo sort."""
    js = factories.where(F.col("name").endswith(".json"))
    rank = F.struct((~F.col("name").contains(FACTORY_PREFERRED_TOKEN)).alias("not_preferred"), F.col("name"))
    return js.groupBy("repo").agg(F.min_by(F.struct("name", "body"), rank).alias("f")).select(
        "repo", F.col("f.name").alias("file_name"), F.col("f.body").alias("body"))


def flatten_params(factories: DataFrame) -> DataFrame:
    """N04 + P13: string ``value``s of the global parameters, overlaid by the
    ``prod`` environment map, or ``dev`` when ``prod`` is empty (right side wins).

    Deviation (documented): a parameter that is not an object is skipped instead
    of aborting the flattening."""
    gp = F.try_variant_get(F.try_parse_json("body"), "$.properties.globalParameters", "map<string,variant>")
    base = F.map_filter(
        F.transform_values(gp, lambda k, v: F.when(
            F.schema_of_variant(F.try_variant_get(v, "$.value", "variant")) == "STRING",
            F.try_variant_get(v, "$.value", "string"))),
        lambda k, v: v.isNotNull())
    env = F.try_variant_get(gp["default_parameters_per_environment"], "$.value", "map<string,variant>")
    prod, dev = env["prod"], env["dev"]
    prod_map = F.try_variant_get(prod, "$", "map<string,variant>")
    dev_map = F.try_variant_get(dev, "$", "map<string,variant>")
    overlay = F.when(F.size(prod_map) > 0, prod_map).otherwise(F.coalesce(dev_map, F.create_map().cast("map<string,variant>")))
    overlay = _cfg_strings(overlay)
    return factories.select("repo", "name", base.alias("base"), overlay.alias("overlay"))


def overlay_config(base: Column, override: Column) -> Column:
    """Merge two configs, right side wins (needs mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_concat(F.coalesce(base, F.create_map().cast("map<string,string>")),
                        F.coalesce(override, F.create_map().cast("map<string,string>")))


def repo_params(factories: DataFrame) -> DataFrame:
    """Per orchestration repo: the flattened parameters of its picked factory file."""
    picked = pick_factory_file(factories).select("repo", F.col("file_name").alias("name"), "body")
    flat = flatten_params(picked)
    return flat.select("repo", F.col("name").alias("file_name"),
                       overlay_config(F.col("base"), F.col("overlay")).alias("params"))


#: A side of so many rows and bytes (as JSON) at most may be sent to every task.
SMALL_ROWS, SMALL_BYTES = 50_000, 16 << 20


def sent_if_small(side: DataFrame) -> DataFrame:
    """``side`` written once and measured: a broadcast if it is small, else as it is read.  A join
    on few values (25 repositories) would else bring all rows to as many tasks."""
    spark = side.sparkSession
    path = scratch_path(spark, "join-side")
    side.write.parquet(path)
    held = spark.read.schema(side.schema).parquet(path)
    n, size = held.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(held) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else held


def code_repo(repo: Column) -> Column:
    """Orchestration repo -> code repo by name rewrite."""
    return F.replace(repo, F.lit(ORCHESTRATION_REPO_SUFFIX), F.lit(CODE_REPO_SUFFIX))


def _script_paths() -> Column:
    """The notebook paths of an item, of both layers."""
    return F.array_compact(F.array("notebook_path_brz", "notebook_path_slv"))


def item_scripts(items: DataFrame, *by: str) -> DataFrame:
    """(trigger, code repo, path) for both layers, distinct; with ``by``, these columns
    alone, made distinct once."""
    rows = items.select("trigger_id", code_repo(F.col("repo")).alias("repo_adb"), F.explode(_script_paths()).alias("path"))
    return rows.select(*by or rows.columns).distinct()


def script_counts(items: DataFrame) -> DataFrame:
    """(trigger, number of distinct paths over both layers), a row for each trigger document
    of ``items`` (an outer explode); documents of one trigger share their paths."""
    rows = items.select("trigger_id", "item_pos", F.posexplode_outer(_script_paths()).alias("path_pos", "path"))
    start = (F.coalesce("item_pos", F.lit(0)) == 0) & (F.coalesce("path_pos", F.lit(0)) == 0)
    n = rows.groupBy("trigger_id").agg(F.count_distinct("path").cast("bigint").alias("n_scripts"),
                                       F.count_if(start).cast("int").alias("documents"))
    return n.select("trigger_id", "n_scripts", F.explode(F.array_repeat(F.lit(1), F.col("documents"))).alias("one")).drop("one")


def attach_notebooks(scripts: DataFrame, notebooks: DataFrame, of: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Distinct (repo, path) -> notebook text, or an error placeholder.  ``of`` (such as
    ``F.md5``) is what the caller needs of a text: it is taken where the notebook is read, so
    that no text is shuffled which is not asked for."""
    keys = scripts if scripts.columns == ["repo_adb", "path"] else scripts.select("repo_adb", "path").distinct()
    nb = notebooks.select(F.col("repo").alias("repo_adb"), "path", of(F.col("content")).alias("content"))
    j = keys.join(nb, ["repo_adb", "path"], "left")
    missing = F.concat(F.lit(ERROR_PLACEHOLDER_PREFIX), F.lit("file not found: "), "path")
    return j.select("repo_adb", "path", F.col("content").isNotNull().alias("found"), F.coalesce("content", of(missing)).alias("content"))


def governance_path(items_with_params: DataFrame) -> Column:
    """governance YAML path from the silver config (``get`` defaults: an absent
    key -> 'unknown', an explicit null renders 'None') and the repo parameters."""
    from ..functions.exprs import key_or_default

    slv, params = F.col("slv"), F.col("params")
    zone = key_or_default(params, "project_zone", DEFAULT_PROJECT_ZONE)
    domain = key_or_default(params, "project_business_domain", DEFAULT_PROJECT_DOMAIN)
    return F.concat(
        F.lit("src/"), zone, F.lit("/"), zone, F.lit("/"), domain, F.lit("/"),
        key_or_default(slv, "source_system", "unknown"), F.lit("/dq_definitions/"),
        key_or_default(slv, "source_system_country", "unknown"), F.lit("/"),
        key_or_default(slv, "target_database", "unknown"), F.lit("/"),
        F.coalesce(F.col("table_name"), F.lit("None")), F.lit(".yaml"),
    )


def silver_rule_lookup(items: DataFrame, params: DataFrame, rules: DataFrame) -> DataFrame:
    """Silver items (``has_silver`` = key present, even ``{}``) -> governance
    path -> rule library (left join); ``found`` marks a hit."""
    s = items.where("silver_present").join(sent_if_small(params.select("repo", "params")), "repo", "left")
    s = s.select("trigger_id", "item_pos", "table_name", governance_path(s).alias("governance_path"))
    r = rules.select(F.col("path").alias("governance_path"), F.lit(True).alias("found"), "content")
    return s.join(r, "governance_path", "left").select(
        "trigger_id", "item_pos", "table_name", "governance_path",
        F.coalesce("found", F.lit(False)).alias("rule_found"), "content")


def tables_without_rule(lookups: DataFrame) -> DataFrame:
    """J10, second half: the silver tables (trigger, table) for none of whose items a rule was
    found.  One aggregate: the rows that have a rule and those that lack one share the key."""
    return lookups.groupBy("trigger_id", "table_name").agg(F.bool_or("rule_found").alias("any")).where("not any").select("trigger_id", "table_name")


def governance_backfill(items: DataFrame, lookups: DataFrame) -> DataFrame:
    """Every item gets the path of the *last* silver item with the same table
    name whose rule was found.  Computed as an aggregate per (trigger, table) and
    joined back — no per-item nested loop and no window sort over whole triggers."""
    last = (lookups.where("rule_found")
            .groupBy("trigger_id", "table_name")
            .agg(F.max_by("governance_path", "item_pos").alias("governance_path")))
    return items.select("trigger_id", "item_pos", "table_name").join(
        last, ["trigger_id", "table_name"], "left")


def code_flags(notebooks: DataFrame) -> DataFrame:
    """per code repo, how many notebooks mention ``opflag`` / stream writes, and how long they
    are in all and at most (characters)."""
    return notebooks.groupBy("repo").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_notebooks"),
        F.count_if(F.col("content").contains("opflag")).cast("bigint").alias("n_opflag"),
        F.count_if(F.col("content").contains("write_stream_delta_table")).cast("bigint").alias("n_stream_write"),
        F.sum(F.length("content")).cast("bigint").alias("total_length"),
        F.max(F.length("content")).cast("bigint").alias("max_length"),
    )
