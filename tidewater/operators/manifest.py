"""Run manifests: conformance (P14), required inputs (P01), platform routing
and the template extraction job (X02) that turns them into outcome rows.

All row-local (variant navigation) plus one key join on ``trigger_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import with_document
from ..functions.exprs import truthy

# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
DEFAULT_PLATFORM = "platform_3_0"
SUPPORTED_PLATFORMS = ("platform_3_0",)
REQUIRED_FIELDS = ("repo_name", "trigger_name")
# ---------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def manifest_fields(manifests: DataFrame) -> DataFrame:
    parsed = with_document(manifests.select("trigger_id", "body"), "body")
    d = F.col("doc")
    return parsed.select(
        "trigger_id",
        d.isNotNull().alias("parsed"),
        F.try_variant_get(d, "$.pipeline_info", "variant").alias("pi"),
        F.try_variant_get(d, "$.pipeline_info.repo_name", "variant").alias("repo_v"),
        F.try_variant_get(d, "$.pipeline_info.trigger_name", "variant").alias("trigger_v"),
        F.try_variant_get(d, "$.access_groups", "variant").alias("groups_v"),
        F.try_variant_get(d, "$.source_platform", "string").alias("source_platform_raw"),
        F.try_variant_get(d, "$.quality_repo", "string").alias("quality_repo"),
    )


def manifest_conformance(manifests: DataFrame) -> DataFrame:
    """Required fields and types, defaults applied, unknown keys dropped."""
    m = manifest_fields(manifests)

    def field_check(v: Column, name: str) -> Column:
        return (F.when(v.isNull(), F.lit(f"pipeline_info.{name}: missing"))
                .when(_kind(v) != "STRING", F.lit(f"pipeline_info.{name}: not a string")))

    checks = F.array_compact(F.array(
        F.when(~F.col("parsed"), F.lit("document: empty or invalid")),
        F.when(F.col("parsed") & F.col("pi").isNull(), F.lit("pipeline_info: missing")),
        F.when(F.col("pi").isNotNull(), field_check(F.col("repo_v"), "repo_name")),
        F.when(F.col("pi").isNotNull(), field_check(F.col("trigger_v"), "trigger_name")),
        F.when(F.col("groups_v").isNotNull() & ~_kind(F.col("groups_v")).startswith("ARRAY"),
               F.lit("access_groups: not a list")),
    ))
    groups = F.try_variant_get(F.col("groups_v"), "$", "array<string>")
    return m.select(
        "trigger_id",
        (F.size(checks) == 0).alias("valid"),
        F.array_join(checks, "; ").alias("violations"),
        F.coalesce(F.size(groups), F.lit(0)).cast("int").alias("n_access_groups"),
        F.coalesce("source_platform_raw", F.lit(DEFAULT_PLATFORM)).alias("source_platform"),
        "quality_repo",
    )


def required_fields(manifests: DataFrame) -> DataFrame:
    """Required inputs that are missing *or empty*; the record is rejected if any."""
    missing = _missing()
    return manifest_fields(manifests).select("trigger_id", F.array_join(missing, ",").alias("missing_fields"),
                                             (F.size(missing) > 0).alias("rejected"))


def _missing() -> Column:
    return F.array_compact(F.array(*[
        F.when(truthy(F.try_variant_get(F.col(v), "$", "string")).isNull(), F.lit(name))
        for v, name in (("repo_v", "repo_name"), ("trigger_v", "trigger_name"))
    ]))


def _platform() -> Column:
    return F.coalesce("source_platform_raw", F.lit(DEFAULT_PLATFORM))


def _route() -> Column:
    return F.when(_platform().isin(*SUPPORTED_PLATFORMS), F.lit("supported")).otherwise(F.lit("rejected"))


def platform_split(manifests: DataFrame) -> DataFrame:
    """One routing column; supported and rejected rows come out of one pass."""
    return manifest_fields(manifests).select("trigger_id", _platform().alias("source_platform"), _route().alias("route"))


def extraction_job(manifests: DataFrame, trigger_status: DataFrame) -> DataFrame:
    """Validate inputs -> route by platform -> extract; every failure is a row.

    ``trigger_status`` comes from the platform's own extractor (signals.trigger_status);
    another platform registers another status frame and joins here the same way."""
    checked = manifest_fields(manifests).select("trigger_id", (F.size(_missing()) > 0).alias("rejected"), _route().alias("route"))
    # merge: a status comes out of a document, whose size a planner guesses far too low, and there
    # is one for every trigger, so a broadcast would bring them all to the driver
    j = checked.join(trigger_status.hint("merge"), "trigger_id", "left")
    status = (F.when(F.col("rejected"), F.lit("invalid_input"))
              .when(F.col("route") != "supported", F.lit("unsupported_platform"))
              .otherwise(F.col("status")))
    n = F.when(~F.col("rejected") & (F.col("route") == "supported"), F.col("n_items")).otherwise(F.lit(0))
    return j.select("trigger_id", status.alias("status"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_items"))
