"""Plan-shape guards for every registered query: no cartesian products, no
nested-loop joins, no row-at-a-time Python, and scans read only the columns they
need.  Rows that write files or stream are run, and every plan they ran is checked."""

import pytest

from testbed import artifacts as tb
from tidewater.plans import QUERIES
from tidewater.sources.tables import Tables

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
WRITES = ["read_parquet_task", "read_csv_task", "partition_discovery", "format_options_reader", "sync_append_overwrite", "sync_dynamic_overwrite",
          "sync_schema_guard", "state_snapshot_json", "dataset_run", "stream_incremental_ingest", "stream_upsert", "stream_node_health", "stream_dedupe", "stream_late_rows", "stream_upsert_buckets"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(WRITES)))
def test_plan_shape(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{key}: {bad} in plan"


@pytest.mark.parametrize("key", WRITES)
def test_written_plans(spark, key):
    # the status store keeps a bounded number of executions, so new ones are told by their id
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList()
        return {e.executionId(): e for e in (ran.apply(k) for k in range(ran.size()))}

    last = max(executions(), default=-1)
    QUERIES[key](spark, SF).write.format("noop").mode("overwrite").save()
    plans = [e.physicalPlanDescription() for k, e in executions().items() if k > last]
    assert len(plans) >= 2, "no written plan seen"
    for plan in plans:
        for bad in FORBIDDEN:
            assert bad not in plan, f"{key}: {bad} in a plan it ran"


def test_scan_prunes_columns(spark):
    # the orders scan reads only the columns the fixture needs
    assert "o_totalprice" not in plan_of(QUERIES["acl_flag"](spark, SF))


def test_partition_filter_pushed(spark):
    assert "PartitionFilters: [isnotnull(__process_date" in plan_of(QUERIES["partition_discovery"](spark, SF))


def test_scans(spark):
    def scans(key):
        return plan_of(QUERIES[key](spark, SF)).split("== Initial Plan ==")[0].count("Scan parquet") or plan_of(QUERIES[key](spark, SF)).count("FileScan parquet")

    assert scans("nested_runs") <= 2
    assert scans("pipeline_status") <= 2


@pytest.mark.parametrize("render", [tb.render_notebooks, tb.render_quality_rules, tb.render_pipeline_defs, tb.render_repo_files])
def test_libraries_grow_with_their_tables(spark, render):
    source = {"render_notebooks": "documents", "render_quality_rules": "part", "render_pipeline_defs": "customer", "render_repo_files": "pages"}[render.__name__]
    sizes = []
    for sf in (SF, "/root/testdata/sf0.01"):
        t = Tables(spark, sf)
        n, rows = render(t).count(), getattr(t, source).count()
        assert n >= (rows if render is not tb.render_repo_files else 1)
        sizes.append(n)
    assert sizes[1] > sizes[0]
