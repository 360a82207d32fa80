"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8), executing the full plan into Spark's ``noop``
sink (nothing is collected to the driver), and prints ONE JSON line:

    {"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

The document corpora that the test bed renders from the tables are written once before
the clock starts (``corpora_sec``), so a query's time is that of its operators on files.
``scale_out`` gives a few queries at a tenth of the scale beside the full one.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "table_signal",            # N05  trigger corpus -> per-table signals (flagship)
    "pipeline_signal",         # N06
    "items_explode",           # N02
    "extract_normalize_job",   # X02
    "item_notebook_join",      # J01
    "item_quality_rule_join",  # J02
    "governance_backfill",     # J03
    "log_block_segment",       # W01
    "error_record",            # F21
    "errors_by_file",          # A04
    "spec_flatten",            # N07
    "spec_diff",               # J12
    "dq_report",               # A10
    "cdc_latest",              # W06
    "drop_duplicates",         # W05
    "node_run_summary",        # A13
    "nested_runs",             # W08
    "render_forms",            # F11
    "migration_summary",       # A16
    "dataset_run",             # X03
    "stream_upsert",           # T02
    "stream_node_health",      # T03
    "sync_dynamic_overwrite",  # S14
]
SCALE_OUT = ["table_signal", "log_block_segment", "spec_diff", "dq_report"]
CORPORA = {
    "testbed.artifacts": ["render_triggers", "render_manifests", "render_metadata", "render_factories", "render_pipeline_defs",
                          "render_notebooks", "render_quality_rules", "render_validation_log", "render_raw_output"],
    "testbed.specs": ["render_specs", "render_canonical"],
}


def land_corpora(spark, sf_dir: str, folder: str) -> None:
    """Write every corpus of ``sf_dir`` and let the test bed read the files from now on."""
    import importlib

    from tidewater.sources.tables import Tables

    tables = Tables(spark, sf_dir)
    for module_name, names in CORPORA.items():
        module = importlib.import_module(module_name)
        for name in names:
            render = getattr(module, name)
            render = getattr(render, "renders", render)
            for version in (1, 2) if name == "render_specs" else (None,):
                df = render(tables, version) if version else render(tables)
                df.write.mode("overwrite").parquet(f"{folder}/{name}-{version}")

            def read(t, version=None, name=name):
                return t.spark.read.parquet(f"{folder}/{name}-{version}")

            read.renders = render
            setattr(module, name, read)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    from tidewater.plans import QUERIES
    from tidewater.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app="tidewater-bench")
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]

    def timed(key: str, folder: str) -> float:
        t0 = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    out: dict = {}
    with tempfile.TemporaryDirectory(prefix="tidewater-bench-") as scratch:
        # JVM / JIT warm-up on the smallest tables (not timed, reported as such)
        warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
        if os.path.isdir(warm_dir):
            timed("table_signal", warm_dir)
        small = os.path.join(os.path.dirname(sf_dir), f"sf{sf / 10:g}") if sf else ""
        scale = {}
        if os.path.isdir(small) and "BENCH_QUERIES" not in os.environ:
            land_corpora(spark, small, f"{scratch}/small")
            scale = {key: [timed(key, small)] for key in SCALE_OUT}
        t0 = time.perf_counter()
        land_corpora(spark, sf_dir, f"{scratch}/full")
        out["corpora_sec"] = round(time.perf_counter() - t0, 3)
        times: dict[str, float] = {}
        for key in keys:
            times[key] = timed(key, sf_dir)
            print(f"# {key}: {times[key]}s", file=sys.stderr, flush=True)
        spark.stop()
    out["scale_out"] = {key: [*s, times[key]] for key, s in scale.items() if key in times}
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "warmup": "table_signal@sf0.001 (untimed)"} | out))


if __name__ == "__main__":
    main()
