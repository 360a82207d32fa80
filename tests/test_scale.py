"""Plans and results that keep their cost per row as the tables grow (findings of round 3)."""

import base64
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from testbed import artifacts as tb
from testbed import specs as sb
from tidewater.operators import artifacts as ar
from tidewater.operators import manifest as mf
from tidewater.operators import signals as sg
from tidewater.operators import specs as sp
from tidewater.operators.datasets import cdc_latest
from tidewater.session import configure


class Rows:
    """Driver tables of a test's own rows."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(k, 1, "F", "1994-01-02", "1-URGENT") for k in (1, 2, 3)]
    lines = [(k, 10 + n, 3, n, 1.0, 2.0, 0.1, 0.1, "N", "O", "1994-02-03") for k in (1, 2, None) for n in (2, 1)]
    return Rows(
        orders=spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string"),
        customer=spark.createDataFrame([(1, 4, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        nation=spark.createDataFrame([(4, 2)], "n_nationkey int, n_regionkey int"),
        region=spark.createDataFrame([(2, "ASIA")], "r_regionkey int, r_name string"),
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                       "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"))


@pytest.fixture(scope="module")
def part(spark):
    return Rows(part=spark.createDataFrame([(k, f"name {k}", "TYPE", k) for k in range(1, 9)], "p_partkey long, p_name string, p_type string, p_size int"))


def test_long_stages_are_compiled(spark):
    """Every query: a method of more than 8,000 bytes of bytecode is never compiled."""
    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_lines_are_shuffled_before_they_are_rendered(spark, orders):
    configure(spark)
    found = tb.render_triggers(orders)
    text = plan(found)
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(o_orderkey" in text
    assert "hashpartitioning(trigger_id" not in text and "BroadcastExchange" not in text.split("SortAggregate")[-1]
    bodies = {r.trigger_id: r.body for r in found.collect()}
    assert sorted(bodies) == [1, 2, 3]
    assert [bodies[k].count("load_to_bronze") for k in (1, 2, 3)] == [2, 2, 0]
    assert bodies[1].index("t_0") < bodies[1].index("t_2")  # line 1 before line 2


def test_parts_are_dealt_out_before_they_are_rendered(spark, part):
    for version in (1, 2):
        assert "hashpartitioning(p_partkey" in plan(sb.render_specs(part, version))
    assert "hashpartitioning(p_partkey" in plan(sb.render_canonical(part))


def test_include_files_are_never_broadcast(spark, part):
    """sections and files rendered from few bytes outgrew a broadcast."""
    from testbed import trees as tr

    out = sp.task_includes(sp.parse_specs(sb.render_specs(part, 1)), tr.include_files(part))
    assert "Broadcast" not in plan(out)
    assert "Broadcast" not in plan(sp.task_dataset_join(sp.parse_specs(sb.render_specs(part, 1))))
    assert {r.outcome for r in out.collect()} >= {"found", "missing"}


def test_payloads_are_cleaned_once(spark):
    good = base64.b64encode("größe".encode()).decode()
    odd = {"ok": good, "noisy": "!!" + good + " -", "short": "QQ", "padded": "QQ==", "one": "QUJDR", "three": "QUI=", "lacks": "QUI", "after": "QUI=zz", "none": "",
           "bytes": base64.b64encode(b"\xc3\x28").decode(), "pads": "QUJD====", "dir": None}
    files = spark.createDataFrame([("r", "m", k, "dir" if v is None else "file", v) for k, v in odd.items()], "repo string, ref string, path string, type string, content_b64 string")
    asked = spark.createDataFrame([("r", "m", k) for k in [*odd, "gone"]], "repo string, ref string, path string")
    out = ar.decode_files(files, asked)
    assert plan(out.select("outcome", F.md5("text"))).count("regexp_replace(") == 1
    got = {r.path: (r.outcome, r.text) for r in out.collect()}
    bad = ("bad_payload", None)
    assert got == {"ok": ("ok", "größe"), "noisy": ("ok", "größe"), "short": bad, "padded": ("ok", "A"), "one": bad, "three": ("ok", "AB"), "lacks": bad,
                   "after": ("ok", "AB"), "none": ("ok", ""), "bytes": bad, "pads": ("ok", "ABC"), "dir": ("directory", None), "gone": ("not_found", None)}


def test_changes_are_aggregated_once(spark):
    """The aggregate of W06 and T02 holds a row once, and the raw commit time comes back."""
    rows = [(1, "2024-01-01 00:00:00", 1, "U", "a"), (1, "2024-01-01 00:00", 2, "U", "b"), (1, None, 9, "U", "c"), (2, "2024-01-01 00:00", 1, "U", "a"),
            (2, "2024-01-02 00:00", 1, "D", "a"), (None, "x", 1, None, None)]
    out = cdc_latest(spark.createDataFrame(rows, "k int, ts string, seq int, op string, v string"), ["k"], "ts", "seq", "op")
    assert "max_by" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "2024-01-01 00:00", 2, "U", "b"), (None, "x", 1, None, None)]


def test_forms_build_their_maps_once(spark):
    import __spark_entry__ as e

    assert plan(e.queries()["render_forms"](spark, "/root/testdata/sf0.001")).count("map(zone") <= 2


def test_buckets_are_shuffled_once(spark, tmp_path):
    """the rows of a batch go to their bucket's tasks once; the newest row of a key wins there."""
    from tidewater.streaming.buckets import manifest, stream_upsert_buckets

    src, schema = str(tmp_path / "src"), "k INT, ts STRING, seq INT, op STRING"
    for n in (1, 2):
        spark.createDataFrame([(k, f"2024-01-0{n} 00:00", n, "D" if k == 3 and n == 2 else "U") for k in range(0, 40, n)], schema).write.mode("append").parquet(src)
        out = stream_upsert_buckets(spark, src, schema, str(tmp_path / "target"), str(tmp_path / "ckpt"), ["k"], "ts", "seq", "op", buckets=4)
    assert sorted((r.k, r.seq) for r in out.collect()) == [(k, 2 if k % 2 == 0 else 1) for k in range(40)]
    assert set(manifest(spark, str(tmp_path / "target"))) <= set(range(4))


def test_a_core_gets_several_tasks(spark):
    """a left-over task doubled the time of a stage of one task a core."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
    configure(spark)
    assert int(spark.conf.get(key)) >= 4 * spark.sparkContext.defaultParallelism
    configure(spark, documents=False)
    assert spark.conf.get(key, None) is None
    configure(spark)


def test_documents_nobody_uses_are_not_parsed(spark, orders):
    """table names need neither manifests' nor metadata's documents; their rows still join."""
    configure(spark)
    items = sg.explode_items(sg.trigger_header(sg.parse_triggers(tb.render_triggers(orders))))
    found = sg.table_signal(items, tb.render_manifests(orders), tb.render_metadata(orders))
    names = found.where("target_layer = 'brz'").select("trigger_id", "target_entity", "table_name")
    assert "Python" not in plan(names) and "Python" in plan(found)
    assert sorted(r.trigger_id for r in names.collect()) == sorted(r.trigger_id for r in found.where("target_layer = 'brz'").collect()) != []


def test_notebook_texts_are_not_shuffled(spark):
    """F16: what is asked of a text is taken before the join, and keys are made distinct once."""
    items = spark.createDataFrame([(1, "r-repo-adf", "a.py", "b.py"), (2, "r-repo-adf", "a.py", None)],
                                  "trigger_id long, repo string, notebook_path_brz string, notebook_path_slv string")
    books = spark.createDataFrame([("r-repo-adb", "a.py", "text")], "repo string, path string, content string")
    out = ar.attach_notebooks(ar.item_scripts(items, "repo_adb", "path"), books, F.md5)
    text = plan(out)
    assert text.index("Join") < text.index("md5(cast(content") and text.count("HashAggregate") == 2
    whole = ar.attach_notebooks(ar.item_scripts(items), books)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.withColumn("content", F.md5("content")).collect()))
    assert {r.path: r.found for r in out.collect()} == {"a.py": True, "b.py": False}


def test_scripts_are_counted_in_one_pass(spark, orders):
    """the triggers are rendered once; every document of a trigger has a row, also without items."""
    configure(spark)
    twice = Rows(**(orders.__dict__ | {"orders": orders.orders.unionAll(orders.orders.where("o_orderkey <> 2"))}))
    header = sg.trigger_header(sg.parse_triggers(tb.render_triggers(twice)))
    out = ar.script_counts(sg.explode_items(header, outer=True).where("status = 'ok'"))
    assert plan(out).count("from_json(") == 1 and plan(out).count("Exchange hashpartitioning(l_orderkey") == 1
    items = sg.explode_items(header).where("status = 'ok'")
    n = {r.trigger_id: r.n for r in ar.item_scripts(items).groupBy("trigger_id").agg(F.count_distinct("path").alias("n")).collect()}
    assert sorted(map(tuple, out.collect())) == sorted((k, n.get(k, 0)) for k in (1, 1, 2, 3, 3))


def test_statuses_are_never_broadcast(spark):
    """the statuses of all triggers were brought to the driver."""
    good, other = ('{"pipeline_info": {"repo_name": "r", "trigger_name": "t"}, "source_platform": "%s"}' % p for p in ("platform_3_0", "cobos"))
    manifests = spark.createDataFrame([(1, good), (1, good), (2, other), (3, ""), (4, good), (None, good)], "trigger_id long, body string")
    status = spark.createDataFrame([(1, "ok", 2), (2, "ok", 2), (3, "ok", 2), (9, "ok", 2), (None, "ok", 2)], "trigger_id long, status string, n_items long")
    out = mf.extraction_job(manifests, status)
    rows = sorted(map(tuple, out.collect()), key=str)
    assert "Broadcast" not in plan(out).split("Initial Plan")[0]  # the plan that ran
    assert rows == [(1, "ok", 2), (1, "ok", 2), (2, "unsupported_platform", 0), (3, "invalid_input", 0), (4, None, 0), (None, None, 0)]
