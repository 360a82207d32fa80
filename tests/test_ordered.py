"""Ordered scans over ranges of rows, against a plain loop; nested runs with nulls and a hot user."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import telemetry as tm
from tidewater.operators.ordered import ordered_scan


def loop(rows):
    """{row number: (running count of flags, last value before)} per key in order."""
    out, state = {}, {}
    for i, k, o, flag, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, r[2] or 0, r[0])):
        n, last = state.get(k, (0, None))
        n += bool(flag)
        out[i] = (n, last)
        state[k] = (n, last if value is None else value)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_scan(spark, ranges):
    rng = random.Random(ranges)
    keys = ["hot"] * 6 + ["a", "b", "c", None, "", "rare"]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(200)]), rng.choice([True, False, None]), rng.choice([None, None, f"v{i}"])) for i in range(700)]
    rows += [(1000 + i, f"k{i}", 1, True, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "i int, k string, o int, flag boolean, value string").repartition(5)
    out = ordered_scan(df, "k", [F.col("o").asc_nulls_last(), F.col("i").asc()], counts={"n": F.col("flag")}, lasts={"last": F.col("value")}, ranges=ranges)
    assert out.columns == ["i", "k", "o", "flag", "value", "n", "last"]
    assert {r.i: (r.n, r["last"]) for r in out.collect()} == loop(rows)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o int")
    assert ordered_scan(df, "k", [F.col("o").asc()], counts={"n": F.lit(True)}, lasts={"l": F.struct("o")}).collect() == []


def test_no_range_holds_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS o")
    seen = []
    kind = type(df)
    real = kind.mapInArrow

    def watched(self, fn, schema, *a, **b):
        seen.append([r[1] for r in self.groupBy(F.spark_partition_id()).count().collect()])
        return real(self, fn, schema, *a, **b)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(kind, "mapInArrow", watched)
        assert ordered_scan(df, "k", [F.col("o").asc()], counts={"n": F.lit(True)}, ranges=20).where("k = 7").agg(F.max("n")).first()[0] == 6668
    assert max(seen[0]) <= 2 * 20_000 / 20, seen[0]


def test_nested_runs_keep_every_row(spark):
    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    rows = [(1, 1, at(0), "start", None), (1, 2, at(1), None, "ok"), (1, 3, at(2), "end", None), (1, 4, at(3), None, "ok"),
            (None, 5, at(0), "start", None), (None, 6, at(1), None, "error"), (2, 7, None, None, "ok"), (2, 8, at(0), "start", None), (2, 9, at(5), None, "ok")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, marker string, status string")
    for ranges in (1, 4, 9):
        out = {r.event_id: (r.user_id, r.run_id, r.standalone) for r in tm.nested_runs(df, ranges).collect()}
        assert out == {2: (1, 1, False), 4: (1, None, True), 6: (None, 5, False), 7: (2, 8, False), 9: (2, 8, False)}
