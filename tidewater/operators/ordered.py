"""Scans in order over ranges of rows: running counts and carried values.

A window over a whole key puts a hot key (one user, one long log) in one task.  Here the
rows are range-partitioned by (key, order), so that every task gets about the same number
of rows whoever owns them, and read once in order.  What a range needs from the ranges
before it is one row each: every task appends the state at its end, those rows (one per
range) are folded in order, and the carry that each range starts with goes back by a
broadcast of as many rows.  No row is joined, and null keys are a key like any other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# executors get this module's code with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

META = ["_range", "_first", "_tail", "_single"]


def _codes(column) -> np.ndarray:
    codes = column.dictionary_encode(null_encoding="encode")
    return codes.indices.to_numpy(zero_copy_only=False)


def _scan(key: int, counts: dict[str, int], lasts: dict[str, int], width: int, names: list[str]):
    """The task: batches sorted by key and order in, the same rows with the state within the
    range out, and one row for the state at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        state: dict = {}
        begun, segments, schema, now = False, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = batch.schema
            k = batch.column(key)
            fresh = np.ones(n, bool)
            codes = _codes(k)
            fresh[1:] = codes[1:] != codes[:-1]
            fresh[0] = not begun or k[0].as_py() != now
            if fresh[0]:
                state = {}
            start = np.flatnonzero(fresh)
            segment = np.cumsum(fresh)  # 0: the key that goes on from the batch before
            at = np.arange(n)
            head = np.where(segment > 0, np.append(start, 0)[segment - 1], 0)
            out = []
            for name, source in counts.items():
                flag = batch.column(source).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(flag)
                running = total - (total - flag)[head] + np.where(segment == 0, state.get(name, 0), 0)
                state[name] = int(running[-1])
                out.append(pa.array(running))
            for name, source in lasts.items():
                value = batch.column(source)
                seen = np.maximum.accumulate(np.where(value.is_valid().to_numpy(zero_copy_only=False), at, -1))
                before = np.concatenate([[-1], seen[:-1]])
                held = pa.concat_arrays([value, pa.array([state.get(name), None], value.type)])
                inside = before >= head
                out.append(held.take(pa.array(np.where(inside, before, np.where(segment == 0, n, n + 1)))))
                if seen[-1] >= head[-1]:
                    state[name] = value[int(seen[-1])].as_py()
                elif segment[-1] > 0:
                    state[name] = None
            first = segments + segment - (0 if begun else 1) == 0
            segments += int(segment[-1]) - (0 if begun else 1)
            begun, now = True, k[n - 1].as_py()
            meta = [pa.array(np.full(n, number, np.int32)), pa.array(first), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, *meta], names)
        if begun:
            tail = [pa.array([now if i == key else None], schema.field(i).type) for i in range(width)]
            tail += [pa.array([state.get(c, 0)], pa.int64()) for c in counts] + [pa.array([state.get(c)], schema.field(s).type) for c, s in lasts.items()]
            tail += [pa.array([number], pa.int32()), pa.array([False]), pa.array([True]), pa.array([segments == 0])]
            yield pa.RecordBatch.from_arrays(tail, names)

    return task


def ordered_scan(df: DataFrame, key: str, order: list[str | Column], counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
                 ranges: int | None = None) -> DataFrame:
    """``df`` with, per ``key`` in the ``order`` of its rows, ``counts`` (how often the condition held
    up to and with this row) and ``lasts`` (the last non-null value strictly before this row).

    ``ranges`` is the number of ranges the rows are dealt to (default: the session's shuffle
    partitions); a range holds about a ``ranges``-th of all rows, however they share keys.
    Rows equal in key and order may be read in either order."""
    spark, counts, lasts = df.sparkSession, counts or {}, lasts or {}
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc(), *order]
    flags = {f"_flag_{n}": c for n, c in counts.items()} | {f"_value_{n}": c for n, c in lasts.items()}
    rows = df.select("*", *(c.alias(n) for n, c in flags.items())).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    place = {n: i for i, n in enumerate(rows.columns)}
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    kinds = [T.StructField(n, T.LongType()) for n in counts] + [T.StructField(n, rows.schema[f"_value_{n}"].dataType) for n in lasts]
    meta = [T.StructField("_range", T.IntegerType()), *(T.StructField(n, T.BooleanType()) for n in META[1:])]
    schema = T.StructType([*fields, *kinds, *meta])
    task = _scan(place[key], {n: place[f"_flag_{n}"] for n in counts}, {n: place[f"_value_{n}"] for n in lasts}, len(fields), schema.names)
    path = scratch_path(spark, "ordered-scan")
    rows.mapInArrow(task, schema).drop(*flags).write.parquet(path)
    held = spark.read.schema(T.StructType([f for f in schema.fields if f.name not in flags])).parquet(path)

    carries, now = [], None  # (key, state) with which the next range starts
    for r in sorted(held.where("_tail").select(key, *counts, *lasts, "_range", "_single").collect(), key=lambda r: r["_range"]):  # a row a range
        goes_on = now is not None and now[0] == r[key] and r["_single"]
        if now is not None:
            carries.append((r["_range"], True, *now))
        now = (r[key], *(r[n] + (now[1 + i] if goes_on else 0) for i, n in enumerate(counts)),
               *(now[1 + len(counts) + i] if goes_on and r[n] is None else r[n] for i, n in enumerate(lasts)))
    known = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_has", T.BooleanType()), T.StructField("_key", df.schema[key].dataType),
                          *(T.StructField(f"_c_{f.name}", f.dataType) for f in kinds)])
    rows = held.where("not _tail").join(F.broadcast(spark.createDataFrame(carries, known)), "_range", "left")
    mine = F.col("_first") & F.coalesce("_has", F.lit(False)) & F.col(key).eqNullSafe(F.col("_key"))
    found = {n: F.col(n) + F.when(mine, F.col(f"_c_{n}")).otherwise(F.lit(0)) for n in counts} | {n: F.coalesce(n, F.when(mine, F.col(f"_c_{n}"))) for n in lasts}
    return rows.select(*df.columns, *(c.alias(n) for n, c in found.items()))
