"""Query registry: every implemented inventory row registers a Spark builder
``(spark, sf_dir) -> DataFrame`` and, when the semantics are SQL-expressible,
an independent DuckDB SQL oracle over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
INVENTORY_ID: dict[str, str] = {}


def query(inv_id: str, key: str, oracle: str | None = None):
    """Register ``fn`` under ``key`` (the SURVEY query key); ``inv_id`` is the
    inventory row (e.g. ``N05``)."""

    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        INVENTORY_ID[key] = inv_id
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return deco
