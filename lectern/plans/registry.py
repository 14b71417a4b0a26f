"""All registered queries and oracles of the engine.

A query is a function (spark, sf_dir) -> DataFrame; next to it stands the SQL
that DuckDB runs on the same tables, where SQL can express it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_FAMILIES = ("text", "retrieval", "relational", "evaluation", "graph", "documents", "views", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


#: Tables whose rows take long to work on.
_HEAVY = {"documents", "embeddings", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a heavy one in fewer pieces than there are cores (one small file) is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"lectern.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
