"""Registry of the engine's own queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The instant that the queries take for now, in UTC; their data is of January 2024.
AS_OF = datetime(2024, 1, 20, 3, 30)

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that DuckDB answers alike."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loaded() -> None:
    from tidewater.plans import catalog, counts, files, history, privacy, replication, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _loaded()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cdc_replay"](spark, sf_dir)
