"""Sources of snapshots, changes and catalogs: thin adapters over Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.names import matching
from tidewater.streaming.batching import rate_options

#: The reader for each kind of source; all but files need the engine's connector among the jars.
FORMATS = {"jdbc": "jdbc", "mysql": "jdbc", "mariadb": "jdbc", "postgresql": "jdbc", "mongodb": "mongodb", "redis": "org.apache.spark.sql.redis", "parquet": "parquet", "json": "json", "csv": "csv", "orc": "orc"}

#: Of a JDBC table: rows of a fetch, and tasks that read it where the options have a partition column and its bounds but no number.
FETCH_ROWS, PARTITIONS = 1000, 32


def snapshot(spark: SparkSession, kind: str, table: str, options: dict[str, str] | None = None, columns: Sequence[str] = (), schema: str | None = None) -> DataFrame:
    """A table as it stands. Columns and later filters are pushed to the source; a JDBC table is split by partitionColumn among the options."""
    reader = spark.read.format(FORMATS[kind])
    if FORMATS[kind] == "jdbc":
        reader = reader.option("fetchsize", FETCH_ROWS)
        if {"partitionColumn", "lowerBound", "upperBound"} <= set(options or {}):
            reader = reader.option("numPartitions", PARTITIONS)
    reader = reader.options(**(options or {}))
    if schema:
        reader = reader.schema(schema)
    if FORMATS[kind] == "jdbc":
        df = reader.option("dbtable", table).load()
    elif kind == "mongodb":
        df = reader.option("collection", table).load()
    elif kind == "redis":
        df = reader.option("keys.pattern", table or "*").load()
    else:
        df = reader.load(table)
    return df.select(*columns) if columns else df


def changes(spark: SparkSession, path: str, schema: str, kind: str = "json", streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A landed change log. As a stream the checkpoint keeps the position, and the source gives out so many files at once, or if not given as many as the bound of bytes allows."""
    if not streaming:
        return spark.read.schema(schema).format(kind).load(path)
    bounds = rate_options() if files_per_trigger is None else rate_options(0, files_per_trigger)
    return spark.readStream.schema(schema).format(kind).options(**bounds).load(path)


def parsed_changes(raw: DataFrame, row: str) -> DataFrame:
    """seq, op, before, after from change events as JSON text in `value`; what is no event has a null op."""
    kind = f"struct<seq:bigint,op:string,before:{row},after:{row}>"
    return raw.select(F.from_json("value", kind).alias("e")).select("e.*")


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def matching_tables(spark: SparkSession, pattern: str, database: str | None = None) -> list[str]:
    return matching(tables(spark, database), pattern)


#: The operators of Spark's parsed plans that a reading statement may have, and functions that run code of any kind.
_READING = (
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Join LateralJoin AsOfJoin Generate Window WithWindowDefinition Union Distinct Except Intersect SubqueryAlias "
    "UnresolvedWith UnresolvedHint OneRowRelation LocalRelation Range Expand Sample Pivot Unpivot Repartition RepartitionByExpression View UnresolvedSubqueryColumnAliases "
    "ShowTables ShowColumns ShowNamespaces ShowTableProperties ShowPartitions ShowViews ShowFunctions ShowCreateTable DescribeRelation DescribeColumn DescribeNamespace DescribeQueryCommand ExplainCommand"
).split()
_RUNNING = ("reflect", "java_method", "try_reflect")


def _nodes(parsed: Any) -> Iterator[dict[str, Any]]:
    """All nodes of a plan as JSON: operators, expressions, and those of subqueries within them."""
    if isinstance(parsed, dict):
        if "class" in parsed:
            yield parsed
        for x in parsed.values():
            yield from _nodes(x)
    elif isinstance(parsed, list):
        for x in parsed:
            yield from _nodes(x)


def check_reading(spark: SparkSession, sql: str) -> None:
    """PermissionError unless the statement is one that only reads, by the plan that Spark's own parser makes of it."""
    try:
        parsed = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    except ParseException as error:
        raise PermissionError(f"only one reading statement is allowed: {error}") from error
    for node in _nodes(parsed):
        package, _, name = node["class"].rpartition(".")
        if package.endswith((".plans.logical", ".execution", ".execution.command", ".execution.datasources")) and name not in _READING:
            raise PermissionError(f"only one reading statement is allowed, not {name}")
        called = node.get("nameParts") or node.get("name") or ""
        if name.startswith("Unresolved") and "Function" in name and any(f in str(called).lower().strip("[]").replace("`", "").split(", ") for f in _RUNNING):
            raise PermissionError("functions that run code are not allowed")


def ask(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, limit: int | None = None) -> DataFrame:
    """A reading statement over the task's tables; anything that writes is refused by what it is, not by words within it.

    views are known to this statement alone: the session's own views of these names are as before after it.
    """
    text = sql.strip().rstrip(";")
    check_reading(spark, text)
    known = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    before = {name: spark.table(name) for name in views or {} if name.lower() in known}
    try:
        for name, df in (views or {}).items():
            df.createOrReplaceTempView(name)
        out = spark.sql(text)  # names are resolved here and now
    finally:
        for name in views or {}:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)
    return out if limit is None else out.limit(limit)
