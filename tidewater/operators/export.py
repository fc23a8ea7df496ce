"""Filtered, projected, pruned exports of groups of date-suffixed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewater.config import BackupSpec
from tidewater.functions.names import grouped, matching, prune
from tidewater.operators.predicates import export_predicate, export_range


def selected(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """The named fields; all where the list is empty or begins with all or *."""
    return df if not fields or fields[0] in ("all", "*") else df.select(*fields)


def table_groups(names: Sequence[str], spec: BackupSpec, as_of: datetime) -> dict[str, list[str]]:
    """Tables to export by group: those of patterns by their prefix, those named outright together only if all share one."""
    out: dict[str, list[str]] = {}
    for pattern in spec.patterns:
        for lead, members in grouped(matching(names, pattern)).items():
            out.setdefault(lead, []).extend(m for m in members if m not in out.get(lead, []))
    if spec.tables:
        groups = grouped(spec.tables)
        out.update(groups if len(groups) == 1 else {t: [t] for t in spec.tables})
    query = lambda members: next((spec.query[m] for m in members if m in spec.query), {})
    return {lead: prune(members, export_range(query(members), as_of)) for lead, members in out.items()}


def merged(tables: Sequence[str], read: Callable[[str], DataFrame], spec: BackupSpec, as_of: datetime) -> DataFrame:
    """One export of several tables: each filtered and projected by its own settings, fields that some lack as null."""
    parts = [selected(read(t).where(export_predicate(spec.query.get(t, {}), as_of)), spec.fields.get(t)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def quoted(column: Column, df: DataFrame, name: str) -> Column:
    """A value as an SQL literal."""
    text = column.cast("string")
    if isinstance(df.schema[name].dataType, NumericType):
        return F.coalesce(text, F.lit("NULL"))
    escaped = text
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\u0000", "\\0")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT a row, as text."""
    values = F.concat_ws(", ", *[quoted(F.col(f"`{c}`"), df, c) for c in df.columns])
    head = f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), values, F.lit(");")).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, fields without value left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write(df: DataFrame, path: str, spec: BackupSpec, table: str = "", **options: Any) -> None:
    """Files of the export, as many as its partitions: nothing passes through one task or the driver."""
    writer = df.write.options(compression=spec.compression, **options)
    if spec.format == "json":
        writer.json(path)
    elif spec.format == "csv":
        writer.options(header=True, quoteAll=True, nullValue="", emptyValue="", escape='"').csv(path)
    else:
        insert_statements(df, table).write.options(compression=spec.compression).text(path)


def run(names: Sequence[str], read: Callable[[str], DataFrame], spec: BackupSpec, as_of: datetime, path: str) -> dict[str, str]:
    """Export every group into a folder of its own; a group that fails does not keep the others from it. Group: done or the error."""
    from pyspark.errors import PySparkException

    said = {}
    for lead, members in table_groups(names, spec, as_of).items():
        try:
            write(merged(members, read, spec, as_of), f"{path}/{lead}", spec, lead)
            said[lead] = "done"
        except (PySparkException, ValueError) as error:
            said[lead] = str(error)
    return said


def read_json_lines(spark: Any, path: str, schema: str | None = None) -> DataFrame:
    """An export's JSON lines; lines that are no objects are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def record_count(spark: Any, path: str) -> int:
    """How many records an export of JSON lines holds; blank lines are none."""
    return spark.read.text(path).where(F.trim("value") != "").count()
