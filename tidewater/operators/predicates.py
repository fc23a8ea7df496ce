"""Conditions of counts and exports as column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from tidewater.config import CountCondition
from tidewater.functions.clock import named_range, offset_range, within
from tidewater.functions.names import clean_quotes

OPERATORS = ("=", ">", ">=", "<", "<=", "!=", "<>", "dateRange")


#: What reads as a number in a condition; underscores, infinities and the like do not.
_WHOLE, _NUMBER = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def literal(value: str) -> int | float | str:
    """A condition's value: a whole number of 64 bits if it reads as one, else a number, else the text."""
    if _WHOLE.fullmatch(value) and -(1 << 63) <= int(value) < 1 << 63:
        return int(value)
    return float(value) if _NUMBER.fullmatch(value) else value


def _compared(column: Column, kind: Any, value: str) -> tuple[Column, Column]:
    """Column and literal of one type: with a string column the value as it is written, zeros and exponents among it."""
    if isinstance(kind, StringType):
        return column, F.lit(value)
    made = literal(value)
    if isinstance(kind, NumericType) and isinstance(made, str):
        return column.cast("string"), F.lit(made)
    return column, F.lit(made)


def condition(c: CountCondition, schema: StructType, as_of: datetime) -> Column | None:
    """The predicate of one condition; None for one without a value or range."""
    if c.operator not in OPERATORS:
        raise ValueError(f"unknown operator {c.operator!r}")
    column = F.col(f"`{c.field}`" if c.field in schema.names else c.field)
    if c.operator == "dateRange":
        bounds = named_range(c.value, as_of)
        return None if bounds is None else within(column, bounds)
    if c.value == "":
        return None
    left, right = _compared(column, schema[c.field].dataType if c.field in schema.names else None, c.value)
    return {
        "=": lambda: left == right, ">": lambda: left > right, ">=": lambda: left >= right, "<": lambda: left < right,
        "<=": lambda: left <= right, "!=": lambda: ~left.eqNullSafe(right), "<>": lambda: ~left.eqNullSafe(right),
    }[c.operator]()


def predicate(conditions: Iterable[CountCondition], schema: StructType, as_of: datetime, table: str = "") -> Column:
    """All conditions for the table at once; of several on one field the last holds. A missing value differs from any other."""
    by_field: dict[str, Column] = {}
    for c in conditions:
        if c.table and table and c.table != table:
            continue
        made = condition(c, schema, as_of)
        if made is not None:
            by_field[c.field] = made
    out = F.lit(True)
    for made in by_field.values():
        out = out & made
    return out


def count_where(df: DataFrame, conditions: Iterable[CountCondition], as_of: datetime, table: str = "") -> DataFrame:
    """One row: n. Without conditions no column is read."""
    return df.where(predicate(conditions, df.schema, as_of, table)).agg(F.count(F.lit(1)).alias("n"))


def safe_count(df: DataFrame | None) -> int:
    """The number of rows, -1 where they cannot be counted."""
    from pyspark.errors import PySparkException

    try:
        return -1 if df is None else df.count()
    except PySparkException:
        return -1


def rendered(conditions: Iterable[CountCondition], table: str = "") -> str:
    """Conditions as one line for logs, fields in order."""
    last = {c.field: c for c in conditions if not (c.table and table and c.table != table) and c.value != ""}
    return " AND ".join(f"{c.field} {c.operator} {c.value}" for _, c in sorted(last.items())) or "all rows"


def export_predicate(query: dict[str, Any], as_of: datetime) -> Column:
    """An export's conditions: {field: value} by equality, {field: {type: daily, startOffset, endOffset}} by days."""
    out = F.lit(True)
    for field, value in clean_quotes(query).items():
        column = F.col(field)
        if isinstance(value, dict) and value.get("type") == "daily":
            out = out & within(column, offset_range(as_of, value.get("startOffset"), value.get("endOffset")))
        elif isinstance(value, (str, int, float)) and not isinstance(value, bool):
            out = out & (column == F.lit(value))
        else:
            raise ValueError(f"unsupported condition on {field!r}: {value!r}")
    return out


def export_range(query: dict[str, Any], as_of: datetime) -> tuple[datetime, datetime] | None:
    """The widest range that the daily conditions allow; tables outside hold no row of the export."""
    ranges = [offset_range(as_of, v.get("startOffset"), v.get("endOffset")) for v in clean_quotes(query).values() if isinstance(v, dict) and v.get("type") == "daily"]
    return (max(r[0] for r in ranges), min(r[1] for r in ranges)) if ranges else None
