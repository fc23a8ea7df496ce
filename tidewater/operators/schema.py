"""Schemas as flat lists of fields, and those of documents without one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DateType, FractionalType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType,
)


def type_name(kind: DataType) -> str:
    """The names that the console shows for types of documents; others by their own name."""
    for name, kinds in {
        "int": IntegralType, "float": FractionalType, "string": StringType, "bool": BooleanType, "date": (DateType, TimestampType, TimestampNTZType),
        "object": (StructType, MapType), "array": ArrayType, "null": NullType,
    }.items():
        if isinstance(kind, kinds):
            return name
    return kind.typeName()


def flattened(schema: StructType, lead: str = "") -> list[tuple[str, str]]:
    """(dotted name, type) of every field, an object before its own fields."""
    out = []
    for f in schema.fields:
        out.append((lead + f.name, type_name(f.dataType)))
        if isinstance(f.dataType, StructType):
            out += flattened(f.dataType, f"{lead}{f.name}.")
    return out


def described(df: DataFrame, keys: Sequence[str] = ()) -> list[tuple[str, str, bool]]:
    """(name, type, primary): key fields first, then by name."""
    found = dict(flattened(df.schema))
    return sorted(((n, t, n in keys) for n, t in found.items()), key=lambda x: (not x[2], x[0]))


def described_frame(spark: SparkSession, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return spark.createDataFrame(described(df, keys), "field string, type string, is_primary boolean")


def document_schema(docs: DataFrame, column: str) -> StructType:
    """The schema of JSON documents, merged over all of them in one distributed aggregation."""
    found = docs.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"]
    text = found.replace("OBJECT<", "STRUCT<").replace("DECIMAL(", "DECIMAL(")
    made = docs.sparkSession.sql(f"SELECT CAST(NULL AS {text}) AS x").schema["x"].dataType if found != "VOID" else StructType()
    return made if isinstance(made, StructType) else StructType()


def sampled(df: DataFrame, order: str, rows: int = 10) -> DataFrame:
    """The last rows by an order column, to look at."""
    return df.orderBy(F.desc(order)).limit(rows)


def empty_like(df: DataFrame) -> DataFrame:
    """A table's structure without its rows."""
    return df.sparkSession.createDataFrame([], df.schema)


def clone_table(df: DataFrame, name: str, keys: Sequence[str] = (), buckets: int = 0) -> None:
    """Create the table where it does not exist; key columns may bucket and sort it in place of an index."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        return
    writer = empty_like(df).write
    if keys and buckets:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(name)
