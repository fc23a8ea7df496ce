"""Queries of table names, schemas, merged exports and ad-hoc statements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import BackupSpec
from tidewater.functions import names
from tidewater.operators import export, schema
from tidewater.plans.registry import AS_OF, query, table
from tidewater.sources import readers

#: Names with the suffixes that tables have.
_NAMES = ("orders_202501", "users_20250115", "logs_2025", "events202501", "products", "analytics_data_123", "logs20250101", "orders_202502", "x_2025_01")
_NAMES_SQL = "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS name)"
_PREFIX_SQL = "CASE " + " ".join(f"WHEN regexp_matches(name, '{s}') THEN regexp_replace(name, '{s}', '')" for s in names.SUFFIXES) + " ELSE name END"


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string")


@query(f"WITH {_NAMES_SQL} SELECT name, {_PREFIX_SQL} AS prefix, r_regionkey FROM names, region")
def table_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select("r_regionkey")
    return region.select("r_regionkey", F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("name")).select("name", names.prefix_column(F.col("name")).alias("prefix"), "r_regionkey")


@query(f"WITH {_NAMES_SQL} SELECT {_PREFIX_SQL} AS prefix, string_agg(name, ',' ORDER BY name) AS members FROM names GROUP BY 1")
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _names(spark).groupBy(names.prefix_column(F.col("name")).alias("prefix")).agg(F.sort_array(F.collect_list("name")).alias("m"))
    return grouped.select("prefix", F.array_join("m", ",").alias("members"))


_MONTHS_SQL = "SELECT event_id, event_type, ts, 'events_' || strftime(ts, '%Y%m%d') AS table_name FROM events"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("table_name", F.concat(F.lit("events_"), F.date_format("ts", "yyyyMMdd")))


@query(f"WITH e AS ({_MONTHS_SQL}) SELECT DISTINCT table_name, strptime(right(table_name, 8), '%Y%m%d')::DATE AS day FROM e WHERE table_name BETWEEN 'events_20240115' AND 'events_20240118'")
def table_time_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily tables that a range meets, with the day that their names tell."""
    wanted = (datetime(2024, 1, 15, 12), datetime(2024, 1, 18))
    kept = names.prune([f"events_202401{d:02d}" for d in range(1, 31)], wanted)
    found = _daily(spark, sf_dir).select("table_name").distinct().where(F.col("table_name").isin(kept))
    return found.select("table_name", names.partition_day(F.col("table_name")).alias("day"))


@query("""
SELECT event_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value END AS value FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'
""")
def merged_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two half-month tables as one export; the second lacks a field."""
    e = table(spark, sf_dir, "events")
    parts = {"events_20240101": e.where("ts < TIMESTAMP_NTZ '2024-01-16' AND ts >= TIMESTAMP_NTZ '2024-01-01'"), "events_20240116": e.where("ts >= TIMESTAMP_NTZ '2024-01-16' AND ts < TIMESTAMP_NTZ '2024-01-31'")}
    click = {"event_type": "click"}
    spec = BackupSpec(patterns=("^events_",), query=dict.fromkeys(parts, click), fields={"events_20240101": ["event_id", "event_type", "value"], "events_20240116": ["event_id", "event_type"]})
    (group,) = export.table_groups(list(parts), spec, AS_OF).values()
    return export.merged(group, parts.__getitem__, spec, AS_OF)


@query("SELECT event_id, user_id, ts FROM events")
def field_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selected(table(spark, sf_dir, "events"), ["event_id", "user_id", "ts"])


@query("SELECT r_regionkey, r_name FROM region")
def field_selection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selected(table(spark, sf_dir, "region"), ["all"])


@query("""
SELECT * FROM (VALUES ('event_id', 'int', true), ('event_type', 'string', false), ('props', 'object', false), ('props.k', 'int', false), ('user', 'object', false),
  ('user.id', 'int', false), ('user.seen', 'array', false), ('value', 'float', false)) AS t(field, type, is_primary)
""")
def schema_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"), F.struct(F.col("user_id").alias("id"), F.array("ts").alias("seen")).alias("user"))
    return schema.described_frame(spark, e, ["event_id"])


@query("SELECT * FROM (VALUES ('k', 'int')) AS t(field, type)")
def schema_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a column of JSON texts, from all of them."""
    return spark.createDataFrame(schema.flattened(schema.document_schema(table(spark, sf_dir, "events"), "props")), "field string, type string")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def schema_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.sampled(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type")


@query("SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last_update FROM orders GROUP BY o_orderpriority")
def adhoc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading statement; that a name holds the word update makes it no write."""
    return readers.ask(spark, "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last_update FROM orders GROUP BY o_orderpriority", {"orders": table(spark, sf_dir, "orders")})


@query("SELECT event_id, (event_id * 1048576 + 15)::DECIMAL(20,0) AS lsn FROM events")
def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") * 1048576 + 15
    text = F.concat_ws("/", F.hex(F.shiftright(at, 32)), F.hex(at.bitwiseAND((1 << 32) - 1)))
    return table(spark, sf_dir, "events").select("event_id", names.lsn_column(text).alias("lsn"))


@query("SELECT n_nationkey, n_name || chr(9) || 'a\\b' || chr(10) AS cell FROM nation")
def unescape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.col("n_name"), F.lit("\\ta\\\\b\\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.unescape_tsv(cell).alias("cell"))
