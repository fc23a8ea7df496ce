"""Queries that write to the shared store and read back: exports, buffers, logs, tables, and functions of settings."""

from __future__ import annotations

import logging
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import BackupSpec, PiiRule
from tidewater.functions import clock, names
from tidewater.operators import changes, export, predicates, schedule, schema
from tidewater.plans.registry import AS_OF, query, table
from tidewater.plans.replication import _OP_SQL, _op
from tidewater.sources import readers, writers
from tidewater.sources.keyvalue import KeyValueSource
from tidewater.sources.store import shared_folder
from tidewater.streaming.batching import bounded_prefix, estimated
from tidewater.streaming.log import LogTable


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"), "o_totalprice")


_ORDERS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note, o_totalprice FROM orders"


@query(_ORDERS_SQL)
def export_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines of an export, read back."""
    path = shared_folder(spark, "export")
    export.write(_orders(spark, sf_dir), path, BackupSpec(format="json", compression="gzip"))
    return export.read_json_lines(spark, path, "o_orderkey bigint, note string, o_totalprice double")


@query(_ORDERS_SQL)
def export_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "export")
    export.write(_orders(spark, sf_dir), path, BackupSpec(format="csv"))
    back = spark.read.option("header", True).option("escape", '"').schema("o_orderkey bigint, note string, o_totalprice double").csv(path)
    return back.withColumn("note", F.nullif("note", F.lit("")))


@query("SELECT count(*) AS n FROM orders")
def export_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "export")
    export.write(_orders(spark, sf_dir), path, BackupSpec(format="json"))
    return spark.createDataFrame([(export.record_count(spark, path),)], "n bigint")


@query(
    "SELECT 'late' AS lead, event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-18 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00' "
    "UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation"
)
def backup_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole export of two groups, one filtered, a third that fails and keeps neither from it."""
    read = {"late": table(spark, sf_dir, "events"), "nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("event_id"), F.col("n_name").alias("event_type")), "lost": spark.range(1)}
    spec = BackupSpec(tables=tuple(read), query={"late": {"event_type": "'click'", "ts": {"type": "daily"}}, "lost": {"nothing": 1}}, fields={"late": ["event_id", "event_type"]})
    path = shared_folder(spark, "backup")
    said = export.run([], read.__getitem__, spec, AS_OF, path)
    done = [export.read_json_lines(spark, f"{path}/{lead}", "event_id bigint, event_type string").withColumn("lead", F.lit(lead)) for lead, how in said.items() if how == "done"]
    return done[0].unionAll(done[1]).select("lead", "event_id", "event_type")


@query(f"SELECT event_id AS seq, {_OP_SQL} AS op, user_id, value FROM events")
def buffered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log landed as JSON lines, a row of them being no event."""
    row = "struct<user_id:bigint,value:double>"
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _op().alias("op"), F.struct("user_id", "value").alias("after"))
    path = shared_folder(spark, "buffer")
    export.json_lines(e).unionAll(spark.createDataFrame([("no event",)], "value string")).write.text(path)
    found = readers.parsed_changes(readers.changes(spark, path, "value string", "text"), row)
    return found.where("op is not null").select("seq", "op", "after.user_id", "after.value")


@query("SELECT 'user:' || c_custkey AS key, 'string' AS type, c_custkey * 10 AS ttl_ms, c_name AS value FROM customer WHERE c_custkey::VARCHAR LIKE '1%'")
def key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of a key-value store, of which the keys with a prefix are read."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("key"), (F.col("c_custkey") * 10).alias("ttl_ms"), F.col("c_name").alias("value"))
    path = shared_folder(spark, "dump")
    export.json_lines(c).write.text(path)
    spark.dataSource.register(KeyValueSource)
    return spark.read.format("keyvalue").option("prefix", "user:1").load(path)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "target")
    for _ in range(2):
        writers.append(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "parquet", path, partitions=1)
    return readers.snapshot(spark, "parquet", path, columns=["r_regionkey", "r_name"])


@query("SELECT 'orders' AS src_table, count(*) AS src_row_count, 'lost' AS tgt_table, -1::BIGINT AS tgt_row_count, 'daily_check' AS monitor_action FROM orders UNION ALL SELECT 'orders', count(*), 'lost', -1, 'row_count_minutely' FROM orders")
def monitoring_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comparisons of a task whose target cannot be read, in the monitoring log."""
    from tidewater.config import TableMapping, Task

    path, task = shared_folder(spark, "monitoring"), Task(1, "mysql", mappings=(TableMapping("orders", "lost"),))
    for daily in (False, True):
        schedule.append(schedule.compare(spark, task, lambda name: table(spark, sf_dir, name), lambda name: table(spark, sf_dir, name), AS_OF, daily), path)
    return spark.read.schema(schedule.LOG).parquet(path).select("src_table", "src_row_count", "tgt_table", "tgt_row_count", "monitor_action")


@query("SELECT * FROM (VALUES ('info', 'task started', 3), ('error', 'lost connection', 0)) AS t(level, message, sync_task_id)")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "log")
    handler, logger = LogTable(spark, path), logging.Logger("tidewater.plans")
    logger.addHandler(handler)
    logger.info("task %s", "started", extra={"sync_task_id": 3})
    logger.error("lost connection")
    handler.close()
    return spark.read.parquet(path).select("level", "message", "sync_task_id")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', true, 0), ('r_name', 'string', false, 0)) AS t(field, type, is_primary, n)")
def cloned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of a table made anew, twice, without its rows; the catalog finds it by a pattern."""
    name = "tidewater_" + shared_folder(spark, "clone").rpartition("-")[2]
    try:
        for _ in range(2):
            schema.clone_table(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), name, ["r_regionkey"], 2)
        (found,) = readers.matching_tables(spark, f"^{name}$")
        rows = [(*r, spark.table(found).count()) for r in schema.described(spark.table(found), ["r_regionkey"])]
        return spark.createDataFrame(rows, "field string, type string, is_primary boolean, n int")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""
WITH e AS (SELECT event_id AS seq, user_id, CASE event_type WHEN 'error' THEN 'del' WHEN 'view' THEN 'expired' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'hset' ELSE 'lpush' END AS message FROM events)
SELECT seq, 'user:' || user_id AS key, CASE message WHEN 'expired' THEN 'del' WHEN 'lpush' THEN 'copy' ELSE message END AS op FROM e
""")
def keyspace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of a key-value store as events of its keys; those of another database are left out."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "view", "expired").when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "signup", "hset").otherwise("lpush")
    raw = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("__keyspace@0__:user:"), "user_id").alias("channel"), said.alias("message"))
    other = raw.withColumn("channel", F.concat(F.lit("__keyspace@1__:user:"), F.col("seq").cast("string")))
    return changes.keyspace_events(raw.unionAll(other))


@query("""
SELECT * FROM (VALUES ('placeholders', 'log_2024-01-20_20240120'), ('file name', 'users_20240119'), ('month', '2024-02-01 00:00:00 2024-02-29 23:59:59'), ('no month', 'refused'),
  ('stamp', '2024-02-29 23:59:59'), ('no stamp', 'refused'), ('database', 'shop'), ('dsn', 'mysql://' || 'u:p@ss@tcp(h:3306)/shop'), ('strict offset', 'None'), ('strict range', '2024-01-17 15:00:00 2024-01-19 15:00:00'),
  ('rendered', 'age > 5 AND city = Ulm'), ('no conditions', 'all rows'), ('unknown protection', 'refused'), ('batch of files', '5'), ('mean size', '150')) AS t(name, value)
""")
def settings_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the functions of names, times and settings make of given values, and what they refuse."""
    from tidewater.config import CountCondition

    def refused(call) -> str:  # noqa: ANN001
        try:
            return str(call())
        except ValueError:
            return "refused"

    month = names.year_month("202402")
    strict = clock.offset_range(AS_OF, -2, 0, strict=True)
    conditions = [CountCondition("city", "=", "Bonn"), CountCondition("age", ">", "5"), CountCondition("city", "=", "Ulm"), CountCondition("x", "=", "1", "other")]
    rows = {
        "placeholders": clock.fill_date("log_{YYYY}-{mm}-{DD}_YYYYMMdd", date(2024, 1, 20)), "file name": names.file_name("^{table}_{YYYY}{MM}{DD}$", "users", AS_OF),
        "month": f"{month[0]} {month[1]}", "no month": refused(lambda: names.year_month("202413")), "stamp": str(clock.parse_stamp("2024-02-29 23:59:59")), "no stamp": refused(lambda: clock.parse_stamp("2024-02-30 23:59:59")),
        "database": names.database_of("mongodb://u:p@h:1/shop?replicaSet=rs0"), "dsn": "mysql://" + names.dsn("mysql", "u", "p@ss", "h", 3306, "shop"), "strict offset": str(clock.offset_range(AS_OF, None, 0, strict=True)),
        "strict range": f"{strict[0]} {strict[1]}", "rendered": predicates.rendered(conditions, "people"), "no conditions": predicates.rendered([]), "unknown protection": refused(lambda: PiiRule("x", "hidden")),
        "batch of files": str(bounded_prefix([100 << 20] * 10)), "mean size": str(estimated([10, 20], 10)),
    }
    return spark.createDataFrame(list(rows.items()), "name string, value string")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-17 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00'")
def backup_strict_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that are numbers hold; others mean no range at all."""
    e = table(spark, sf_dir, "events")
    bounds = [clock.offset_range(AS_OF, start, 0, strict=True) for start in (-2, "x", None, True)]
    assert bounds[1:] == [None] * 3 and bounds[0][1] - bounds[0][0] == timedelta(days=2)
    return e.where(clock.within(F.col("ts"), bounds[0])).select("event_id")
