"""Queries that run a change stream to its end and give the replica."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import CountCondition, PiiRule, TableMapping, Task, task_from_json
from tidewater.functions.names import lsn, lsn_column
from tidewater.functions.pii import protect
from tidewater.operators import schedule
from tidewater.plans.registry import AS_OF, query, table
from tidewater.plans.replication import _OP_SQL, _op
from tidewater.sources.store import shared_folder
from tidewater.streaming.replica import DeadLetters, Replica, follow
from tidewater.streaming.task import TaskRun

_FIELDS = (("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("ts", "timestamp_ntz"))


_ROW = ", ".join(f"{n} {t}" for n, t in _FIELDS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change stream of users."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    none = F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">")
    return raw.select(F.col("event_id").alias("seq"), _op().alias("op"), none.alias("before"), F.struct(*[F.col(n) for n, _ in _FIELDS]).alias("after"))


def _replica(spark: SparkSession, folder: str) -> Replica:
    return Replica(spark, f"{folder}/replica", ("user_id",), _ROW, 8)


def _followed(spark: SparkSession, sf_dir: str, **options: object) -> Replica:
    folder = shared_folder(spark, "stream")
    replica = _replica(spark, folder)
    follow(_events(spark, sf_dir), replica, f"{folder}/checkpoint", **options).awaitTermination()
    return replica


@query(f"""
WITH log AS (SELECT *, {_OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, event_type, value, ts FROM log WHERE rn = 1 AND op <> 'delete'
""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir).read()


@query(f"""
WITH log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE {_OP_SQL} <> 'delete')
SELECT user_id, repeat('*', strlen(event_type)) AS event_type, value, ts FROM log WHERE rn = 1
""")
def stream_replay_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hide = lambda df: protect(df, [PiiRule("after.event_type", "masked")])
    return _followed(spark, sf_dir, prepare=hide, ignore_deletes=True).read()


@query(f"""
WITH log AS (SELECT *, {_OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id * 16 >= 4096)
SELECT user_id, event_type, value, ts FROM log WHERE rn = 1 AND op <> 'delete'
""")
def stream_stale_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that ended before the last written position are left out of the stream."""
    folder = shared_folder(spark, "stream")
    replica = _replica(spark, folder)
    events = _events(spark, sf_dir).withColumn("txn_lsn", lsn_column(F.concat(F.lit("0/"), F.hex(F.col("seq") * 16))))
    follow(events, replica, f"{folder}/checkpoint", since=lsn("0/1000")).awaitTermination()
    return replica.read()


_LAST_SQL = """
SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE {where}) WHERE rn = 1 AND event_type <> 'error'
"""


@query(_LAST_SQL.format(where="TRUE"))
def stream_replay_new_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of an earlier stream were applied under the same and higher numbers; the whole log of a new checkpoint is applied all the same."""
    folder = shared_folder(spark, "stream")
    replica = _replica(spark, folder)
    old = _events_batch(spark, sf_dir).where("seq < 100")
    for number in range(3):
        replica.apply(old, number)
    follow(_events(spark, sf_dir), replica, f"{folder}/checkpoint").awaitTermination()
    return replica.read()


def _events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _op().alias("op"), none.alias("before"), F.struct(*[F.col(n) for n, _ in _FIELDS]).alias("after"))


def _refused(spark: SparkSession, sf_dir: str) -> tuple[Replica, DeadLetters]:
    """A replica of a target that refuses small values, and the letters of what it refused."""
    folder = shared_folder(spark, "stream")
    replica = _replica(spark, folder)
    letters = DeadLetters(spark, f"{folder}/letters", "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">")
    follow(_events(spark, sf_dir), replica, f"{folder}/checkpoint", letters=letters, valid=lambda df: F.col("after.value") >= 20).awaitTermination()
    return replica, letters


@query(f"SELECT event_id::VARCHAR AS id, {_OP_SQL} AS op_type, 0 AS retry_count, user_id, value FROM events WHERE value < 20")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, letters = _refused(spark, sf_dir)
    event = F.from_json("write_model", "struct<after:struct<user_id:bigint,value:double>>")
    return letters.read().select("id", "op_type", "retry_count", event["after"]["user_id"].alias("user_id"), event["after"]["value"].alias("value"))


@query(
    "WITH r AS (" + _LAST_SQL.format(where="value >= 10") + ") SELECT user_id::VARCHAR AS what, event_type, value FROM r "
    "UNION ALL SELECT 'letter ' || event_id::VARCHAR, 'tried 2', NULL FROM events WHERE value < 10"
)
def dlq_reapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target takes values from 10 on in two later tries: what went through is in the replica, the others count two tries more."""
    replica, letters = _refused(spark, sf_dir)
    for _ in range(2):
        letters.retry(replica, lambda df: F.col("after.value") >= 10)
    left = letters.read().select(F.concat(F.lit("letter "), "id").alias("what"), F.concat(F.lit("tried "), F.col("retry_count").cast("string")).alias("event_type"), F.lit(None).cast("double").alias("value"))
    return replica.read().select(F.col("user_id").cast("string").alias("what"), "event_type", "value").unionAll(left)


@query("""
WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error'), e AS (SELECT * FROM last WHERE rn = 1)
SELECT 'people' AS target, c_custkey AS user_id, repeat('*', strlen(c_name)) AS name, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e)
UNION ALL SELECT 'people', user_id, repeat('*', strlen(event_type)), value FROM e
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
""")
def task_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task from its JSON: snapshots into empty targets, one under another name with a masked field and without deletes, then the stream, and all of it a second time."""
    fields = '"fieldSecurity": [{"field": "name", "securityType": "masked"}], "advancedSettings": {"ignoreDeleteOps": true, "syncIndexes": true}'
    tables = f'{{"sourceTable": "customer", "targetTable": "people", "keys": ["user_id"], {fields}}}, {{"sourceTable": "supplier", "targetTable": "supplier", "keys": ["user_id"]}}'
    task = task_from_json(7, f'{{"type": "mysql", "taskName": "people", "securityEnabled": true, "mappings": [{{"tables": [{tables}]}}]}}')
    rows = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value")),
    }
    row = F.struct("after.user_id", F.col("after.event_type").alias("name"), "after.value")
    events = _events(spark, sf_dir).select("seq", "op", F.when(F.col("before").isNotNull(), row).alias("before"), row.alias("after"))
    streams = {"customer": events, "supplier": events.where("seq < 0")}
    folder = shared_folder(spark, "task")
    for _ in range(2):
        run = TaskRun(spark, task, folder, rows.get, streams.get, buckets=8)
        run.run()
    parts = [run.replica(m).read().select(F.lit(m.target).alias("target"), "user_id", "name", "value") for m in task.mappings]
    return parts[0].unionAll(parts[1])


@query("""
SELECT 'events' AS src_table, 'late_events' AS tgt_table,
  (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-18 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00')
  - (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-18 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00' AND event_id % 10 <> 0) AS difference
""")
def daily_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's counts of yesterday, source against a target that lacks rows."""
    task = Task(1, "mysql", mappings=(TableMapping("events", "late_events", conditions=(CountCondition("ts", "dateRange", "daily"),)), TableMapping("orders", "orders")))
    target = lambda name: table(spark, sf_dir, "events").where("event_id % 10 <> 0") if name == "late_events" else table(spark, sf_dir, name)
    return schedule.alerts(schedule.compare(spark, task, lambda name: table(spark, sf_dir, name), target, AS_OF, daily=True)).select("src_table", "tgt_table", "difference")
