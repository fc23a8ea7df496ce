"""Queries of monitoring analytics. The events table is read as a monitoring log, as stream statistics and as a log."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import clock
from tidewater.operators import changes, monitoring
from tidewater.plans.registry import query, table


def monitoring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), (F.col("user_id") % 4).alias("sync_task_id"), F.col("event_type").alias("tgt_table"),
        (F.col("event_id") * 7 % 1000).alias("src_row_count"), (F.col("event_id") * 5 % 900).alias("tgt_row_count"), F.col("ts").alias("logged_at"),
    )


_LOG = """log AS (SELECT event_id AS log_id, user_id % 4 AS sync_task_id, event_type AS tgt_table, event_id * 7 % 1000 AS src_row_count,
  event_id * 5 % 900 AS tgt_row_count, ts AS logged_at FROM events)"""


@query(f"""
WITH {_LOG}, f AS (SELECT *, CASE WHEN sync_task_id = 0 THEN 'taskID:0_' || tgt_table ELSE tgt_table END AS name,
  strftime(logged_at + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS "time" FROM log ORDER BY logged_at, log_id LIMIT 1000)
SELECT "time", name, 'source' AS series, src_row_count AS value FROM f
UNION ALL SELECT "time", name, 'target', tgt_row_count FROM f
UNION ALL SELECT "time", name, 'diff', abs(src_row_count - tgt_row_count) FROM f
""")
def row_count_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.row_count_trend(monitoring_log(spark, sf_dir), ["log_id"])


@query(f"""
WITH {_LOG} SELECT tgt_table, greatest(max(tgt_row_count) - min(tgt_row_count), 0) AS synced_today, max(tgt_row_count) AS total_rows, max(logged_at) AS last_sync
FROM log WHERE logged_at BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59' GROUP BY tgt_table
""")
def synced_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.table_stats(monitoring_log(spark, sf_dir), (datetime(2024, 1, 20), datetime(2024, 1, 20, 23, 59, 59)))


_STATS = """stats AS (SELECT user_id % 7 AS task_id, event_type AS collection_name, count(*) AS received, count(*) FILTER (value >= 20) AS executed,
  max(ts) AS last_updated, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS inserted,
  count(*) FILTER (event_type = 'view') AS updated, count(*) FILTER (event_type = 'click') AS deleted FROM events GROUP BY ALL),
full_stats AS (SELECT *, greatest(received - executed, 0) AS pending FROM stats)"""


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("task_id"), F.col("event_type").alias("collection_name"))
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    made = of.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("value") >= 20).alias("executed"), F.max("ts").alias("last_updated"),
        is_("error").alias("errors"), is_("signup").alias("inserted"), is_("view").alias("updated"), is_("click").alias("deleted"),
    )
    return made.withColumn("pending", F.greatest(F.col("received") - F.col("executed"), F.lit(0)))


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("received", "executed", "pending", "errors", "inserted", "updated", "deleted"))


@query(f"WITH {_STATS} SELECT count(*) AS streams, count(DISTINCT task_id) AS tasks, {_SUMS}, max(last_updated) AS last_updated FROM full_stats WHERE task_id <> 0")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.stream_status(statistics(spark, sf_dir))


@query(f"WITH {_STATS} SELECT task_id, collection_name, received, pending FROM full_stats WHERE task_id <> 0")
def stream_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.stream_list(statistics(spark, sf_dir)).select("task_id", "collection_name", "received", "pending")


@query(f"WITH {_STATS} SELECT task_id, sum(received)::BIGINT AS received, sum(executed)::BIGINT AS executed, sum(pending)::BIGINT AS pending FROM full_stats GROUP BY task_id")
def task_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.task_totals(statistics(spark, sf_dir))


@query(f"""
WITH {_STATS} SELECT task_id, collection_name, received + 10 * (task_id % 2) AS received, executed,
  CASE WHEN task_id % 2 = 0 THEN pending ELSE greatest(received + 10 - executed, 0) END AS pending FROM full_stats
""")
def statistics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics(spark, sf_dir).select("task_id", "collection_name", "received", "executed", "pending")
    return monitoring.upsert_statistics(s, s.where("task_id % 2 = 1").withColumn("received", F.col("received") + 10))


@query("SELECT user_id AS task_id, event_type AS collection_name, count(*) AS received, count(*) FILTER (event_type = 'signup') AS inserted FROM events GROUP BY ALL")
def statistics_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of two micro-batches added up."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task_id"), F.col("event_type").alias("collection_name"), F.when(F.col("event_type") == "signup", "insert").otherwise("update").alias("op"))
    half = lambda k: changes.op_counts(e.where(F.col("event_id") % 2 == k), ["task_id", "collection_name"]).select("task_id", "collection_name", "received", "inserted")
    return monitoring.accumulate(half(0), half(1))


@query(f"""
WITH {_LOG} SELECT tgt_table, count(*) AS n, max(logged_at) AS last_seen, max(CASE WHEN (logged_at + INTERVAL 9 HOUR)::DATE = DATE '2024-01-20' THEN 1 ELSE 0 END) AS on_day FROM log GROUP BY tgt_table
""")
def known_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.known_on(monitoring_log(spark, sf_dir), date(2024, 1, 20))


@query("SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def daily_summary_jst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.daily_summary(table(spark, sf_dir, "events"), "ts", ["event_type"], "event_id")


@query("""
WITH newest AS (SELECT event_id, ts AS log_time, event_type AS level, 'Event for user ' || user_id::VARCHAR AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
SELECT event_id, log_time, level, message FROM newest WHERE lower(level) = 'error' AND contains(lower(message), 'user 1')
""")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("log_time"), F.col("event_type").alias("level"), F.concat(F.lit("Event for user "), F.col("user_id")).alias("message"))
    return monitoring.log_search(log, "ERROR", "USER 1", ["event_id"])


@query(f"""
WITH {_LOG} SELECT log_id, tgt_row_count - coalesce(lag(tgt_row_count) OVER (PARTITION BY sync_task_id, tgt_table ORDER BY logged_at, log_id), tgt_row_count) AS grown FROM log
""")
def row_count_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.growth(monitoring_log(spark, sf_dir)).select("log_id", "grown")


@query("SELECT max(event_id) + 1 AS next_id FROM events")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.next_id(table(spark, sf_dir, "events"), "event_id")


@query("SELECT event_type, min(user_id) AS least, avg(user_id) AS mean, max(user_id) AS most, count(*) / sum(user_id) AS per_second FROM events GROUP BY event_type")
def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.timings(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day FROM events")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clock.local_text(F.col("ts")).alias("local_time"), clock.local_text(F.col("ts"), "yyyy-MM-dd").alias("local_day"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown ' || event_id::VARCHAR ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS local_time FROM events""")
def local_times_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("unknown "), F.col("event_id"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", clock.local_text_of(text).alias("local_time"))
