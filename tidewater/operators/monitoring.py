"""Analytics over monitoring, statistics and log tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.clock import instant, local_date, local_text, since

TREND_ROWS, LOG_ROWS = 1000, 500


def label(task_id: Column, table: Column) -> Column:
    """A table's name in a chart: with its task where the id is the legacy 0, else as it is."""
    return F.when(task_id.cast("string") == "0", F.concat(F.lit("taskID:"), task_id.cast("string"), F.lit("_"), table)).otherwise(table)


def recent(log: DataFrame, column: str, as_of: datetime, span: str) -> DataFrame:
    start = since(as_of, span)
    return log if start is None else log.where(F.col(column) >= instant(start))


def recent_or_all(log: DataFrame, column: str, as_of: datetime, span: str) -> DataFrame:
    """Rows of the span, or all where it has none."""
    found = recent(log, column, as_of, span)
    return log if span and found.isEmpty() else found


def row_count_trend(log: DataFrame, tie: Sequence[str] = (), limit: int = TREND_ROWS) -> DataFrame:
    """time, name, series, value: source, target and absolute difference of the earliest rows of a monitoring log."""
    first = log.orderBy("logged_at", *tie).limit(limit)
    name = label(F.col("sync_task_id"), F.col("tgt_table"))
    three = F.expr("stack(3, 'source', src_row_count, 'target', tgt_row_count, 'diff', abs(src_row_count - tgt_row_count)) AS (series, value)")
    return first.select(local_text(F.col("logged_at")).alias("time"), name.alias("name"), three)


def table_stats(log: DataFrame, day: tuple[datetime, datetime]) -> DataFrame:
    """tgt_table, synced_today, total_rows, last_sync: growth of the target within a day, never below 0."""
    rows = log.where((F.col("logged_at") >= instant(day[0])) & (F.col("logged_at") <= instant(day[1])))
    return rows.groupBy("tgt_table").agg(
        F.greatest(F.max("tgt_row_count") - F.min("tgt_row_count"), F.lit(0)).alias("synced_today"), F.max("tgt_row_count").alias("total_rows"), F.max("logged_at").alias("last_sync"),
    )


def stream_status(stats: DataFrame) -> DataFrame:
    """One row of totals over all streams but those of the legacy task 0."""
    of = stats.where("task_id <> 0")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("received", "executed", "pending", "errors", "inserted", "updated", "deleted")]
    return of.agg(F.count(F.lit(1)).alias("streams"), F.count_distinct("task_id").alias("tasks"), *sums, F.max("last_updated").alias("last_updated"))


def stream_list(stats: DataFrame) -> DataFrame:
    return stats.where("task_id <> 0").orderBy("task_id", "collection_name")


def task_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("task_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("received", "executed", "pending")])


def upsert_statistics(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Statistics by (task_id, collection_name): fresh counters take the place of the stored; pending is what is not yet executed."""
    keys = ["task_id", "collection_name"]
    new = fresh.withColumn("pending", F.greatest(F.col("received") - F.col("executed"), F.lit(0)))
    return stored.join(new, keys, "left_anti").unionByName(new.select(*stored.columns))


def accumulate(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Statistics by key with the counters of a micro-batch added to them."""
    keys, sums = ["task_id", "collection_name"], [c for c in stored.columns if c not in ("task_id", "collection_name")]
    return stored.unionByName(more).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def known_on(stats: DataFrame, day: date) -> DataFrame:
    """tgt_table, n, last_seen, on_day: whether the table was logged on the business day at all."""
    on_day = F.max(F.when(local_date(F.col("logged_at")) == F.lit(day), 1).otherwise(0))
    return stats.groupBy("tgt_table").agg(F.count(F.lit(1)).alias("n"), F.max("logged_at").alias("last_seen"), on_day.alias("on_day"))


def daily_summary(events: DataFrame, time: str, by: Sequence[str], value: str) -> DataFrame:
    """Counts and sums by business day: what a counter that is set to zero each day would have held."""
    return events.groupBy(local_date(F.col(time)).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def log_search(log: DataFrame, level: str = "", text: str = "", tie: Sequence[str] = (), limit: int = LOG_ROWS) -> DataFrame:
    """The newest rows, of these the ones of a level that hold a text, both without case."""
    rows = log.orderBy(F.desc("log_time"), *[F.desc(c) for c in tie]).limit(limit)
    if level:
        rows = rows.where(F.lower("level") == level.lower())
    return rows.where(F.contains(F.lower("message"), F.lit(text.lower()))) if text else rows


def growth(log: DataFrame) -> DataFrame:
    """Each row's target count less that of the row before it of the same table."""
    from pyspark.sql.window import Window

    before = F.lag("tgt_row_count").over(Window.partitionBy("sync_task_id", "tgt_table").orderBy("logged_at", "log_id"))
    return log.withColumn("grown", F.col("tgt_row_count") - F.coalesce(before, F.col("tgt_row_count")))


def next_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def timings(runs: DataFrame, by: Sequence[str], took: str) -> DataFrame:
    """Smallest, mean and largest of a duration, and how many a second."""
    return runs.groupBy(*by).agg(F.min(took).alias("least"), F.avg(took).alias("mean"), F.max(took).alias("most"), (F.count(F.lit(1)) / F.sum(took)).alias("per_second"))
