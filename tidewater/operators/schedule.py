"""The recurring row-count comparison of a task, as of an instant."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import CountCondition, Task
from tidewater.operators.predicates import count_where

_log = logging.getLogger(__name__)

LOG = "sync_task_id int, db_type string, src_table string, src_row_count bigint, tgt_table string, tgt_row_count bigint, monitor_action string, logged_at timestamp"


def of_yesterday(conditions: tuple[CountCondition, ...]) -> tuple[CountCondition, ...]:
    """The same conditions with every date range set to yesterday."""
    return tuple(replace(c, value="yesterday") if c.operator == "dateRange" else c for c in conditions)


def compare(spark: SparkSession, task: Task, source: Callable[[str], DataFrame], target: Callable[[str], DataFrame], as_of: datetime, daily: bool = False) -> DataFrame:
    """One monitoring row for each mapping: conditional counts of both sides, -1 for a side that cannot be counted."""

    def counted(read: Callable[[str], DataFrame], table: str, conditions: tuple[CountCondition, ...]) -> int:
        try:
            return count_where(read(table), conditions, as_of).first()["n"]
        except PySparkException:
            return -1

    rows = []
    for m in task.mappings:
        conditions = tuple(c for c in m.conditions if not c.table or c.table in (m.source, m.target))
        conditions = of_yesterday(conditions) if daily else conditions
        rows.append((task.id, task.kind, m.source, counted(source, m.source, conditions), m.target, counted(target, m.target, conditions), "daily_check" if daily else "row_count_minutely", as_of))
    return spark.createDataFrame(rows, LOG)


def alerts(log: DataFrame) -> DataFrame:
    """Mappings whose counts differ, and those of which a side could not be counted, both sides among them."""
    failed = (F.col("src_row_count") < 0) | (F.col("tgt_row_count") < 0)
    rows = log.where((F.col("src_row_count") != F.col("tgt_row_count")) | failed)
    return rows.select("sync_task_id", "src_table", "tgt_table", (F.col("src_row_count") - F.col("tgt_row_count")).alias("difference"), failed.alias("uncounted"))


def append(log: DataFrame, path: str) -> None:
    """Monitoring rows added to the log's table."""
    log.write.mode("append").parquet(path)


def notify(found: DataFrame, send: Callable[[str], object], most: int = 50) -> int:
    """One message for each alert (one for a mapping), and one that says how many more there are; the number of alerts.

    A message that cannot be sent keeps neither the others nor the comparison from going on.
    """
    rows = found.orderBy("sync_task_id", "src_table").limit(most + 1).collect()
    n = len(rows) if len(rows) <= most else found.count()
    said = [f"task {r['sync_task_id']}: {r['src_table']} -> {r['tgt_table']} " + ("could not be counted" if r["uncounted"] else f"differs by {r['difference']}") for r in rows[:most]]
    for text in said + ([f"{n - most} more"] if n > most else []):
        try:
            send(text)
        except Exception:
            _log.exception("alert not sent: %s", text)
    return n
