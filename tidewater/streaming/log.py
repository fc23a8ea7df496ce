"""Log records as rows of a table."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import SparkSession

SCHEMA = "log_time timestamp, level string, message string, sync_task_id int"


class LogTable(logging.Handler):
    """Appends records to a table of log_time, level, message, sync_task_id, so many at once and the rest at close.

    The task comes with the record: logger.info("...", extra={"sync_task_id": 3}); without one it is 0. What cannot be
    written is reported as logging reports it, and keeps nothing else from going on.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 500) -> None:
        super().__init__()
        self.spark, self.path, self.rows, self.held, self.writing = spark, path, rows, [], False

    def emit(self, record: logging.LogRecord) -> None:
        if self.writing:
            return  # what the writing itself logs
        try:
            task = int(getattr(record, "sync_task_id", 0) or 0)
        except (TypeError, ValueError):
            task = 0
        self.held.append((datetime.fromtimestamp(record.created, timezone.utc), record.levelname.lower(), self.format(record), task))
        if len(self.held) >= self.rows:
            self.flush()

    def flush(self) -> None:
        self.acquire()
        try:
            if self.held and not self.writing:
                self.writing = True
                rows, self.held = self.held, []
                try:
                    self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
                except Exception:
                    self.held = rows + self.held
                    self.handleError(logging.LogRecord(__name__, logging.ERROR, __file__, 0, "log rows not written", None, None))
                finally:
                    self.writing = False
        finally:
            self.release()

    def close(self) -> None:
        self.flush()
        super().close()
