"""Sinks of rows: thin adapters over Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewater.sources.readers import FORMATS

#: Rows of one statement of a JDBC target.
BATCH_ROWS = 100


def append(df: DataFrame, kind: str, table: str, options: dict[str, str] | None = None, partitions: int | None = None) -> None:
    """Rows added to a target's table, in so many connections at most (one a task).

    A task that fails is tried again, and its rows may come twice where the target has no key to refuse them: write
    through a replica, or insert what is absent, where that matters.
    """
    if partitions:
        df = df.coalesce(partitions)
    writer = df.write.format(FORMATS[kind]).mode("append")
    if FORMATS[kind] == "jdbc":
        writer.option("batchsize", BATCH_ROWS).options(**(options or {})).option("dbtable", table).save()
    elif kind == "mongodb":
        writer.options(**(options or {})).option("collection", table).save()
    elif kind == "redis":
        writer.options(**(options or {})).option("table", table).save()
    else:
        writer.options(**(options or {})).save(table)
