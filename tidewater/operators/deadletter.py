"""Changes that cannot be applied: set aside, retried up to a limit, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 3
#: One failed operation a row, so no batch of them need fit anywhere.
LETTER = "batch_id string, id string, write_model string, error string, error_code int, op_type string, retry_count int"


def event_type(row: str) -> str:
    """The type of a change event over rows of a struct type."""
    return f"struct<seq:bigint,op:string,before:{row},after:{row}>"


def serialised(op: Column, key: Column, after: Column) -> Column:
    """A change as JSON: type, filter, document, upsert."""
    return F.to_json(F.struct(op.alias("type"), key.alias("filter"), after.alias("document"), op.isin("update", "replace").alias("upsert")))


def deserialised(text: Column, row_type: str) -> Column:
    return F.from_json(text, f"struct<type:string,filter:string,document:{row_type},upsert:boolean>")


def split(changes: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Changes to apply, and the others; an unknown verdict counts as invalid."""
    good = F.coalesce(valid, F.lit(False))
    return changes.where(good), changes.where(~good)


def letters(rejected: DataFrame, batch: Column, error: Column, payload: Column) -> DataFrame:
    """One row a failed operation (seq, op): LETTER."""
    return rejected.select(
        batch.cast("string").alias("batch_id"), F.col("seq").cast("string").alias("id"), payload.alias("write_model"), error.alias("error"),
        F.lit(0).alias("error_code"), F.col("op").alias("op_type"), F.lit(0).alias("retry_count"),
    )


def letters_of(rejected: DataFrame, batch: Column, error: Column) -> DataFrame:
    """Letters of whole events (seq, op, before, after); one without a seq is named by its content."""
    event = F.to_json(F.struct("seq", "op", "before", "after"))
    made = letters(rejected, batch, error, event)
    return made.withColumn("id", F.coalesce("id", F.concat(F.lit("sha256:"), F.sha2("write_model", 256))))


def eligible(stored: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Operations that may be tried again."""
    return stored.where(F.col("retry_count") < retries)


def after_retry(stored: DataFrame, succeeded: DataFrame, retries: int = RETRIES) -> DataFrame:
    """What is left after a retry in which the operations (batch_id, id) succeeded; tried ones count once more, exhausted ones stay."""
    left = stored.join(succeeded.select("batch_id", "id").distinct(), ["batch_id", "id"], "left_anti")
    return left.withColumn("retry_count", F.when(F.col("retry_count") < retries, F.col("retry_count") + 1).otherwise(F.col("retry_count"))).select(*stored.columns)


def statistics(stored: DataFrame) -> DataFrame:
    """One row: batches and failed operations."""
    return stored.agg(F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("failed_operations"))
