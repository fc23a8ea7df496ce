"""Source against target: counts by mapping and rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """src_table, src_row_count, tgt_row_count, difference from (table, n) of both sides; a side without the table counts as -1."""
    s, t = source.select("table", F.col("n").alias("s")), target.select("table", F.col("n").alias("t"))
    both = s.join(t, "table", "full_outer").select("table", F.coalesce("s", F.lit(-1)).cast("long").alias("src_row_count"), F.coalesce("t", F.lit(-1)).cast("long").alias("tgt_row_count"))
    return both.withColumn("difference", F.abs(F.col("src_row_count") - F.col("tgt_row_count")))


def row_differences(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns, status (missing, extra, different) and the fields that differ; equal rows are left out. Keys are not null."""
    fields = [c for c in source.columns if c not in keys]
    s, t = (df.select(*keys, F.struct(*fields).alias(name)) for df, name in ((source, "s"), (target, "t")))
    both = s.join(t, list(keys), "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.size(changed) > 0, "different")
    return both.select(*keys, status.alias("status"), F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.array_join(changed, ",")).otherwise("").alias("fields")).where("status is not null")


def difference_summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
