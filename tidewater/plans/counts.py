"""Queries of conditional counts, one for each operator and range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import CountCondition as C
from tidewater.functions.clock import instant, offset_range, within
from tidewater.operators import monitoring, predicates
from tidewater.plans.registry import AS_OF, query, table


def _counted(name: str, conditions: list[C], sql: str, source: str) -> None:
    @query(sql, name)
    def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicates.count_where(table(spark, sf_dir, source), conditions, AS_OF, source)


_counted("count_all", [], "SELECT count(*) AS n FROM lineitem", "lineitem")
_counted("count_eq", [C("o_orderstatus", "=", "F")], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", "orders")
_counted("count_gt", [C("o_totalprice", ">", "100000.5")], "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000.5", "orders")
_counted("count_ge", [C("o_custkey", ">=", "42")], "SELECT count(*) AS n FROM orders WHERE o_custkey >= 42", "orders")
_counted("count_lt", [C("o_totalprice", "<", "50000")], "SELECT count(*) AS n FROM orders WHERE o_totalprice < 50000", "orders")
_counted("count_le", [C("o_custkey", "<=", "42")], "SELECT count(*) AS n FROM orders WHERE o_custkey <= 42", "orders")
_counted("count_ne", [C("o_orderstatus", "!=", "F")], "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'", "orders")
_counted("count_two_fields", [C("o_orderstatus", "=", "O"), C("o_totalprice", ">", "1000"), C("o_custkey", "=", "")], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000", "orders")
_counted("count_last_condition_wins", [C("o_totalprice", ">", "1000"), C("o_totalprice", "<", "90000")], "SELECT count(*) AS n FROM orders WHERE o_totalprice < 90000", "orders")
_counted("count_other_table_ignored", [C("o_orderstatus", "=", "O", "orders"), C("o_custkey", ">", "5", "customer")], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", "orders")


def _counted_text(name: str, value: str, operator: str = "=") -> None:
    """Of texts that read as numbers, each written in several ways, those that are as the condition writes them."""
    sql_op = {"=": "=", "!=": "IS DISTINCT FROM"}[operator]

    @query(f"WITH t AS (SELECT unnest(['007', '7', '1e5', '100000.0', '1_000', '1000', 'Infinity', NULL]) AS x, n_nationkey FROM nation) SELECT count(*) AS n FROM t WHERE x {sql_op} '{value}'", name)
    def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*[F.lit(x) for x in ("007", "7", "1e5", "100000.0", "1_000", "1000", "Infinity", None)])
        rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode_outer(texts).alias("x"))
        return predicates.count_where(rows, [C("x", operator, value)], AS_OF)


_counted_text("count_string_zeros", "007")
_counted_text("count_string_exponent", "1e5")
_counted_text("count_string_underscore", "1_000")
_counted_text("count_string_ne", "Infinity", "!=")
for _kind, _low, _high in (
    ("daily", "2024-01-19 15:00:00", "2024-01-20 15:00:00"), ("today", "2024-01-19 15:00:00", "2024-01-20 15:00:00"), ("yesterday", "2024-01-18 15:00:00", "2024-01-19 15:00:00"),
    ("weekly", "2024-01-13 15:00:00", "2024-01-20 15:00:00"), ("monthly", "2023-12-31 15:00:00", "2024-01-20 15:00:00"),
):
    _counted(f"count_{_kind}", [C("ts", "dateRange", _kind)], f"SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_low}' AND ts < TIMESTAMP '{_high}'", "events")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-12 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00'")
def backup_daily_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = predicates.export_predicate({"ts": {"type": "daily", "startOffset": -7, "endOffset": 0}}, AS_OF)
    return table(spark, sf_dir, "events").where(where).select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-18 15:00:00' AND ts < TIMESTAMP '2024-01-19 15:00:00'")
def backup_default_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(within(F.col("ts"), offset_range(AS_OF, None, None))).select("event_id", "ts")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3")
def backup_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(predicates.export_predicate({"event_type": "\"'click'\"", "user_id": 3}, AS_OF)).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 03:30:00'")
def since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.recent(table(spark, sf_dir, "events"), "ts", AS_OF, "2d").select("event_id")


@query("SELECT event_id FROM events")
def fallback_when_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is as late as this instant, so all rows come."""
    from datetime import timedelta

    return monitoring.recent_or_all(table(spark, sf_dir, "events"), "ts", AS_OF + timedelta(days=900), "1h").select("event_id")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59'")
def between_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return table(spark, sf_dir, "events").where(F.col("ts").between(instant(datetime(2024, 1, 10)), instant(datetime(2024, 1, 10, 23, 59, 59)))).select("event_id")
