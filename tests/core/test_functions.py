"""Names, clock, settings and predicates: tables of cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewater.config import BackupSpec, CountCondition, PiiRule, TableMapping, seconds, task_from_json
from tidewater.functions import clock, names
from tidewater.operators import predicates

PREFIXES = {
    "orders_202501": "orders", "users_20250115": "users", "logs_2025": "logs", "events202501": "events", "products": "products",
    "analytics_data_123": "analytics_data_", "logs20250101": "logs20",
}


def test_prefixes(spark):
    assert {n: names.prefix(n) for n in PREFIXES} == PREFIXES
    df = spark.createDataFrame([(n,) for n in PREFIXES], "n string")
    assert {r["n"]: r["p"] for r in df.select("n", names.prefix_column(F.col("n")).alias("p")).collect()} == PREFIXES


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["a_202501", "a_202502"], {"a": ["a_202501", "a_202502"]}),
        (["d_20250101", "d_20250102"], {"d": ["d_20250101", "d_20250102"]}),
        (["y_2024", "y_2025"], {"y": ["y_2024", "y_2025"]}),
        (["users", "orders"], {"users": ["users"], "orders": ["orders"]}),
        (["a_202501", "users", "a_202502"], {"a": ["a_202501", "a_202502"], "users": ["users"]}),
    ],
)
def test_groups(given, want):
    assert names.grouped(given) == want


def test_ranges_of_names():
    assert names.time_range("orders_202502") == (datetime(2025, 2, 1), datetime(2025, 2, 28, 23, 59, 59))
    assert names.time_range("users_20250115") == (datetime(2025, 1, 15), datetime(2025, 1, 15, 23, 59, 59))
    assert names.time_range("logs_2025") == (datetime(2025, 1, 1), datetime(2025, 12, 31, 23, 59, 59))
    assert names.time_range("products") is None and names.time_range("x_202513") is None
    for bad in ("202513", "20251", "abcdef", "202500"):
        with pytest.raises(ValueError, match="month"):
            names.year_month(bad)
    with pytest.raises(ValueError, match="year"):
        names.year("20x5")


def test_pruning_keeps_both_ends_and_the_first():
    tables = ["t_202501", "t_202502", "t_202503", "t"]
    assert names.prune(tables, (datetime(2025, 1, 31, 23, 59, 59), datetime(2025, 2, 1))) == ["t_202501", "t_202502", "t"]
    assert names.prune(tables[:3], (datetime(2030, 1, 1), datetime(2030, 2, 1))) == ["t_202501"]
    assert names.prune(tables, None) == tables


def test_log_positions(spark):
    for text, want in {"0/0": 0, "0/16B3748": 0x16B3748, "16/B374D848": 0x16B374D848, "FFFFFFFF/FFFFFFFF": (1 << 64) - 1}.items():
        assert names.lsn(text) == want
        assert spark.range(1).select(names.lsn_column(F.lit(text)).alias("x")).first()["x"] == want
    assert spark.range(1).select(names.lsn_column(F.lit("zz")).alias("x")).first()["x"] is None
    with pytest.raises(ValueError, match="position"):
        names.lsn("12")


def test_connection_strings(spark):
    for kind in ("mysql", "mariadb", "postgresql", "mongodb"):
        parts = names.dsn_parts(names.dsn(kind, "user", "p@ss:w", "db.host", 1234, "shop"))
        assert parts == {"user": "user", "password": "p@ss:w", "host": "db.host", "port": "1234", "database": "shop"}
    assert names.database_of("redis://:pw@host:6379/0") == "0"
    assert names.database_of("mongodb://u:p@h:1/shop?replicaSet=rs0") == "shop"
    text = "mysqldump -uroot -pS3cret -hhost mongodb://a:b@h/x"
    assert names.hide_credentials(text) == "mysqldump -uroot -p*** -hhost mongodb://***:***@h/x"
    assert spark.range(1).select(names.hide_credentials(F.lit(text)).alias("x")).first()["x"] == names.hide_credentials(text)


def test_small_names():
    assert names.clean_quotes({"a": '"active"', "b": "'pending'", "c": {"type": '"daily"'}, "d": 5}) == {"a": "active", "b": "pending", "c": {"type": "daily"}, "d": 5}
    assert clock.fill_date("log_{YYYY}-{mm}-{DD}_YYYYMMdd", date(2025, 1, 5)) == "log_2025-01-05_20250105"
    at = datetime(2025, 1, 6)
    assert names.file_name("^{table}_{YYYY}{MM}{DD}$", "users", at) == "users_20250105"
    assert names.file_name("{YYYY}", "users", at) == "users_2025"


def test_days_of_the_zone():
    late = datetime(2024, 1, 20, 15, 30)  # 00:30 on the 21st there
    assert clock.business_day(late) == date(2024, 1, 21)
    assert clock.named_range("yesterday", late) == (datetime(2024, 1, 19, 15), datetime(2024, 1, 20, 15))
    assert clock.named_range("weekly", late)[0] == datetime(2024, 1, 20, 15)  # a Sunday
    assert clock.named_range("monthly", late)[0] == datetime(2023, 12, 31, 15)
    assert clock.named_range("other", late) is None
    assert clock.offset_range(late) == (datetime(2024, 1, 19, 15), datetime(2024, 1, 20, 15))
    assert clock.offset_range(late, "x", 0, strict=True) is None
    assert clock.since(late, "1h") == datetime(2024, 1, 20, 14, 30) and clock.since(late, "odd") == datetime(2024, 1, 20, 5, 30) and clock.since(late, "") is None


@pytest.mark.parametrize("text", ["2024-13-01 00:00:00", "2024-01-01", "2024-01-01T00:00:00", "", "x"])
def test_strict_stamps(text):
    assert clock.parse_stamp("2024-02-29 23:59:59") == datetime(2024, 2, 29, 23, 59, 59)
    with pytest.raises(ValueError):  # noqa: PT011
        clock.parse_stamp(text)


def test_settings():
    task = task_from_json(3, """{"type": "mysql", "securityEnabled": true, "retryDelay": "5s", "mappings": [{"tables": [{"sourceTable": "users", "targetTable": "people",
      "fieldSecurity": [{"field": "email", "securityType": "masked"}, {"field": "email", "securityType": "encrypted"}, {"field": "", "securityType": "masked"}],
      "countQuery": {"conditions": [{"field": "age", "operator": ">", "value": 5}]}, "advancedSettings": {"ignoreDeleteOps": true}}]}]}""")
    assert task.rules_of("people") == (PiiRule("email", "masked"),) == task.rules_of("users") and task.retry_delay_s == 5
    m = task.mapping_of("users")
    assert m.target == "people" and m.ignore_deletes and m.conditions == (CountCondition("age", ">", "5"),) and task.mapping_of("x") is None
    assert seconds(7) == 7 and seconds("2m") == 120 and seconds(None) == 5
    with pytest.raises(ValueError, match="security"):
        PiiRule("a", "hashed")
    with pytest.raises(ValueError, match="key"):
        TableMapping("a", "b", ("id",), (PiiRule("id", "masked"),))
    with pytest.raises(ValueError, match="format"):
        BackupSpec(format="bson")


def test_predicates(spark):
    df = spark.createDataFrame([(1, "42", 1.5), (2, "x", None), (3, None, 42.0)], "id int, s string, v double")
    at = datetime(2024, 1, 1)
    n = lambda *c: predicates.count_where(df, [CountCondition(*x) for x in c], at, "t").first()["n"]
    assert n(("s", "=", "42")) == 1 and n(("v", "=", "42")) == 1 and n(("s", "!=", "42")) == 2 and n(("s", "<>", "42")) == 2
    assert n(("id", ">", "1"), ("id", "<=", "1")) == 1 and n(("id", ">", "1", "other")) == 3 and n(("id", "=", "")) == 3 and n() == 3
    assert predicates.safe_count(None) == -1 and predicates.safe_count(df) == 3
    assert predicates.rendered([CountCondition("b", ">", "1"), CountCondition("a", "=", "x"), CountCondition("b", "<", "2")]) == "a = x AND b < 2"
    with pytest.raises(ValueError, match="operator"):
        n(("id", "~", "1"))
    with pytest.raises(ValueError, match="unsupported"):
        predicates.export_predicate({"a": ["x"]}, at)
