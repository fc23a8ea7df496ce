"""Field protection, change application, exports and sources, with odd values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.config import BackupSpec, PiiRule
from tidewater.functions import pii
from tidewater.operators import changes, deadletter, export, monitoring, reconcile, schema
from tidewater.sources import readers
from tidewater.sources.keyvalue import KeyValueSource

#: Characters that must come through unchanged.
ODD = ["'", '"', "\n", "\r", "\t", "\\", "%", "_", "한글", "🌟", "∑", "≠", "±"]
KEY = bytes(range(32))


def odd_rows(spark):
    rows = [(i, f"test_{c}_value", i) for i, c in enumerate(ODD)] + [(90, None, None), (91, "", 1), (92, "x" * 5_000_000, 2)]
    return spark.createDataFrame(rows, "id int, s string, n int")


def test_masks_and_ciphers(spark):
    df = odd_rows(spark)
    hidden = {r["id"]: r for r in pii.protect(df, [PiiRule("s", "masked"), PiiRule("n", "masked"), PiiRule("gone", "masked")], lacking="ignore").collect()}
    for r in df.collect():
        assert hidden[r["id"]]["s"] == ("****" if r["s"] is None else "*" * len(r["s"].encode())) and hidden[r["id"]]["n"] == "****"
    sealed = pii.protect(df, [PiiRule("s", "encrypted")], KEY)
    back = {r["id"]: r["s"] for r in sealed.select("id", pii.decrypted(F.col("s"), KEY).alias("s")).collect()}
    assert back == {r["id"]: r["s"] for r in df.collect()}
    same = pii.protect(spark.createDataFrame([("equal",)] * 5, "s string"), [PiiRule("s", "encrypted")], KEY)
    assert same.distinct().count() == 5
    with pytest.raises(ValueError, match="no key"):
        pii.protect(df, [PiiRule("s", "encrypted")])


def test_nested_fields(spark):
    df = spark.createDataFrame([(1, (("deep", 5), "x"), {"k": "v", "o": "w"}), (2, None, None)], "id int, a struct<b:struct<c:string,d:int>,e:string>, m map<string,string>")
    got = pii.protect(df, [PiiRule("a.b.c", "masked"), PiiRule("a.b.d", "masked"), PiiRule("a", "masked"), PiiRule("m.k", "masked")]).collect()
    assert got[0]["a"]["b"] == ("****", "****") and got[0]["a"]["e"] == "x" and got[0]["m"] == {"k": "*", "o": "w"}
    assert got[1]["a"] is None
    for misspelt in ("a.none", "a.b.none", "mial", "m.k.deeper", "id.x"):
        with pytest.raises(ValueError, match="no field"):
            pii.protect(df, [PiiRule("a.e", "masked"), PiiRule(misspelt, "masked")])
        (row, _) = pii.protect(df, [PiiRule("a.e", "masked"), PiiRule(misspelt, "masked")], lacking="ignore").collect()
        assert row["a"]["e"] == "*" and row["a"]["b"] == ("deep", 5)


def test_fields_in_arrays_and_maps(spark):
    kind = "items array<struct<email:string,n:int>>, m map<string,struct<e:string,f:string>>, tags array<string>, deep array<array<struct<x:string>>>, c map<string,int>, l map<string,array<struct<p:string>>>"
    row = ([("a@b", 1), (None, 2), None], {"p": ("secret", "open"), "q": ("secret", "open"), "r": None}, ["xy", None], [[("abc",)], None, []], {"k": 5, "o": 6}, {"k": [("pp",)]})
    rules = [PiiRule(f, "masked") for f in ("items.email", "m.p.e", "tags", "deep.x", "c.k", "l.k.p")]
    got = pii.protect(spark.createDataFrame([row, (None,) * 6], kind), rules).collect()
    one = got[0].asDict(recursive=True)
    assert [x and (x["email"], x["n"]) for x in one["items"]] == [("***", 1), ("****", 2), None]
    assert one["m"] == {"p": {"e": "******", "f": "open"}, "q": {"e": "secret", "f": "open"}, "r": None}
    assert one["tags"] == ["**", "****"] and one["deep"] == [[{"x": "***"}], None, []] and one["c"] == {"k": "****", "o": "6"} and one["l"] == {"k": [{"p": "**"}]}
    assert all(x is None for x in got[1])
    sealed = pii.protect(spark.createDataFrame([row], kind), [PiiRule("items.email", "encrypted")], KEY)
    assert sealed.select(F.transform("items", lambda x: pii.decrypted(x["email"], KEY)).alias("x")).first()["x"] == ["a@b", None, None]


def test_change_scripts(spark):
    row = "struct<id:int,name:string>"
    kind = f"seq bigint, op string, before {row}, after {row}"
    for new, extra, changed in (("User_1", "Extra", "UpdatedName"), ("PgUser_1", "ExtraPg", "UpdatedPg")):
        log = [(1, "insert", None, (2, new)), (2, "insert", None, (3, extra)), (3, "update", (3, extra), (3, changed)), (4, "delete", (3, changed), None)]
        events = spark.createDataFrame(log, kind)
        replica = spark.createDataFrame([(1, "John")], "id int, name string")
        for twice in (events, events.unionAll(events)):
            last = changes.last_write_wins(changes.split_key_changes(changes.only_ops(twice), ["id"]), ["id"])
            once = changes.merge(replica, last, ["id"])
            assert sorted(tuple(r) for r in once.collect()) == [(1, "John"), (2, new)]
            assert sorted(tuple(r) for r in changes.merge(once, last, ["id"]).collect()) == [(1, "John"), (2, new)]


def test_snapshot_only_into_empty(spark):
    some = spark.range(3)
    assert changes.copy_if_empty(some, None) is some and changes.copy_if_empty(some, some.limit(0)) is some and changes.copy_if_empty(some, some) is None


def test_map_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"})], "old map<string,string>, new map<string,string>")
    assert [r["m"] for r in df.select(changes.merge_fields(F.col("old"), F.col("new")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}]


def test_row_differences_with_nulls(spark):
    s = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 1, "c")], "id int, x int, y string")
    t = spark.createDataFrame([(1, None, "a"), (2, 5, "B"), (4, 1, "d")], "id int, x int, y string")
    got = {r["id"]: (r["status"], r["fields"]) for r in reconcile.row_differences(s, t, ["id"]).collect()}
    assert got == {2: ("different", "x,y"), 3: ("missing", ""), 4: ("extra", "")}


def test_dead_letters_end(spark):
    df = spark.createDataFrame([(i, "insert", i) for i in range(4)], "seq bigint, op string, v int")
    letters = deadletter.letters(df, F.lit("b"), F.lit("bad"), deadletter.serialised(F.col("op"), F.col("seq"), F.struct("v")))
    for tries in range(1, 5):
        letters = deadletter.after_retry(letters, spark.createDataFrame([("b", "0")], "batch_id string, id string"))
        assert [r["retry_count"] for r in letters.collect()] == [min(tries, 3)] * 3
    assert deadletter.eligible(letters).count() == 0
    assert deadletter.statistics(letters).first() == (1, 3)
    assert deadletter.after_retry(letters, letters).count() == 0


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_exports_read_back(spark, tmp_path, kind):
    df = odd_rows(spark).where("id < 92")
    spec = BackupSpec(patterns=("^t_",), fields={"t_202401": ["id", "s"]}, format=kind)
    assert export.run(["t_202401", "other"], lambda _: df, spec, datetime(2024, 1, 1), str(tmp_path)) == {"t": "done"}
    path = str(tmp_path / "t")
    back = export.read_json_lines(spark, path, "id int, s string") if kind == "json" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id int, s string").csv(path)
    got, want = ({r["id"]: r["s"] or None for r in x.select("id", "s").collect()} for x in (back, df))
    if kind == "csv":
        assert {k: (v or "").replace("\r", "\n") for k, v in got.items()} == {k: (v or "").replace("\r", "\n") for k, v in want.items()}
    else:
        assert got == want


def test_failed_groups_do_not_stop_others(spark, tmp_path):
    spec = BackupSpec(tables=("good", "bad"), query={"bad": {"nothing": 1}}, format="sql")
    said = export.run([], lambda _: spark.range(2), spec, datetime(2024, 1, 1), str(tmp_path))
    assert said["good"] == "done" and said["bad"] != "done"
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "good")).collect()) == ["INSERT INTO `good` (`id`) VALUES (0);", "INSERT INTO `good` (`id`) VALUES (1);"]


def test_insert_statements_escape(spark):
    df = spark.createDataFrame([("it's", "a\\b\n", None, 5)], "a string, b string, c string, d int")
    assert export.insert_statements(df, "t").first()["value"] == "INSERT INTO `t` (`a`, `b`, `c`, `d`) VALUES ('it\\'s', 'a\\\\b\\n', NULL, 5);"


def test_malformed_lines_are_left_out(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert export.read_json_lines(spark, str(tmp_path), "a int").count() == 2


def test_key_value_source(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text("\n".join(f'{{"key": "user:{i}", "value": "User_{i}", "ttl_ms": {i}}}' for i in range(1, 6)) + '\n{"key": "h", "type": "hash", "value": {"f": "1"}}\n')
    spark.dataSource.register(KeyValueSource)
    df = spark.read.format("keyvalue").load(str(tmp_path))
    assert df.count() == 6 and df.where("type = 'hash'").first()["value"] == '{"f": "1"}'
    assert spark.read.format("keyvalue").option("prefix", "user:").load(str(tmp_path)).count() == 5


def test_ad_hoc_statements(spark):
    views = {"t": spark.range(3)}
    assert readers.ask(spark, "-- note\nSELECT count(*) AS last_update FROM t;", views).first()["last_update"] == 3
    assert readers.ask(spark, "SELECT ';drop' AS x, id FROM t", views, 2).count() == 2
    spark.range(7).createOrReplaceTempView("t")
    assert readers.ask(spark, "SELECT * FROM t", views).count() == 3 and spark.table("t").count() == 7
    spark.catalog.dropTempView("t")
    assert readers.ask(spark, "WITH q AS (SELECT id FROM t) SELECT max(id) AS m, (SELECT min(id) FROM q) AS n FROM q WHERE id IN (SELECT id FROM t) GROUP BY ALL HAVING m > 0", views).first() == (2, 0)
    assert readers.ask(spark, "SHOW TABLES").count() >= 0 and readers.ask(spark, "EXPLAIN SELECT 1").count() == 1 and readers.ask(spark, "VALUES (1), (2)").count() == 2
    for bad in (
        "DELETE FROM t", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "", "/* select */ DROP TABLE t",
        "WITH q AS (SELECT 1 AS a) /* x */ INSERT INTO victim SELECT a FROM q", "WITH q AS (SELECT 1 AS a) -- x\n INSERT OVERWRITE victim SELECT a FROM q", "FROM t INSERT INTO u SELECT *",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.name')", "SELECT id FROM t WHERE EXISTS (SELECT `Reflect`('a', 'b') FROM t)", "WITH q AS (SELECT try_reflect('a', 'b')) SELECT * FROM q",
        "SET a=b", "CACHE TABLE t", "CREATE TEMP VIEW v AS SELECT 1", "EXPLAIN INSERT INTO t SELECT 1", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t", "BEGIN SELECT 1; END", "ADD JAR 'x'", "USE x",
    ):
        with pytest.raises(PermissionError):
            readers.ask(spark, bad, views)


def test_jdbc_tables(spark):
    from tidewater.sources import writers

    url = {"url": "jdbc:derby:memory:tidewater;create=true"}
    df = spark.createDataFrame([(i, f"n{i}") for i in range(500)], "id int, name string")
    for _ in range(2):
        writers.append(df.repartition(6), "mysql", "people", url, 2)
    back = readers.snapshot(spark, "mysql", "people", url)
    assert back.count() == 1000 and {r["name"] for r in back.collect()} == {f"n{i}" for i in range(500)}
    split = readers.snapshot(spark, "jdbc", "people", url | {"partitionColumn": "id", "lowerBound": "0", "upperBound": "500"}, ["id"])
    assert split.rdd.getNumPartitions() == readers.PARTITIONS and split.where("id >= 490").count() == 20


def test_export_count_and_string_conditions(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": 2}\n  \n')
    assert export.record_count(spark, str(tmp_path)) == 2


def test_key_value_events(spark):
    store = spark.createDataFrame([("a", "string", "1", None, 50), ("h", "hash", None, {"x": "1"}, 9), ("z", "hash", None, {"x": "1"}, None)], "key string, type string, value string, fields map<string,string>, ttl_ms bigint")
    events = [("a", 1, "set", None, "2", None, 70), ("h", 2, "hset", None, None, {"y": "2"}, None), ("h", 3, "hset", None, None, {"x": "3"}, None), ("z", 4, "del", None, None, None, None), ("z", 5, "hset", None, None, {"n": "1"}, None)]
    events += [("n", 6, "copy", "list", "[1]", None, 8), ("a", 7, "hset", None, None, {"x": "0"}, None), ("g", 1, "hset", None, None, {"x": "1"}, None), ("g", 2, "del", None, None, None, None)]
    got = {r["key"]: (r["type"], r["value"], r["fields"], r["ttl_ms"]) for r in changes.apply_keys(store, spark.createDataFrame(events, "key string, seq bigint, op string, type string, value string, fields map<string,string>, ttl_ms bigint")).collect()}
    assert got == {"a": ("string", "2", None, None), "h": ("hash", None, {"x": "3", "y": "2"}, 9), "z": ("hash", None, {"n": "1"}, None), "n": ("list", "[1]", None, 8)}


def test_schemas(spark):
    df = spark.createDataFrame([], "b struct<x:int,y:array<string>>, a date, id bigint, z void")
    assert schema.described(df, ["id"]) == [("id", "int", True), ("a", "date", False), ("b", "object", False), ("b.x", "int", False), ("b.y", "array", False), ("z", "null", False)]
    docs = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5, "d": [1]}',), ("broken",)], "j string")
    assert dict(schema.flattened(schema.document_schema(docs, "j"))) == {"a": "float", "b": "object", "b.c": "string", "d": "array"}
    schema.clone_table(spark.range(3), "cloned_once", ["id"], 4)
    schema.clone_table(spark.range(3), "cloned_once")
    assert spark.table("cloned_once").count() == 0 and "cloned_once" in readers.matching_tables(spark, "oned_")


def test_statistics_never_pend_below_zero(spark):
    s = spark.createDataFrame([(1, "a", 5, 9, 0)], "task_id int, collection_name string, received int, executed int, pending int")
    (row,) = monitoring.upsert_statistics(s.limit(0), s).collect()
    assert row["pending"] == 0
