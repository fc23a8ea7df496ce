"""Queries of snapshots, change logs and dead letters. The events table is read as a change log of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import changes, deadletter, export, reconcile
from tidewater.plans.registry import query, table

#: What the events of the table stand for.
_OP = {"signup": "insert", "view": "update", "click": "update", "purchase": "replace", "error": "delete"}
_OP_SQL = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'update' END"


def _op() -> F.Column:
    out = F.lit("update")
    for event, op in _OP.items():
        out = F.when(F.col("event_type") == event, op).otherwise(out)
    return out


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, user_id, op, after of each event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", _op().alias("op"), F.struct("user_id", "event_type", "value", "ts").alias("after"))


@query(f"""
WITH log AS (SELECT *, {_OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, event_type, value, ts, event_id AS seq FROM log WHERE rn = 1 AND op <> 'delete'
""")
def cdc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = changes.last_write_wins(changes.only_ops(change_log(spark, sf_dir)), ["user_id"])
    return changes.live(last).select("user_id", "after.event_type", "after.value", "after.ts", "seq")


@query(f"""
WITH log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE {_OP_SQL} <> 'delete')
SELECT user_id, event_type, value, ts, event_id AS seq FROM log WHERE rn = 1
""")
def cdc_replay_ignore_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = changes.last_write_wins(changes.only_ops(change_log(spark, sf_dir), ignore_deletes=True), ["user_id"])
    return last.select("user_id", "after.event_type", "after.value", "after.ts", "seq")


@query("""
WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events),
decided AS (SELECT * FROM last WHERE rn = 1)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM decided)
UNION ALL SELECT user_id, 'from ' || event_type, value FROM decided WHERE event_type <> 'error'
""")
def cdc_merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log merged into a snapshot of customers, of whom most have no event."""
    replica = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = F.struct(F.col("user_id").alias("c_custkey"), F.concat(F.lit("from "), F.col("event_type")).alias("c_name"), F.col("value").alias("c_acctbal"))
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("c_custkey"), _op().alias("op"), after.alias("after"))
    return changes.merge(replica, changes.last_write_wins(log, ["c_custkey"]), ["c_custkey"])


@query("""
WITH moved AS (
  SELECT o_orderkey * 2 AS seq, o_orderkey AS k, 'insert' AS op, o_totalprice AS price FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, 'delete', NULL FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey <> 0
  UNION ALL SELECT o_orderkey * 2 + 1, -o_orderkey, 'update', o_totalprice FROM orders WHERE o_orderkey % 5 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM moved)
SELECT k AS o_orderkey, price AS o_totalprice, seq FROM ranked WHERE rn = 1 AND op <> 'delete'
""")
def cdc_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order gets another key by an update."""
    row = lambda key: F.struct(key.alias("o_orderkey"), F.col("o_totalprice").alias("o_totalprice"))
    orders = table(spark, sf_dir, "orders")
    old, new = row(F.col("o_orderkey")), row(-F.col("o_orderkey"))
    none = F.lit(None).cast("struct<o_orderkey:bigint,o_totalprice:double>")
    inserts = orders.select((F.col("o_orderkey") * 2).alias("seq"), F.lit("insert").alias("op"), none.alias("before"), old.alias("after"))
    updates = orders.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 2 + 1).alias("seq"), F.lit("update").alias("op"), old.alias("before"), new.alias("after"))
    each = changes.split_key_changes(inserts.unionAll(updates), ["o_orderkey"])
    return changes.live(changes.last_write_wins(each, ["o_orderkey"])).select("o_orderkey", "after.o_totalprice", "seq")


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE -value END AS value, event_type FROM events
""")
def cdc_keep_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the log marks as not sent keep their old value."""
    e = table(spark, sf_dir, "events")
    after = F.struct((-F.col("value")).alias("value"), F.col("event_type"))
    before = F.struct(F.col("value"), F.lit("old").alias("event_type"))
    present = F.struct((F.col("event_type") != "click").alias("value"), F.lit(True).alias("event_type"))
    return e.select("event_id", changes.keep_unchanged(after, before, present, ["value", "event_type"]).alias("row")).select("event_id", "row.*")


@query("""
WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' WHEN 'view' THEN '?' ELSE 'u' END AS k FROM events)
SELECT user_id AS task_id, floor(value / 100)::BIGINT AS collection_name, count(*) AS received, count(*) FILTER (k <> '?') AS executed, count(*) FILTER (k = '?') AS pending,
  count(*) FILTER (k = 'i') AS inserted, count(*) FILTER (k = 'u') AS updated, count(*) FILTER (k = 'd') AS deleted
FROM e GROUP BY ALL
""")
def cdc_op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for events of a kind that is not applied."""
    op = F.when(F.col("event_type") == "view", "ddl").otherwise(_op())
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.floor(F.col("value") / 100).alias("collection_name"), op.alias("op"))
    return changes.op_counts(e, ["task_id", "collection_name"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'error')")
def cdc_op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("op", _op())
    return changes.only_ops(e, ["insert", "delete"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, (event_id * 16)::DECIMAL(20,0) AS txn_lsn FROM events WHERE event_id * 16 >= 4096")
def cdc_stale_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.functions.names import lsn, lsn_column

    text = F.concat(F.lit("0/"), F.hex(F.col("event_id") * 16))
    return changes.not_stale(table(spark, sf_dir, "events").select("event_id", lsn_column(text).alias("txn_lsn")), lsn("0/1000"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'copied' AS target FROM orders
UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'kept' FROM orders
""")
def snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into an empty target, and a target with rows, which stays as it is."""
    orders = table(spark, sf_dir, "orders")
    filled = orders.withColumn("o_orderkey", -F.col("o_orderkey"))
    into_empty, into_filled = (changes.after_copy(orders, target) for target in (changes.none_of(orders), filled))
    return into_empty.withColumn("target", F.lit("copied")).unionAll(into_filled.withColumn("target", F.lit("kept")))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 <> 0
""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return changes.insert_if_absent(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("""
WITH sets AS (SELECT e.user_id, e.event_id, e.event_type, e.value FROM events e LEFT JOIN
  (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id) d ON e.user_id = d.user_id
  WHERE e.event_type <> 'error' AND (gone IS NULL OR e.event_id > gone)),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM sets)
SELECT user_id AS key, string_agg(event_type || '=' || event_id::VARCHAR, ',' ORDER BY event_type) AS fields FROM last WHERE rn = 1 GROUP BY user_id
""")
def hash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event sets a field of its user's hash; an error deletes the hash."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "del").otherwise("hset")
    events = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.create_map("event_type", F.col("event_id").cast("string")).alias("fields"))
    none = spark.createDataFrame([], "key bigint, fields map<string,string>")
    done = changes.apply_hashes(none, events)
    return done.select("key", F.array_join(F.transform(F.map_entries("fields"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"))


@query("""
WITH e AS (SELECT user_id AS key, event_id AS seq, value, CASE event_type WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'copy' ELSE 'hset' END AS op, event_type FROM events),
whole AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM e WHERE op <> 'hset'),
state AS (SELECT * FROM whole WHERE rn = 1),
hashed AS (
  SELECT e.key, e.event_type, max(e.seq) AS seq FROM e LEFT JOIN state s ON s.key = e.key
  WHERE e.op = 'hset' AND (s.seq IS NULL OR e.seq > s.seq) AND (s.op IS NULL OR s.op <> 'set') GROUP BY ALL
),
sets AS (SELECT key, string_agg(event_type || '=' || seq::VARCHAR, ',' ORDER BY event_type) AS x FROM hashed GROUP BY key),
keys AS (SELECT key FROM state WHERE op <> 'del' UNION SELECT key FROM sets)
SELECT k.key, CASE WHEN s.op = 'set' THEN 'string' ELSE 'hash' END AS type, CASE WHEN s.op = 'set' THEN s.seq::VARCHAR END AS value,
  CASE WHEN s.op = 'copy' THEN concat_ws(',', x.x, 'zcopied=' || s.seq::VARCHAR) ELSE x.x END AS fields, CASE WHEN s.op = 'copy' THEN s.seq * 10 END AS ttl_ms
FROM keys k LEFT JOIN state s USING (key) LEFT JOIN sets x USING (key)
""")
def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors delete a user's key, purchases set it, signups copy a hash with its time to live, others set a field."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "signup", "copy").otherwise("hset")
    seq = F.col("event_id").cast("string")
    field = F.when(F.col("event_type") == "signup", F.lit("zcopied")).otherwise(F.col("event_type"))
    events = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.lit("hash").alias("type"), F.when(op == "set", seq).alias("value"), F.create_map(field, seq).alias("fields"), (F.col("event_id") * 10).alias("ttl_ms"))
    store = spark.createDataFrame([], "key bigint, type string, value string, fields map<string,string>, ttl_ms bigint")
    text = F.array_join(F.transform(F.map_entries("fields"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return changes.apply_keys(store, events).select("key", "type", "value", text.alias("fields"), "ttl_ms")


@query("SELECT 'msg:' || conv_id::VARCHAR || '-' || turn::VARCHAR AS key, role, text FROM conversations")
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    made = changes.stream_messages(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.struct("role", "text").alias("fields")))
    return made.select("key", "fields.*")


@query("SELECT event_id, user_id, event_type, value < 20 AS rejected FROM events")
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    good, bad = deadletter.split(e, F.col("value") >= 20)
    both = good.withColumn("rejected", F.lit(False)).unionAll(bad.withColumn("rejected", F.lit(True)))
    return both.select("event_id", "user_id", "event_type", "rejected")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", _op().alias("op"), "value")
    payload = deadletter.serialised(F.col("op"), F.col("user_id"), F.struct("value"))
    _, bad = deadletter.split(e, F.col("value") >= 20)
    made = deadletter.letters(bad, F.col("user_id"), F.lit("too small"), payload)
    # a letter's age stands for its earlier tries
    return made.withColumn("retry_count", (F.col("id").cast("long") % 5).cast("int"))


@query("""
WITH bad AS (SELECT user_id, count(*) AS n FROM events WHERE value < 20 GROUP BY user_id)
SELECT count(*) AS batches, coalesce(sum(n), 0)::BIGINT AS failed_operations FROM bad
""")
def dlq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.statistics(_letters(spark, sf_dir))


@query("SELECT user_id AS batch_id, event_id::VARCHAR AS id, (event_id % 5)::INT AS retry_count FROM events WHERE value < 20 AND event_id % 5 < 3")
def dlq_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.eligible(_letters(spark, sf_dir)).select(F.col("batch_id").cast("long").alias("batch_id"), "id", "retry_count")


@query("""
WITH bad AS (SELECT user_id, event_id, event_id % 5 AS r FROM events WHERE value < 20),
after AS (SELECT user_id, CASE WHEN r < 3 THEN r + 1 ELSE r END AS r FROM bad WHERE NOT (r < 3 AND event_id % 2 = 0))
SELECT user_id AS batch_id, count(*) AS total_operations, sum(r)::BIGINT AS tries FROM after GROUP BY user_id
""")
def dlq_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retry in which the even operations succeed."""
    letters = _letters(spark, sf_dir)
    done = deadletter.eligible(letters).where("id % 2 = 0")
    left = deadletter.after_retry(letters, done)
    return left.groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("total_operations"), F.sum("retry_count").alias("tries"))


@query(f"""
SELECT event_id, {_OP_SQL} AS op, user_id::VARCHAR AS filter, value AS document, {_OP_SQL} IN ('update', 'replace') AS upsert FROM events
""")
def dlq_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("op", _op())
    text = deadletter.serialised(F.col("op"), F.col("user_id"), F.struct("value"))
    return e.select("event_id", deadletter.deserialised(text, "struct<value:double>").alias("x")).select("event_id", F.col("x.type").alias("op"), "x.filter", F.col("x.document.value").alias("document"), "x.upsert")


@query("""
WITH s AS (SELECT o_orderstatus AS "table", count(*) AS n FROM orders GROUP BY 1), t AS (SELECT o_orderstatus AS "table", count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus <> 'P' GROUP BY 1)
SELECT "table", coalesce(s.n, -1) AS src_row_count, coalesce(t.n, -1) AS tgt_row_count, abs(coalesce(s.n, -1) - coalesce(t.n, -1)) AS difference FROM s FULL JOIN t USING ("table")
""")
def row_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = lambda df: df.groupBy(F.col("o_orderstatus").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.paired_counts(counts(orders), counts(orders.where("o_orderkey % 10 <> 0 AND o_orderstatus <> 'P'")))


_COPY_SQL = """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT -o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 100 = 1
), d AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
    CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra'
      WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'different' END AS status,
    CASE WHEN s.o_orderkey IS NULL OR t.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
      CASE WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'o_totalprice' END, CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END) END AS fields
  FROM orders s FULL JOIN t ON s.o_orderkey = t.o_orderkey)
"""


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = s.where("o_orderkey % 10 <> 0").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END").alias("o_totalprice"),
        F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END").alias("o_orderstatus"),
    )
    extra = s.where("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", "o_orderstatus")
    return reconcile.row_differences(s, changed.unionAll(extra), ["o_orderkey"])


@query(_COPY_SQL + "SELECT * FROM d WHERE status IS NOT NULL")
def row_diff_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir)


@query(_COPY_SQL + "SELECT status, count(*) AS n FROM d WHERE status IS NOT NULL GROUP BY status")
def row_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.difference_summary(_difference(spark, sf_dir))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def existence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return changes.present(table(spark, sf_dir, "customer").select("c_custkey"), known, ["c_custkey"])


@query("SELECT to_json({event_id: event_id, event_type: event_type, user_id: CASE WHEN user_id % 2 = 0 THEN user_id END})::VARCHAR.replace(',\"user_id\":null', '') AS value FROM events")
def export_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id")
    return export.json_lines(table(spark, sf_dir, "events").select("event_id", "event_type", user))


@query("""SELECT 'INSERT INTO `nation` (`n_nationkey`, `n_name`) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS value FROM nation""")
def export_insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.insert_statements(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation")
