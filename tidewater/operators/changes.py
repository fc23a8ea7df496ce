"""Ordered change logs applied to keyed replicas, deterministically: of each key the change of the greatest seq holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of change events; an update and a replace both carry the whole new row.
OPS = ("insert", "update", "replace", "delete")


def only_ops(events: DataFrame, ops: Sequence[str] = OPS, ignore_deletes: bool = False) -> DataFrame:
    """Events of the known kinds; ignored deletes leave before anything is decided."""
    return events.where(F.col("op").isin([o for o in ops if not (ignore_deletes and o == "delete")]))


def not_stale(events: DataFrame, last: int) -> DataFrame:
    """Events of transactions that end at or after the last written position."""
    return events.where(F.col("txn_lsn") >= F.lit(last).cast("decimal(20,0)"))


def split_key_changes(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An update that changes the key becomes a delete of the old key and an upsert of the new one, at the same seq.

    events: seq, op, before, after (structs of the row). The result has key columns, seq, op and after.
    """
    before, after = (F.struct(*[F.col(f"{side}.{k}").alias(k) for k in keys]) for side in ("before", "after"))
    # the row goes with its change, so that the explosion has one input
    gone = lambda key: F.struct(key.alias("key"), F.lit("delete").alias("op"), F.when(F.lit(False), F.col("after")).alias("after"))
    upserted = F.struct(after.alias("key"), F.col("op").alias("op"), F.col("after"))
    moved = F.col("before").isNotNull() & F.col("after").isNotNull() & ~before.eqNullSafe(after)
    each = F.when(F.col("op") == "delete", F.array(gone(F.coalesce(F.when(F.col("before").isNotNull(), before), after))))
    each = each.when(moved, F.array(gone(before), upserted)).otherwise(F.array(upserted))
    return events.select("seq", F.explode(each).alias("x")).select("seq", "x.key.*", "x.op", "x.after")


def last_write_wins(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row a key: the change of the greatest order. A partial aggregation goes before the shuffle, so hot keys stay small."""
    rest = [c for c in changes.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order])
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("last")).select(*keys, "last.*")


def live(last: DataFrame) -> DataFrame:
    """Keys whose last change is no delete."""
    return last.where(F.col("op") != "delete")


def merge(replica: DataFrame, last: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The replica after one decided change a key: rows without change stay, the others come from `after`, deletes go.

    last: key columns, op, after (a struct of the replica's columns). A change without a row (no after) changes nothing.
    """
    known = last.where((F.col("op") == "delete") | F.col("after").isNotNull())
    match = [replica[k].eqNullSafe(known[k]) for k in keys]
    kept = replica.join(known, match, "left_anti")
    new = known.where(F.col("op") != "delete").select("after.*").select(*replica.columns)
    return kept.unionByName(new)


def keep_unchanged(after: Column, before: Column, present: Column, fields: Sequence[str]) -> Column:
    """The new row, with the old value of each field that the log marks as not sent (large values that did not change)."""
    return F.struct(*[F.when(F.coalesce(present.getField(f), F.lit(True)), after.getField(f)).otherwise(before.getField(f)).alias(f) for f in fields])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with those rows whose key it does not have; of rows of one key one."""
    once = rows.dropDuplicates(list(keys))
    return target.unionByName(once.join(target, [once[k].eqNullSafe(target[k]) for k in keys], "left_anti").select(*target.columns))


def copy_if_empty(source: DataFrame, target: DataFrame | None) -> DataFrame | None:
    """A snapshot is taken only into a target without rows; None where there is nothing to do."""
    return source if target is None or target.isEmpty() else None


def none_of(df: DataFrame) -> DataFrame:
    """A table without rows, of the same columns."""
    return df.sparkSession.createDataFrame([], df.schema)


def after_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target after a snapshot that only an empty one takes."""
    taken = copy_if_empty(source, target)
    return target if taken is None else taken


def present(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other side has; a null key is found nowhere."""
    return rows.join(known, list(keys), "left_semi")


def merge_fields(old: Column, new: Column) -> Column:
    """A hash's fields after an update of some of them."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def apply_hashes(hashes: DataFrame, events: DataFrame) -> DataFrame:
    """Key, fields after del and hset events (key, seq, op, fields): a del drops what came before it.

    The fields set after a key's last del are merged in order, over the stored ones where there was no del.
    """
    dels = events.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("gone"))
    sets = events.where("op = 'hset'").join(dels, "key", "left").where("gone is null or seq > gone")
    last = sets.select("key", "seq", F.explode("fields").alias("field", "value")).groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    stored = hashes.join(dels, "key", "left_anti").select("key", F.explode("fields").alias("field", "value"))
    left = stored.join(last, ["key", "field"], "left_anti").unionByName(last.select("key", "field", "value"))
    return left.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def apply_keys(store: DataFrame, events: DataFrame) -> DataFrame:
    """A key-value store after events, keys without value gone.

    store: key, type, value, fields (map), ttl_ms. events: key, seq, op, type, value, fields, ttl_ms. del drops a key; set
    makes it a string without time to live; copy takes type, value, fields and time to live as they are; hset merges
    fields into a hash and leaves its time to live. An hset on another type changes nothing, as the store refuses it.
    """
    columns = ["key", "type", "value", "fields", "ttl_ms"]
    none = F.lit(None)
    put = F.when(F.col("op") == "set", F.struct(F.lit("string").alias("type"), "value", none.cast("map<string,string>").alias("fields"), none.cast("bigint").alias("ttl_ms"), F.lit(False).alias("gone")))
    put = put.when(F.col("op") == "copy", F.struct("type", "value", "fields", "ttl_ms", F.lit(False).alias("gone")))
    put = put.when(F.col("op") == "del", F.struct(none.cast("string").alias("type"), none.cast("string").alias("value"), none.cast("map<string,string>").alias("fields"), none.cast("bigint").alias("ttl_ms"), F.lit(True).alias("gone")))
    whole = events.where("op in ('del', 'set', 'copy')").select("key", "seq", put.alias("state"))
    stored = store.select("key", F.lit(None).cast("long").alias("seq"), F.struct("type", "value", "fields", "ttl_ms", F.lit(False).alias("gone")).alias("state"))
    # of each key the last whole state, what was stored being before all events
    state = whole.unionByName(stored).groupBy("key").agg(F.max_by("state", F.coalesce("seq", F.lit(-(1 << 63)))).alias("state"), F.max("seq").alias("since"))
    sets = events.where("op = 'hset'").join(state, "key", "left").where("since is null or seq > since").where("state is null or state.gone or state.type = 'hash'")
    last = sets.select("key", "seq", F.explode("fields").alias("field", "x")).groupBy("key", "field").agg(F.max_by("x", "seq").alias("x"))
    fields = last.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "x")))).alias("set"))  # the fields of one hash
    both = state.join(fields, "key", "full_outer")
    hashed = F.col("set").isNotNull()
    alive = ~F.coalesce("state.gone", F.lit(True))
    out = both.where(alive | hashed).select(
        "key", F.when(hashed, F.lit("hash")).otherwise(F.col("state.type")).alias("type"), F.when(~hashed, F.col("state.value")).alias("value"),
        F.when(hashed, F.map_from_entries(F.sort_array(F.map_entries(merge_fields(F.when(alive, F.col("state.fields")), F.col("set")))))).otherwise(F.col("state.fields")).alias("fields"),
        F.when(alive, F.col("state.ttl_ms")).alias("ttl_ms"),
    )
    return out.select(*columns)


def keyspace_events(raw: DataFrame, database: int = 0) -> DataFrame:
    """seq, key, op from notifications (seq, channel, message) of a database's keys: del, set and hset, and copy for whatever else changed a key.

    A key that expired or was evicted is gone, as after del. What set, hset and copy put there is not in the notification:
    it is read from the store, and joined by key.
    """
    lead = f"__keyspace@{database}__:"
    message = F.lower("message")
    op = F.when(message.isin("del", "expired", "evicted"), "del").when(message.isin("set", "hset"), message).otherwise("copy")
    return raw.where(F.startswith("channel", F.lit(lead))).select("seq", F.substr("channel", F.lit(len(lead) + 1)).alias("key"), op.alias("op"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique, with their count: the check that stands for a unique index."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stream_messages(events: DataFrame) -> DataFrame:
    """Stream messages (id, fields) as rows of their own key, the same message once."""
    return events.dropDuplicates(["id"]).select(F.concat(F.lit("msg:"), F.col("id")).alias("key"), "fields")


def op_counts(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Received, executed and pending events of each stream, and those of each kind."""
    ok = F.col("op").isin(*OPS)
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("executed"),
        F.greatest(F.count(F.lit(1)) - F.count_if(ok), F.lit(0)).alias("pending"),
        F.count_if(F.col("op") == "insert").alias("inserted"), F.count_if(F.col("op").isin("update", "replace")).alias("updated"), F.count_if(F.col("op") == "delete").alias("deleted"),
    )
