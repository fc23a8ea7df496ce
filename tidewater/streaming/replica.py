"""Keyed replicas as versioned Parquet buckets, and change streams applied to them exactly once."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewater.operators.changes import OPS, last_write_wins, not_stale, only_ops, split_key_changes
from tidewater.operators.deadletter import LETTER, RETRIES, after_retry, eligible, event_type, letters_of, split

if TYPE_CHECKING:
    from tidewater.streaming.statistics import Statistics

_LIST, _LETTERS = "_replica.json", "_letters.json"


class Files:
    """The few small files of a replica, by Hadoop's file systems: any store that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: under another name first."""
        draft = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(self.path(draft), self.path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Replica:
    """A replica of rows by key, in hash buckets. A merge rewrites only the buckets that its changes touch.

    The list file names the folder of every bucket, and what the replica was made with: keys and number of buckets, which
    another opening must share. It is replaced last, so readers see a batch wholly or not at all. Each row carries the
    seq of its last change, and deletes stay as tombstones until `forget` drops them. So changes may come in any
    grouping, any number of times and from any number of checkpoints: what was applied before changes nothing.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def __post_init__(self) -> None:
        self._list()

    def _list(self) -> dict[str, Any]:
        text = Files(self.spark, self.path).read(_LIST)
        if not text:
            return {"batch": -1, "folders": {}}
        listed = json.loads(text)
        for name, ours in (("buckets", self.buckets), ("keys", list(self.keys))):
            if listed.get(name, ours) != ours:
                raise ValueError(f"the replica at {self.path} has {name} {listed[name]!r}, not {ours!r}")
        return listed

    def _put(self, listed: dict[str, Any]) -> None:
        Files(self.spark, self.path).write(_LIST, json.dumps(listed | {"buckets": self.buckets, "keys": list(self.keys)}))

    def prepare(self) -> None:
        """Make the replica where there is none; an existing one stays as it is."""
        if Files(self.spark, self.path).read(_LIST) is None:
            self._put(self._list())

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        schema = f"{self.schema}, _seq bigint, _gone boolean, _bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path.rstrip('/')}/{f}" for f in folders])

    @property
    def last_batch(self) -> int:
        return self._list()["batch"]

    @property
    def empty(self) -> bool:
        """Whether nothing was ever applied: only then a snapshot is taken."""
        return not self._list()["folders"]

    def read(self) -> DataFrame:
        """The replica's rows as of the last whole batch."""
        rows = self._rows(sorted(set(self._list()["folders"].values())))
        return rows.where("not _gone").drop("_seq", "_gone", "_bucket")

    def load(self, snapshot: DataFrame, seq: int = -1) -> int:
        """Apply a snapshot, as it stood at a position of the log: changes up to there do not win over it."""
        row = F.struct(*[F.col(f"`{f.name}`") for f in StructType.fromDDL(self.schema)])
        none = F.lit(None).cast(f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in StructType.fromDDL(self.schema))}>")
        return self.apply(snapshot.select(F.lit(seq).cast("long").alias("seq"), F.lit("insert").alias("op"), none.alias("before"), row.alias("after")), -1)

    def apply(self, events: DataFrame, batch: int, ignore_deletes: bool = False) -> int:
        """Apply events (seq, op, before, after); how many buckets were written. batch only names the folder."""
        listed = self._list()
        each = split_key_changes(only_ops(events, ignore_deletes=ignore_deletes), self.keys)
        # an upsert without its row changes nothing; at one seq a delete of the old key comes before the upsert
        each = each.where((F.col("op") == "delete") | F.col("after").isNotNull()).withColumn("rank", (F.col("op") != "delete").cast("int"))
        last = last_write_wins(each, self.keys, ("seq", "rank")).withColumn("_bucket", self._bucket())
        last = last.persist()
        try:
            touched = sorted(r["_bucket"] for r in last.select("_bucket").distinct().collect())  # at most the number of buckets
            if touched:
                stored = self._rows([listed["folders"][str(b)] for b in touched if str(b) in listed["folders"]])
                listed["folders"].update(self._written(self._merged(stored, last), f"batch-{max(batch, 0):012d}", touched))
            listed["batch"] = max(batch, listed["batch"])
            self._put(listed)
        finally:
            last.unpersist()
        return len(touched)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, name: str, touched: Sequence[int]) -> dict[str, str]:
        """Rows written by bucket, a large bucket in several files: the adaptive planner sizes the tasks."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path.rstrip('/')}/{folder}")
        return {str(b): f"{folder}/_bucket={b}" for b in touched}

    def _merged(self, stored: DataFrame, last: DataFrame) -> DataFrame:
        columns = [c for c in stored.columns if not c.startswith("_")]
        others = [c for c in columns if c not in self.keys]
        after = [F.col("after").getField(c).alias(c) for c in others]
        new = last.select(*self.keys, *after, F.col("seq").alias("_seq"), (F.col("op") == "delete").alias("_gone"))
        old = stored.select(*self.keys, *others, "_seq", "_gone")
        newest = last_write_wins(old.unionByName(new), self.keys, ("_seq",))
        return newest.select(*columns, "_seq", "_gone", self._bucket().alias("_bucket"))

    def rewrite(self, forget_before: int | None = None, buckets: int | None = None) -> None:
        """Write all rows anew: without tombstones of changes before a seq (when no older change can come any more), in another number of buckets."""
        listed = self._list()
        self.buckets = buckets or self.buckets
        rows = self._rows(sorted(set(listed["folders"].values()))).withColumn("_bucket", self._bucket())
        if forget_before is not None:
            rows = rows.where(~F.col("_gone") | (F.col("_seq") >= forget_before))
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most the number of buckets
        self._put({"batch": listed["batch"], "folders": self._written(rows, "batch-whole", touched) if touched else {}})

    def vacuum(self) -> int:
        """Remove folders that the list no longer names; the number removed."""
        files = Files(self.spark, self.path)
        used = {f.split("/")[0] for f in self._list()["folders"].values()}
        names = [s.getPath().getName() for s in files.fs.listStatus(files.path(""))]
        stale = [n for n in names if n.startswith("batch-") and n not in used]
        for n in stale:
            files.delete(n)
        return len(stale)


def known_events(events: DataFrame, keys: Sequence[str]) -> Column:
    """Whether an event can be applied at all: its seq, its key and, but for deletes, its row are there; kinds of events that we do not know are left out elsewhere."""
    whole = lambda side: reduce(Column.__and__, [F.col(f"{side}.{k}").isNotNull() for k in keys])
    gone = F.col("op") == "delete"
    row = F.when(gone, whole("before") | whole("after")).otherwise(whole("after"))
    return F.col("seq").isNotNull() & F.col("op").isNotNull() & (~F.col("op").isin(*OPS) | F.coalesce(row, F.lit(False)))


def follow(
    events: DataFrame, replica: Replica, checkpoint: str, once: bool = True, seconds: float = 2.0, prepare: Callable[[DataFrame], DataFrame] | None = None, ignore_deletes: bool = False,
    on_batch: Callable[[DataFrame, int], None] | None = None, letters: DeadLetters | None = None, valid: Callable[[DataFrame], Column] | None = None, since: int | None = None, counters: Statistics | None = None, stream: str = "",
) -> StreamingQuery:
    """Apply a change stream to a replica; the checkpoint keeps the position over restarts.

    prepare: for example field protection; it comes before all else, so nothing in clear is written anywhere. since:
    events of transactions that ended before this position (txn_lsn) are left out. letters: where events go that
    cannot be applied, by known_events and `valid`; without it such events are left out. counters: a count of the
    events of each kind under the name `stream`, taken in the same pass.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = prepare(df) if prepare else df
        df = not_stale(df, since) if since is not None else df
        seen = counters.observed(df) if counters is not None else None
        df = seen[0] if seen else df
        verdict = known_events(df, replica.keys)
        good, bad = split(df, verdict & F.coalesce(valid(df), F.lit(False)) if valid else verdict)
        replica.apply(good, number, ignore_deletes)
        if letters is not None:
            letters.add(only_known(bad, ignore_deletes), f"{name}-{number}", "cannot be applied")
        if seen:
            counters.add(stream, f"{name}-{number}", seen[1])
        if on_batch:
            on_batch(df, number)

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def only_known(bad: DataFrame, ignore_deletes: bool) -> DataFrame:
    return bad.where(~F.coalesce(F.col("op") == "delete", F.lit(False))) if ignore_deletes else bad


class DeadLetters:
    """Events that could not be applied, a row each: batch_id, id, write_model (the event as JSON), error, error_code, op_type, retry_count.

    A folder for each batch, named by the list file, which is replaced last; a batch that comes again replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str, row: str) -> None:
        self.spark, self.path, self.row = spark, path.rstrip("/"), row

    def _list(self) -> dict[str, str]:
        text = Files(self.spark, self.path).read(_LETTERS)
        return json.loads(text) if text else {}

    def _put(self, folders: dict[str, str]) -> None:
        Files(self.spark, self.path).write(_LETTERS, json.dumps(folders))

    def _written(self, rows: DataFrame, batch: str) -> str | None:
        """A folder of the rows; None where there are none."""
        folder = f"letters-{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        if self.spark.read.schema(LETTER).parquet(f"{self.path}/{folder}").isEmpty():
            Files(self.spark, self.path).delete(folder)
            return None
        return folder

    def add(self, rejected: DataFrame, batch: str, error: str) -> None:
        folders = self._list()
        folder = self._written(letters_of(rejected, F.lit(batch), F.lit(error)), batch)
        if folder or batch in folders:
            folders.pop(batch, None)
            self._put(folders | ({batch: folder} if folder else {}))

    def read(self) -> DataFrame:
        folders = sorted(self._list().values())
        return self.spark.read.schema(LETTER).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], LETTER)

    def retry(self, replica: Replica, valid: Callable[[DataFrame], Column] | None = None, ignore_deletes: bool = False, retries: int = RETRIES) -> int:
        """Apply once more what may be tried again, ignored deletes left out; how many letters are left.

        Operations that went through go, others count one more try, exhausted ones stay. If the driver stops between the
        replica's list and ours, the operations are applied again next time, which changes nothing.
        """
        left = self._list()
        for batch, folder in sorted(left.items()):
            stored = self.spark.read.schema(LETTER).parquet(f"{self.path}/{folder}")
            tried = eligible(stored, retries).withColumn("e", F.from_json("write_model", event_type(self.row)))
            wanted = tried.where(~F.coalesce(F.col("e.op") == "delete", F.lit(False))) if ignore_deletes else tried
            events = wanted.select("id", "e.*")
            good, _ = split(events, known_events(events, replica.keys) & (F.coalesce(valid(events), F.lit(False)) if valid else F.lit(True)))
            replica.apply(good, 0)
            # what was to be left out is settled too
            settled = good.select("id").unionAll(tried.select("id").exceptAll(wanted.select("id")))
            kept = self._written(after_retry(stored, settled.withColumn("batch_id", F.lit(batch)), retries), batch)
            left = {k: v for k, v in left.items() if k != batch} | ({batch: kept} if kept else {})
            self._put(left)
            Files(self.spark, self.path).delete(folder)
        return self.read().count()


#: Parts of messages, and codes, of errors that may pass by themselves.
PASSING = (
    "server selection timeout", "server selection error", "connection refused", "connection reset", "connection pool exhausted", "bad connection", "broken pipe", "network timeout", "i/o timeout", "timed out",
    "no reachable servers", "host unreachable", "not master", "write concern timeout", "read concern timeout", "cursor not found", "interrupted at shutdown", "temporarily unavailable",
)
PASSING_CODES = (11600, 11602, 10107, 189)
_CODE = re.compile("error code (?:" + "|".join(map(str, PASSING_CODES)) + ")(?![0-9])")
#: The whole message, or its end, that a closed connection gives.
_CLOSED = re.compile(r"(^|: )(unexpected )?eof$")


def may_pass(error: BaseException | str) -> bool:
    text = str(error).strip().lower()
    return any(p in text for p in PASSING) or _CODE.search(text) is not None or _CLOSED.search(text) is not None


def delays(first: float = 5.0, factor: float = 1.5, most: float = 300.0, retries: int = 10) -> list[float]:
    """Waits before each new start."""
    out = []
    for _ in range(retries):
        out.append(min(first, most))
        first *= factor
    return out


def supervised(start: Callable[[], StreamingQuery], waits: Sequence[float] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end, starting it anew after errors that may pass; how often that was. Other errors, and the last, are raised."""
    waits = delays() if waits is None else waits
    for tries in range(len(waits) + 1):
        try:
            start().awaitTermination()
            return tries
        except Exception as error:
            if tries == len(waits) or not may_pass(error):
                raise
            sleep(waits[tries])
    return len(waits)


def retried(call: Callable[[], Any], times: int = 5, first: float = 1.0, factor: float = 2.0, passing_only: bool = False, sleep: Callable[[float], None] = time.sleep) -> Any:
    """A call's result, tried again with growing waits."""
    for k in range(times):
        try:
            return call()
        except Exception as error:
            if k == times - 1 or (passing_only and not may_pass(error)):
                raise
            sleep(first * factor**k)
    return None


def progress(query: StreamingQuery) -> dict[str, Any]:
    """What a monitor shows of a running query, from its own last report."""
    last = query.lastProgress
    get = (lambda k: getattr(last, k, None)) if last is not None and not isinstance(last, dict) else (last or {}).get
    return {"running": query.isActive, "batch": get("batchId"), "rows": get("numInputRows"), "rows_per_second": get("processedRowsPerSecond")}
