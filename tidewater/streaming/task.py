"""A configured task from its settings to its replicas: targets, snapshots, then the change streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewater.config import PiiRule, TableMapping, Task
from tidewater.functions.pii import protect
from tidewater.operators.changes import duplicate_keys
from tidewater.streaming.replica import DeadLetters, Replica, delays, follow, supervised
from tidewater.streaming.statistics import Statistics


@dataclass
class TaskRun:
    """What runs a task. Everything is kept under one folder of the shared store, so a task that was stopped at any point goes on.

    snapshot: a source table as it stands; events: the change stream of a source table (seq, op, before, after); valid: which
    events the target takes (all that have their key and row, if not given); position: where in the log the snapshots stand.
    """

    spark: SparkSession
    task: Task
    folder: str
    snapshot: Callable[[str], DataFrame]
    events: Callable[[str], DataFrame]
    key: bytes | None = None
    valid: Callable[[DataFrame], Column] | None = None
    position: int = -1
    buckets: int = 64
    sleep: Callable[[float], None] = time.sleep
    statistics: Statistics = field(init=False)

    def __post_init__(self) -> None:
        self.folder = self.folder.rstrip("/")
        self.statistics = Statistics(self.spark, self.task.id, f"{self.folder}/_statistics")

    def protected(self, df: DataFrame, mapping: TableMapping, sides: tuple[str, ...] = ("",)) -> DataFrame:
        """Rows, or with sides events, with the fields protected that the task says; the rules are those of the source's mapping."""
        return protect(df, [PiiRule(f"{s}{r.field}", r.kind) for r in self.task.rules_of(mapping.source) for s in sides], self.key)

    def replica(self, mapping: TableMapping) -> Replica:
        """The target of a mapping, under its own name; protected fields have the type that protection gives them."""
        made = self.protected(self.snapshot(mapping.source).limit(0), mapping).schema
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.fields)
        return Replica(self.spark, f"{self.folder}/{mapping.target}", mapping.keys, ddl, self.buckets)

    def letters(self, mapping: TableMapping) -> DeadLetters:
        made = self.protected(self.snapshot(mapping.source).limit(0), mapping).schema
        return DeadLetters(self.spark, f"{self.folder}/_letters/{mapping.source}", made.simpleString())

    def prepare(self) -> None:
        """Targets of all mappings, and a check of the keys that are to be unique; a mapping without keys is an error."""
        for m in self.task.mappings:
            if not m.keys:
                raise ValueError(f"the mapping of {m.source} has no keys")
            self.replica(m).prepare()
            if m.sync_indexes and not duplicate_keys(self.snapshot(m.source), m.keys).isEmpty():
                raise ValueError(f"the keys of {m.source} are not unique: {', '.join(m.keys)}")

    def load(self, mapping: TableMapping) -> bool:
        """Take the snapshot, if the target never got anything; whether it was taken."""
        target = self.replica(mapping)
        if not target.empty:
            return False
        target.load(self.protected(self.snapshot(mapping.source), mapping), self.position)
        return True

    def follow(self, mapping: TableMapping, once: bool = True) -> StreamingQuery:
        return follow(
            self.events(mapping.source), self.replica(mapping), f"{self.folder}/_checkpoints/{mapping.source}", once, prepare=lambda df: self.protected(df, mapping, ("before.", "after.")),
            ignore_deletes=mapping.ignore_deletes, letters=self.letters(mapping), valid=self.valid, counters=self.statistics, stream=mapping.source,
        )

    def retry_letters(self) -> int:
        """Try what could not be applied once more; how many letters are left."""
        return sum(self.letters(m).retry(self.replica(m), self.valid, m.ignore_deletes) for m in self.task.mappings)

    def run(self, once: bool = True) -> None:
        """Targets, snapshots, then every stream to its end (or, with once=False, until one fails for good), started anew after errors that may pass."""
        if not self.task.enabled:
            return
        self.prepare()
        for m in self.task.mappings:
            self.load(m)
        waits = delays(self.task.retry_delay_s)
        if once:
            for m in self.task.mappings:
                supervised(lambda m=m: self.follow(m), waits, self.sleep)
            return
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max(1, len(self.task.mappings))) as pool:
            for done in [pool.submit(supervised, lambda m=m: self.follow(m, False), waits, self.sleep) for m in self.task.mappings]:
                done.result()


def reloads(read: Callable[[], list[Task]], seconds: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[list[Task], list[Task]]]:
    """(tasks to start, tasks to stop) at first and whenever the settings have changed; a changed task stops and starts."""
    known: dict[int, Task] = {}
    while True:
        now = {t.id: t for t in read() if t.enabled}
        start, stop = [t for k, t in now.items() if known.get(k) != t], [t for k, t in known.items() if now.get(k) != t]
        if start or stop:
            yield start, stop
        known = now
        sleep(seconds)
