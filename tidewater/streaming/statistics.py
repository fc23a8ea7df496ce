"""Counters of change streams, kept by micro-batch."""

from __future__ import annotations

import json
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewater.operators.changes import OPS
from tidewater.streaming.replica import Files

_NAMES = ("received", "executed", "inserted", "updated", "deleted")


class Statistics:
    """Counters by (task, collection), in a small file of the shared store, so a restart goes on from them.

    Counting is part of the pass that applies a batch. A batch that comes again is counted once: the last one of each
    stream is kept with the counters.
    """

    def __init__(self, spark: SparkSession, task_id: int, path: str) -> None:
        self.task_id, self.files = task_id, Files(spark, path)
        self.lock = threading.Lock()

    def _kept(self) -> dict[str, dict]:
        text = self.files.read(f"statistics-{self.task_id}.json")
        return json.loads(text) if text else {}

    def observed(self, events: DataFrame) -> tuple[DataFrame, Observation]:
        """The events, with an observation that holds their counts once they are read."""
        seen = Observation(f"counts-{uuid.uuid4().hex}")
        kind = lambda *ops: F.count_if(F.col("op").isin(*ops))
        made = (F.count(F.lit(1)), kind(*OPS), kind("insert"), kind("update", "replace"), kind("delete"))
        return events.observe(seen, *[c.cast("long").alias(n) for n, c in zip(_NAMES, made, strict=True)]), seen

    def add(self, collection: str, batch: str, seen: Observation) -> None:
        try:
            row = seen.get
        except Py4JJavaError:
            row = {}  # an empty input is planned away, and its observation with it
        with self.lock:
            kept = self._kept()
            mine = kept.setdefault(collection, dict.fromkeys(_NAMES, 0) | {"batch": None})
            if mine["batch"] == batch:
                return
            kept[collection] = {n: mine[n] + int(row.get(n) or 0) for n in _NAMES} | {"batch": batch}
            self.files.write(f"statistics-{self.task_id}.json", json.dumps(kept))

    def rows(self) -> list[tuple]:
        """task_id, collection_name, received, executed, pending, inserted, updated, deleted."""
        with self.lock:
            return [(self.task_id, c, t["received"], t["executed"], max(t["received"] - t["executed"], 0), t["inserted"], t["updated"], t["deleted"]) for c, t in sorted(self._kept().items())]


class Progress(StreamingQueryListener):
    """The last report of every query: spark.streams.addListener(Progress())."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.last[str(event.id)] = {"name": event.name, "running": True, "rows": 0}

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        known = self.last.setdefault(str(p.id), {"name": p.name, "running": True, "rows": 0})
        known.update(batch=p.batchId, rows=known["rows"] + p.numInputRows, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.last.setdefault(str(event.id), {}).update(running=False, error=event.exception)
