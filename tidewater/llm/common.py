"""What several corpus operators share: shared scratch tables, row keys and document helpers."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

class _Scratch:
    """The scratch paths of a session, removed one by one, or all together when the session stops or the program ends."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []
        self.own: list[str] = []
        self.watched: set[int] = set()

    def add(self, spark: SparkSession, path: str) -> None:
        self.paths.append((spark, path))
        context = spark.sparkContext
        if id(context) not in self.watched:
            self.watched.add(id(context))
            stop = context.stop

            def stopped() -> None:
                """Once the session has stopped, its file systems cannot be asked any more."""
                self.clear(context)
                stop()

            context.stop = stopped

    def remove(self, gone: set[str | None]) -> None:
        for entry in [x for x in self.paths if x[1] in gone]:
            self._delete(*entry)
            self.paths.remove(entry)

    def clear(self, context: object = None) -> None:
        for entry in [x for x in self.paths if context is None or x[0].sparkContext is context]:
            try:
                self._delete(*entry)
            except Exception:  # noqa: BLE001 - the store may be gone, and nothing may keep a session from stopping
                _log.warning("scratch not removed: %s", entry[1])
            self.paths.remove(entry)
        for path in self.own if context is None else []:
            shutil.rmtree(path, ignore_errors=True)

    def _delete(self, spark: SparkSession, path: str) -> None:
        if spark.sparkContext._jsc is None:
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_log = logging.getLogger(__name__)
_scratch = _Scratch()
atexit.register(_scratch.clear)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset and the session runs on this machine alone, one of our own, removed at the end; elsewhere an error,
    as executors would write to disks that the others do not see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tidewater-")
        _scratch.own.append(made)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session stops."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.add(spark, path)
    return path


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back, so that a lost executor costs no recomputation. by: columns it is parted by."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove the scratch tables of frames that materialize gave and no later plan reads."""
    _scratch.remove({getattr(f, "scratch", None) for f in frames if f is not None} - {None})


def scratch_mark() -> int:
    """A point in the list of scratch paths, for release_since."""
    return len(_scratch.paths)


def release_since(mark: int, *kept: DataFrame) -> None:
    """Remove the scratch made since a point, but for the tables of these frames."""
    keep = {getattr(f, "scratch", None) for f in kept}
    _scratch.remove({path for _, path in _scratch.paths[mark:]} - keep)


def others(df: DataFrame, taken: list[str]) -> list[Column]:
    """The columns of df but for those that a result column of the same name replaces."""
    low = {x.lower() for x in taken}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one column, so that no column of ours can clash with one of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def unpacked(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The packed row's columns again, with the made ones beside or in place of them."""
    low = {x.lower() for x in made}
    kept = [F.col("doc").getField(c).alias(c) for c in columns if c.lower() not in low]
    return df.select(*kept, *[x.alias(n) for n, x in made.items()])


def binary_tree(key: Column, bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted bounds are <= key, as a balanced CASE tree: log2 of the bounds per row, inside codegen."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < F.lit(bounds[mid]), binary_tree(key, bounds, low, mid)).otherwise(binary_tree(key, bounds, mid + 1, high))
