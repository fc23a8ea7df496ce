"""A key-value dump as a Python data source: one JSON object a line with key, type, ttl_ms and value."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "key string, type string, ttl_ms bigint, value string"


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class KeyValueReader(DataSourceReader):
    """Each file is a partition. Paths are what pyarrow's filesystems open, local or not."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("prefix", "")

    def _filesystem(self) -> tuple[object, str]:
        import pyarrow.fs

        path = re.sub(r"^file:/(?!/)", "file:///", self.path)
        return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs

        fs, base = self._filesystem()
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = self._filesystem()
        with fs.open_input_stream(partition.path) as file:
            import io

            for line in io.TextIOWrapper(io.BufferedReader(file), encoding="utf-8"):
                if line.strip():
                    x = json.loads(line)
                    if x["key"].startswith(self.pattern):
                        value = x.get("value")
                        yield x["key"], x.get("type", "string"), x.get("ttl_ms"), value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class KeyValueSource(DataSource):
    """spark.dataSource.register(KeyValueSource); spark.read.format("keyvalue").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "keyvalue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeyValueReader(dict(self.options))
