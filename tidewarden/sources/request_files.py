"""A stream of requests from a folder of JSON-lines files, with offsets that can be replayed.

Files are read in order of their names, lines in their order within a file; a file is complete when it appears (it is moved into the
folder) and a later one has a greater name. A request's seq is the number of its file, then that of its line, so it is the
same whenever it is read. Its time is its own field `at` (seconds), or when its file was last changed. An offset is the number
of files and the last name, so a batch that runs again reads the same files; a file that is put between others is an error.

register(spark), then readStream.format("request_files").option("path", ...): seq, secs, value. Blank lines are skipped; an empty
folder gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Lines that a file may have, as a power of two.
LINE_BITS = 32


@dataclass
class File(InputPartition):
    number: int
    name: str


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a stream of requests needs a path")
        self.path = options["path"]

    def _names(self) -> list[str]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:
        names = self._names()
        return {"files": len(names), "last": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[File]:
        names = self._names()
        for o in (start, end):
            if o["files"] and (len(names) < o["files"] or names[o["files"] - 1] != o["last"]):
                raise ValueError(f"the files up to {o['last']} have changed: names must rise")
        return [File(k, names[k]) for k in range(start["files"], end["files"])]

    def read(self, partition: File) -> Iterator[tuple[int, int, str]]:
        system, root = fs.FileSystem.from_uri(self.path)
        file = f"{root.rstrip('/')}/{partition.name}"
        changed = int(system.get_file_info(file).mtime.timestamp())
        with system.open_input_stream(file) as f:
            number, rest = 0, b""
            while True:
                data = f.read(1 << 20)
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if data else b""
                for line in lines:
                    if line.strip():
                        yield (partition.number << LINE_BITS) + number, self._time(line, changed), line.decode("utf-8", "replace")
                    number += 1
                if not data:
                    return

    @staticmethod
    def _time(line: bytes, changed: int) -> int:
        try:
            at = json.loads(line).get("at")
        except (ValueError, AttributeError):
            return changed
        return int(at) if isinstance(at, int | float) and not isinstance(at, bool) else changed


class RequestFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "request_files"

    def schema(self) -> str:
        return "seq bigint, secs bigint, value string"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RequestFiles)
