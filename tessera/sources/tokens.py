"""A streaming source of reply pieces, by the Python Data Source API.

A folder has files of JSON lines, a reply each ({"conv_id": 1, "text": "..."}); files are added, and never changed. An offset is the
number of files in the order of their names, and which name is the last: a batch is the files between two offsets, a task for
each, so the same offsets always give the same pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TokenReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size, self.files = options["path"], int(options.get("piece", 7)), int(options.get("files", 0))
        self.read_to = ""

    def _names(self) -> tuple[fs.FileSystem, list[str]]:
        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return system, sorted(found)

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        """The newest file; with the option `files` no more than so many after those read so far."""
        names = [n for n in self._names()[1] if n > self.read_to]
        if self.files:
            names = names[: self.files]
        self.read_to = names[-1] if names else self.read_to
        return {"last": self.read_to}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.read_to = max(self.read_to, end["last"])
        return [File(n) for n in self._names()[1] if start["last"] < n <= end["last"]]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = self._names()
        with system.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                if not line.strip():
                    continue
                row = json.loads(line)
                text = row.get("text") or ""
                cut = [text[k : k + self.size] for k in range(0, len(text), self.size)] or [None]
                for k, piece in enumerate(cut):
                    yield row["conv_id"], k, piece, k == len(cut) - 1

    def commit(self, end: dict) -> None:
        pass


class Tokens(DataSource):
    """Format `tokens`; options: path, piece (characters of a piece), files (most files of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "conv_id long, seq int, piece string, last boolean"

    def streamReader(self, schema) -> TokenReader:
        return TokenReader(self.options)


def token_stream(spark: SparkSession, path: str, piece: int = 7, files: int = 0):
    """conv_id, seq, piece and last as a stream."""
    spark.dataSource.register(Tokens)
    return spark.readStream.format("tokens").options(path=path, piece=piece, files=files).load()
