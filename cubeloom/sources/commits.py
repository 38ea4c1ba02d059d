"""Numbered commit files in a folder: the whole of the engine's transaction protocol.

Commit ``n`` exists or it doesn't: its file is written aside and renamed to
``<n>.json`` only if no such file is there. A second writer of the same number
loses and is told. Readers take the highest number. Works on every file system
that Hadoop reaches and that renames atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from cubeloom.errors import ConcurrentWriteError


class Commits:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(self.file(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, entry) of the newest commit; (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def add(self, number: int, entry: dict) -> None:
        final = self._path(self.file(number))
        draft = self._path(f"{self.folder}/.{number}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConcurrentWriteError(f"commit {number} in {self.folder} was made by another writer")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def children(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []
