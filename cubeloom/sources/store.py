"""Rollup tables: hash-bucketed parquet under numbered commits.

A commit maps each bucket to the folder that holds it and carries the change-log
offset it accounts for, so data and progress become visible together. A write
replaces only the buckets it touches; readers keep the files of the commit they
opened. Within a bucket rows are sorted by key, which lets parquet skip row
groups by tenant.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.errors import StaleSchemaError
from cubeloom.sources.commits import Commits

BUCKET = "_bucket"
#: An offset before every change-log entry.
START = (0, 0)


@dataclass(frozen=True)
class Version:
    number: int
    buckets: dict[int, str]
    offset: tuple[int, int]
    built: bool


class RollupStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: tuple[str, ...], buckets: int) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        self._commits = Commits(spark, f"{self.folder}/commits")
        _, entry = self._commits.latest()
        #: The number of buckets is fixed by the first commit.
        self.buckets = int(entry.get("n_buckets", buckets))

    def version(self) -> Version:
        number, entry = self._commits.latest()
        if entry:
            stored = T.StructType.fromJson(entry["schema"])
            if [(f.name, f.dataType) for f in stored] != [(f.name, f.dataType) for f in self.schema]:
                raise StaleSchemaError(f"{self.folder} holds {stored.simpleString()}, declared is {self.schema.simpleString()}; backfill it anew")
        return Version(number, {int(k): v for k, v in entry.get("buckets", {}).items()}, tuple(entry.get("offset", START)), bool(entry))

    def replaceable(self) -> Version:
        """The version that a write of the whole table follows; its own schema doesn't matter."""
        number, entry = self._commits.latest()
        return Version(number, {}, tuple(entry.get("offset", START)), bool(entry))

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, version: Version | None = None, only: list[int] | None = None) -> DataFrame:
        version = version or self.version()
        paths = [p for b, p in version.buckets.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # Parquet columns are nullable; the declared flags are restored by the schema of the reader.
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in paths])

    def write(self, rows: DataFrame, base: Version, offset: tuple[int, int], only: list[int] | None = None) -> Version:
        """Commit ``rows`` as the contents of all buckets, or of ``only`` those; others stay as in ``base``."""
        kept = {} if only is None else {b: p for b, p in base.buckets.items() if b not in only}
        buckets = dict(kept)
        if only is None or only:
            name = f"v{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            path = f"{self.folder}/data/{name}"
            named = rows.select(*[F.col(f"`{f.name}`") for f in self.schema], self.bucket_of().alias(BUCKET))
            # One task per bucket and write, each bucket its own; within it rows are in key order.
            place = F.col(BUCKET) if only is None else (F.array_position(F.array(*[F.lit(b) for b in only]), F.col(BUCKET)) - 1).cast("int")
            named.repartitionById(len(only) if only else self.buckets, place).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).parquet(path)
            for child in self._commits.children(path):
                if child.startswith(f"{BUCKET}="):
                    buckets[int(child.split("=")[1])] = f"{name}/{child}"
        entry = {"buckets": buckets, "offset": list(offset), "schema": self.schema.jsonValue(), "n_buckets": self.buckets}
        self._commits.add(base.number + 1, entry)
        return Version(base.number + 1, buckets, offset, True)

    def advance(self, base: Version, offset: tuple[int, int]) -> Version:
        """Commit progress alone."""
        return self.write(None, base, offset, only=[]) if base.offset != offset else base

    def vacuum(self, keep: int = 2) -> int:
        """Delete data folders that none of the newest ``keep`` commits uses; returns how many."""
        used = {p.split("/")[0] for n in self._commits.numbers()[-keep:] for p in self._commits.read(n)["buckets"].values()}
        gone = [c for c in self._commits.children(f"{self.folder}/data") if c not in used]
        for name in gone:
            self._commits.delete(f"{self.folder}/data/{name}")
        return len(gone)
