"""The change log: one ordered sequence of row changes with before-images.

Entries are ordered by (seq, pos): seq numbers the append, pos the entry in it.
Each append is one parquet folder per table, so that a before-image keeps its
table's types. An append exists once its commit does.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.sources.commits import Commits

#: A position behind all entries of an append.
END = 1 << 62
OPERATIONS = ("insert", "update", "delete")


def operation(name: object) -> str:
    """The operation in its one spelling; anything else is refused."""
    found = str(name).strip().lower()
    if found not in OPERATIONS:
        raise ValueError(f"{name!r} is not one of {OPERATIONS}")
    return found


def log_schema(table: T.StructType) -> T.StructType:
    """Columns of one table's entries; ``previous`` is null for inserts."""
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("row_id", T.StringType()),
            T.StructField("operation", T.StringType()),
            T.StructField("previous", T.StructType([T.StructField(f.name, f.dataType) for f in table])),
            T.StructField("created_at", T.TimestampType()),
        ]
    )


@dataclass(frozen=True)
class Append:
    seq: int
    folder: str
    tables: dict[str, int]


class ChangeLog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._commits = Commits(spark, f"{self.folder}/commits")

    @property
    def commit_folder(self) -> str:
        return self._commits.folder

    def append(self, changes: dict[str, DataFrame]) -> int:
        """Log (row_id, operation, previous) rows per table in one append; returns the entries written."""
        seq, name, counts = self._commits.latest()[0] + 1, uuid.uuid4().hex, {}
        for k, (table, rows) in enumerate(sorted(changes.items())):
            path = f"{self.folder}/data/{name}/{table}"
            # Tables of one append get positions of their own; ids within a table follow partitions.
            pos = F.monotonically_increasing_id() + F.lit(k << 52)
            rows.select(F.lit(seq).cast("long").alias("seq"), pos.alias("pos"), "row_id", "operation", "previous", F.current_timestamp().alias("created_at")).write.parquet(path)
            if n := self.spark.read.parquet(path).count():
                counts[table] = n
        if counts:
            self._commits.add(seq, {"folder": name, "tables": counts})
        return sum(counts.values())

    def appends(self, after: tuple[int, int]) -> list[Append]:
        """Appends that may hold entries after an offset, oldest first."""
        out = []
        for n in self._commits.numbers():
            if n > after[0] or n == after[0] and after[1] < END:
                entry = self._commits.read(n)
                out.append(Append(n, entry["folder"], entry["tables"]))
        return out

    def entries(self, table: str, schema: T.StructType, after: tuple[int, int], until: tuple[int, int] | None = None, appends: list[Append] | None = None) -> DataFrame | None:
        """Entries of a table in (after, until]; None if there is no folder to read."""
        found = [a for a in (self.appends(after) if appends is None else appends) if table in a.tables]
        if not found:
            return None
        rows = self.spark.read.schema(log_schema(schema)).parquet(*[f"{self.folder}/data/{a.folder}/{table}" for a in found])
        at = F.struct("seq", "pos")
        rows = rows.where(at > F.struct(F.lit(after[0]).cast("long").alias("seq"), F.lit(after[1]).cast("long").alias("pos")))
        if until is not None:
            rows = rows.where(at <= F.struct(F.lit(until[0]).cast("long").alias("seq"), F.lit(until[1]).cast("long").alias("pos")))
        return rows

    def end(self) -> tuple[int, int]:
        """An offset behind every entry logged so far."""
        last = self._commits.numbers()[-1:]
        return (last[0], END) if last else (0, 0)

    def changed(self, after: tuple[int, int], until: tuple[int, int]) -> set[str]:
        """Tables that may have entries in (after, until]."""
        return {t for a in self.appends(after) if a.seq <= until[0] for t in a.tables}

    def claim(self, after: tuple[int, int], limit: int, tables: dict[str, T.StructType]) -> tuple[tuple[int, int], int]:
        """(offset of the last, number) of the next ``limit`` entries of any table."""
        appends = self.appends(after)
        # Commits say how many entries an append has: whole appends are claimed without reading them.
        whole, at = 0, after
        for a in appends:
            if a.seq == after[0] or whole + sum(a.tables.values()) > limit:
                break
            whole, at = whole + sum(a.tables.values()), (a.seq, END)
        if whole or not appends:
            return at, whole
        frames = []
        for t in sorted({t for a in appends for t in a.tables}):
            schema = tables.get(t)
            paths = [f"{self.folder}/data/{a.folder}/{t}" for a in appends if t in a.tables]
            if schema is None:
                rows = self.spark.read.schema("seq long, pos long").parquet(*paths)
                rows = rows.where(F.struct("seq", "pos") > F.struct(F.lit(after[0]).cast("long").alias("seq"), F.lit(after[1]).cast("long").alias("pos")))
            else:
                rows = self.entries(t, schema, after, appends=appends)
            frames.append(rows.select("seq", "pos"))
        if not frames:
            return after, 0
        pending = frames[0]
        for f in frames[1:]:
            pending = pending.unionByName(f)
        # Only the cut is brought to the driver, never the entries.
        last = pending.orderBy("seq", "pos").limit(limit).agg(F.max(F.struct("seq", "pos")).alias("last"), F.count("*").alias("n")).first()
        if last["n"] < limit:
            return ((appends[-1].seq, END), last["n"]) if last["n"] else (after, 0)
        return (last["last"]["seq"], last["last"]["pos"]), last["n"]

    def pending(self, after: tuple[int, int]) -> int:
        """Entries in appends after an offset; an append claimed in part counts in full."""
        return sum(sum(a.tables.values()) for a in self.appends(after))

    def vacuum(self, before: tuple[int, int]) -> int:
        """Delete the data and commits of appends wholly before an offset; the newest commit stays, so numbers are not used again."""
        gone = 0
        for n in self._commits.numbers()[:-1]:
            if n < before[0]:
                self._commits.delete(f"{self.folder}/data/{self._commits.read(n)['folder']}")
                self._commits.delete(self._commits.file(n))
                gone += 1
        return gone
