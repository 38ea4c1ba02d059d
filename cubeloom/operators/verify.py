"""Comparing a rollup with its source, cell by cell."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.errors import VerificationError
from cubeloom.model.definition import Definition

KINDS = ("wrong", "missing", "extra")
#: Discrepancies a report lists at most; all are counted, and repair works on all.
LISTED = 1000


@dataclass(frozen=True)
class Discrepancy:
    kind: str
    cell: dict[str, Any]
    stored: dict[str, Any] | None
    expected: dict[str, Any] | None

    def __str__(self) -> str:
        where = ", ".join(f"{k}={v}" for k, v in self.cell.items())
        return f"{self.kind}: {where}: stored {self.stored}, expected {self.expected}"


@dataclass(frozen=True)
class Report:
    rollup: str
    counts: dict[str, int]
    listed: tuple[Discrepancy, ...]
    repaired: int = 0

    @property
    def clean(self) -> bool:
        return self.count == 0

    @property
    def count(self) -> int:
        return sum(self.counts.values())

    def count_of(self, kind: str) -> int:
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is not one of {KINDS}")
        return self.counts.get(kind, 0)

    def with_repaired(self, n: int) -> Report:
        return replace(self, repaired=n)

    def __str__(self) -> str:
        if self.clean:
            return f"{self.rollup}: agrees with its source"
        head = f"{self.rollup}: {self.count} cells disagree ({', '.join(f'{n} {k}' for k, n in sorted(self.counts.items()))})"
        tail = [f"{self.repaired} repaired"] if self.repaired else []
        return "\n  ".join([head, *map(str, self.listed), *tail])


def scope(definition: Definition, frame: DataFrame, tenant: Any, between: tuple | None) -> DataFrame:
    if tenant is not None:
        frame = frame.where(F.col(definition.tenant.name) == F.lit(tenant))
    if between is not None:
        if not definition.temporal:
            raise VerificationError(f"{definition.name} has no time dimension to be verified between dates")
        frame = frame.where(F.col(definition.time.name).between(*[F.lit(b) for b in between]))
    return frame


def discrepancies(definition: Definition, stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(keys, stored_<measure>, expected_<measure>, kind) of cells that differ.

    Both sides are united with a mark and folded by key: one shuffle, null keys
    match, and a side's absence is told from nulls in its measures.
    """
    names = [m.name for m in definition.measures]
    both = stored.select("*", F.lit(1).alias("_side")).unionByName(expected.select("*", F.lit(2).alias("_side")))
    pick = lambda side, n: F.max(F.when(F.col("_side") == side, F.col(n)))
    folded = both.groupBy(*definition.keys).agg(
        *[pick(1, n).alias(f"stored_{n}") for n in names],
        *[pick(2, n).alias(f"expected_{n}") for n in names],
        F.count(F.when(F.col("_side") == 1, 1)).alias("_in_stored"),
        F.count(F.when(F.col("_side") == 2, 1)).alias("_in_expected"),
    )
    differ = F.lit(False)
    for n in names:
        differ = differ | ~F.col(f"stored_{n}").eqNullSafe(F.col(f"expected_{n}"))
    kind = F.when(F.col("_in_stored") == 0, "missing").when(F.col("_in_expected") == 0, "extra").when(differ, "wrong")
    return folded.withColumn("kind", kind).where("kind is not null").drop("_in_stored", "_in_expected")


def report(definition: Definition, found: DataFrame) -> Report:
    names = [m.name for m in definition.measures]
    counts = Counter({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()})
    rows = found.orderBy(*[F.col(k).asc_nulls_last() for k in definition.keys]).limit(LISTED).collect() if counts else []
    listed = []
    for r in rows:
        side = lambda s, r=r: {n: r[f"{s}_{n}"] for n in names}
        listed.append(Discrepancy(r["kind"], {k: r[k] for k in definition.keys}, None if r["kind"] == "missing" else side("stored"), None if r["kind"] == "extra" else side("expected")))
    return Report(definition.name, dict(counts), tuple(listed))
