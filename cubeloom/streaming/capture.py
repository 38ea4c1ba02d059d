"""What to log: which tables, and which of their columns can move a row between cells or change a number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.model.definition import Definition
from cubeloom.sources.catalog import Catalog, Source


@dataclass(frozen=True)
class TablePolicy:
    """``columns`` are those whose update is logged; None logs every update. Inserts and deletes always are."""

    table: str
    columns: tuple[str, ...] | None


def _path_columns(catalog: Catalog, fact: str, path, watched: dict[str, set[str]]) -> None:
    """The foreign key at each hop, on the table being left, and the last column."""
    at = fact
    for hop in path.hops:
        edge = catalog.hop(at, hop)
        watched.setdefault(at, set()).add(edge.fk)
        at = edge.target
    if path.column is not None:
        watched.setdefault(at, set()).add(path.column)


def watched_columns(definition: Definition, catalog: Catalog) -> dict[str, tuple[str, ...] | None]:
    """Per table what one rollup needs logged. Facts and tables that measures read can't be narrowed: measures are any SQL."""
    fact = definition.fact.source
    watched: dict[str, set[str]] = {}
    for path in (*definition.watched_paths, *definition.filter_paths):
        _path_columns(catalog, fact, path, watched)
    whole = {fact}
    for path in definition.measure_paths:
        whole.update(catalog.table_at(fact, path.hops[:n]) for n in range(1, len(path.hops) + 1))
    return {t: None if t in whole else tuple(sorted(watched[t])) for t in sorted({*watched, *whole})}


def capture_policy(definitions: list[Definition], catalog: Catalog) -> dict[str, TablePolicy]:
    """The union over rollups: adding a rollup never narrows what another needs."""
    merged: dict[str, set[str] | None] = {}
    for d in definitions:
        for table, columns in watched_columns(d, catalog).items():
            if columns is None or (table in merged and merged[table] is None):
                merged[table] = None
            else:
                merged[table] = merged.get(table, set()) | set(columns)
    return {t: TablePolicy(t, None if c is None else tuple(sorted(c))) for t, c in sorted(merged.items())}


def row_changes(source: Source, before: DataFrame, after: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(row_id, operation, previous) that lead from ``before`` to ``after``.

    With a key, rows are matched by it, and an update counts only if one of
    ``columns`` changed. Without, whole rows are compared with multiplicity, so
    a change is a delete and an insert.
    """
    names = before.columns
    after = after.select(*names)
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    if not source.key:
        ident = source.row_id(names)
        gone = before.exceptAll(after).select(ident.alias("row_id"), F.lit("delete").alias("operation"), whole.alias("previous"))
        new = after.exceptAll(before).select(ident.alias("row_id"), F.lit("insert").alias("operation"), F.lit(None).cast(before.select(whole).schema[0].dataType).alias("previous"))
        return gone.unionByName(new)
    ident = source.row_id(names)
    old = before.select(ident.alias("row_id"), whole.alias("previous"))
    new = after.select(ident.alias("new_id"), whole.alias("current"))
    both = old.join(new, F.col("row_id") == F.col("new_id"), "full_outer")
    look = [c for c in (columns if columns is not None else names)]
    moved = F.lit(False)
    for c in look:
        moved = moved | ~F.col(f"previous.`{c}`").eqNullSafe(F.col(f"current.`{c}`"))
    kind = F.when(F.col("row_id").isNull(), "insert").when(F.col("new_id").isNull(), "delete").when(moved, "update")
    return both.select(F.coalesce("row_id", "new_id").alias("row_id"), kind.alias("operation"), "previous").where("operation is not null")
