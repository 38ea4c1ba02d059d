"""The joined rows of a rollup: the fact and, once per chain of hops, each table it leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.errors import AssociationError
from cubeloom.model.definition import Definition
from cubeloom.model.path import alias_of
from cubeloom.sources.catalog import Catalog


class JoinPlan:
    def __init__(self, definition: Definition, catalog: Catalog) -> None:
        self.definition, self.catalog = definition, catalog
        self.chains = definition.hop_chains

    def tables(self) -> dict[tuple[str, ...], str]:
        """Every alias's chain of hops with its table; the empty chain is the fact."""
        source = self.definition.fact.source
        return {(): source} | {h: self.catalog.table_at(source, h) for h in self.chains}

    def chains_of(self, table: str) -> list[tuple[str, ...]]:
        """All places at which a table stands; it may be reached by several routes."""
        return [h for h, t in self.tables().items() if t == table]

    def frame(self, replaced: dict[tuple[str, ...], DataFrame] | None = None, first: tuple[str, ...] = ()) -> DataFrame:
        """Inner joins along the hops; ``replaced`` puts other rows in a table's place.

        ``first`` names the alias to start from, for plans whose small side is
        not the fact: its chain up to the fact is joined before the rest.
        """
        replaced = replaced or {}
        tables = self.tables()

        def rows(hops):
            frame = replaced[hops] if hops in replaced else self.catalog.frame(tables[hops])
            return frame.alias(alias_of(hops))

        upward = [first[:n] for n in range(len(first), -1, -1)]
        out = rows(upward[0])
        for below, hops in zip(upward, upward[1:], strict=False):
            out = out.join(rows(hops), self._on(below, tables), "inner")
        for hops in self.chains:
            if hops not in upward:
                out = out.join(rows(hops), self._on(hops, tables), "inner")
        return out

    def _on(self, hops: tuple[str, ...], tables: dict):
        parent, edge = tables[hops[:-1]], self.catalog.hop(tables[hops[:-1]], hops[-1])
        key = self.catalog.source(edge.target).key
        if len(key) != 1:
            raise AssociationError(f"{parent}.{hops[-1]} leads to {edge.target}, which has no single-column key")
        return F.col(f"{alias_of(hops[:-1])}.`{edge.fk}`") == F.col(f"{alias_of(hops)}.`{key[0]}`")
