"""Rebuilding cells or slices from the source in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions.scalars import around_days
from cubeloom.plans.joins import JoinPlan
from cubeloom.plans.keys import EXACT, LISTED, Keys
from cubeloom.plans.projection import Projection, same_cell
from cubeloom.sources.store import RollupStore, Version

class Recompute:
    def __init__(self, plan: JoinPlan, projection: Projection, store: RollupStore, broadcast_cells: int) -> None:
        self.plan, self.projection, self.store, self.broadcast_cells = plan, projection, store, broadcast_cells

    def source_rows(self, between: tuple | None = None) -> DataFrame:
        """The rollup as the source has it now; at least the days of ``between``, if given."""
        joined = self.plan.frame()
        if between is not None and self.projection.definition.temporal:
            joined = joined.where(self.projection.around(*between))
        return self.projection.aggregated(joined)

    def _within(self, about: dict[str, Keys]) -> dict[tuple[str, ...], Column]:
        """Conditions that hold for all cells, by the hops of the table they read, on columns a scan can skip by."""
        out: dict[tuple[str, ...], Column] = {}
        for d in self.projection.definition.dimensions:
            keys = about.get(d.name)
            if keys is None:
                continue
            column = F.col(f"`{d.path.column}`")
            raw = self.plan.catalog.field_at(self.projection.definition.fact.source, d.path).dataType
            if d.role == "time" and not isinstance(raw, T.DateType):
                one = around_days(column, raw, keys.low, keys.high)
                one = one | column.isNull() if keys.nulls else one
            else:
                one = keys.holds(d.path.column)
            out[d.path.hops] = out[d.path.hops] & one if d.path.hops in out else one
        return out

    def _narrowed(self, about: dict[str, Keys]) -> DataFrame:
        """The joined rows, every scan narrowed to what the cells' values allow.

        Where the table that holds the day (or else the tenant) stands directly
        below the fact and few of its rows qualify, their keys narrow the fact.
        """
        tables, within, definition = self.plan.tables(), self._within(about), self.projection.definition
        replaced = {h: self.plan.catalog.frame(tables[h]).where(c) for h, c in within.items()}
        for d in (definition.time, definition.tenant):
            hops = d.path.hops[:1] if d is not None else ()
            if len(hops) != 1 or hops not in within or about.get(d.name) is None or about[d.name].values is None:
                continue
            rows = replaced[hops]
            for path, value in definition.fact.where:
                if path.hops == hops:
                    c = F.col(f"`{path.column}`")
                    rows = rows.where(c.isNull() if value is None else c == F.lit(value))
            key = rows.select(f"`{self.plan.catalog.source(tables[hops]).key[0]}`")
            few = [r[0] for r in key.limit(LISTED + 1).collect()] if isinstance(key.schema[0].dataType, EXACT) else None
            if few is not None and len(few) <= LISTED:
                fk = self.plan.catalog.hop(tables[()], hops[0]).fk
                replaced[()] = replaced.get((), self.plan.catalog.frame(tables[()])).where(Keys.listed(few).holds(fk))
                break
        return self.plan.frame(replaced)

    def _rebuilt(self, cells: DataFrame, about: dict[str, Keys]) -> DataFrame:
        """What the source says about ``cells``."""
        keys = self.store.keys
        named = [self.projection.key(d).alias(f"_key_{d.name}") for d in self.projection.definition.dimensions]
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"_key_{k}").eqNullSafe(F.col(f"c.`{k}`"))
        rows = self.projection.filtered(self._narrowed(about)).select("*", *named).join(cells.alias("c"), on, "left_semi")
        fresh = rows.groupBy(*[F.col(f"_key_{k}").alias(k) for k in keys]).agg(*[self.projection.aggregate(m) for m in self.projection.definition.measures])
        return fresh.select(*self.store.schema.names)

    def _replaced(self, cells: DataFrame, about: dict[str, Keys], buckets: list[int], base: Version, offset: tuple[int, int]) -> Version:
        kept = self.store.read(base, only=buckets).alias("s").join(cells.alias("c"), same_cell("s", "c", self.store.keys), "left_anti")
        return self.store.write(kept.unionByName(self._rebuilt(cells, about)), base, offset, only=sorted(buckets))

    def _fit(self, name: str) -> bool:
        return isinstance(self.store.schema[name].dataType, EXACT)

    def cells(self, cells: DataFrame, base: Version, offset: tuple[int, int]) -> tuple[Version, int]:
        """Replace the rows of ``cells`` (keys, maybe repeated) by what the source says; returns the new version and the number of cells.

        Up to LISTED cells are brought to the driver and planned with; more stay
        distributed, and their number, counted first, says whether they are broadcast.
        """
        keys = self.store.keys
        cells = cells.select(*keys).distinct().withColumn("_bucket", self.store.bucket_of()).persist()
        try:
            few = cells.limit(LISTED + 1).toArrow()
            if not few.num_rows:
                return self.store.advance(base, offset), 0
            if few.num_rows <= LISTED:
                about = {k: Keys.listed(set(few.column(k).to_pylist())) for k in keys if self._fit(k)}
                local = cells.sparkSession.createDataFrame(few.drop_columns("_bucket"), T.StructType([T.StructField(k, self.store.schema[k].dataType) for k in keys]))
                return self._replaced(F.broadcast(local), about, sorted(set(few.column("_bucket").to_pylist())), base, offset), few.num_rows
            facts = [F.count("*").alias("n"), F.collect_set("_bucket").alias("buckets")]  # as many as there are buckets
            for k in keys:
                facts += [F.min(k).alias(f"lo_{k}"), F.max(k).alias(f"hi_{k}"), F.max(F.col(k).isNull()).alias(f"nulls_{k}")]
            found = cells.agg(*facts).first()
            about = {k: Keys(found[f"lo_{k}"], found[f"hi_{k}"], None, found[f"nulls_{k}"]) for k in keys if self._fit(k) and found[f"lo_{k}"] is not None}
            named = cells.drop("_bucket")
            return self._replaced(F.broadcast(named) if found["n"] <= self.broadcast_cells else named, about, list(found["buckets"]), base, offset), found["n"]
        finally:
            cells.unpersist()

    def slice(self, name: str, matches, base: Version, offset: tuple[int, int]) -> Version:
        """Replace all rows whose key column ``name`` satisfies ``matches`` (a function from Column to Column)."""
        d = next(d for d in self.projection.definition.dimensions if d.name == name)
        hit = matches(self.projection.key(d))
        fresh = self.projection.aggregated(self.plan.frame().where(hit))
        kept = self.store.read(base).where(~F.coalesce(matches(F.col(name)), F.lit(False)))
        return self.store.write(kept.unionByName(fresh), base, offset)

    def everything(self, base: Version, offset: tuple[int, int]) -> Version:
        return self.store.write(self.source_rows(), base, offset)
