"""Which cells a batch of changes may have touched.

Recomputing a cell that did not need it is harmless; missing one that did is
the only unforgivable bug. So rows are looked up not only as they are now but in
every version the pending log remembers, for all tables at once:

    V(t) = rows of t now, and every before-image of t in the pending log
    cells = distinct keys of V(fact) join V(parent) join ...
            where one of the joined rows is among those changed

with the fact filter off. A parent and a child that change before one drain are
thus found in every combination of their versions. There is one branch per
place at which a changed table stands; each starts from the changed rows, its
small side, and their keys narrow the scans of the changed table and of every
table up to the fact. Tables whose rows have no single key are looked through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.plans.joins import JoinPlan
from cubeloom.plans.keys import Keys
from cubeloom.plans.projection import Projection
from cubeloom.sources.changelog import ChangeLog


def versions(plan: JoinPlan, log: ChangeLog, table: str, after: tuple[int, int], appends) -> DataFrame:
    catalog = plan.catalog
    live = catalog.frame(table)
    logged = log.entries(table, catalog.schema(table), after, appends=appends)
    if logged is None:
        return live
    names = live.columns
    return live.unionByName(logged.where("previous is not null").select(*[F.col(f"previous.`{c}`").alias(c) for c in names]))


def affected_cells(plan: JoinPlan, projection: Projection, log: ChangeLog, after: tuple[int, int], until: tuple[int, int]) -> DataFrame | None:
    """Keys that entries in (after, until] may concern, maybe repeated; None if no table of the rollup changed."""
    catalog = plan.catalog
    appends = log.appends(after)
    tables = plan.tables()
    seen: dict[str, DataFrame] = {t: versions(plan, log, t, after, appends) for t in set(tables.values())}
    out = None
    for table in sorted(set(tables.values())):
        entries = log.entries(table, catalog.schema(table), after, until, appends)
        if entries is None:
            continue
        source = catalog.source(table)
        names = seen[table].columns
        ids = entries.select(F.col("row_id").alias("_changed")).distinct()
        keys, rows = None, seen[table]
        if len(source.key) == 1:
            keys = Keys.of(entries.select(F.col("row_id").try_cast(catalog.schema(table)[source.key[0]].dataType).alias("key")))
        if keys is not None:
            if keys.empty:
                continue
            rows = rows.where(keys.holds(source.key[0]))
        if keys is None or keys.values is None:
            rows = rows.select("*", source.row_id(names).alias("_row_id")).join(ids, F.col("_row_id") == F.col("_changed"), "left_semi")
        changed = rows.select(*[f"`{c}`" for c in names])
        for hops in plan.chains_of(table):
            replaced = {h: seen[t] for h, t in tables.items()} | {hops: changed} | referring(plan, seen, hops, keys)
            found = plan.frame(replaced, first=hops).select(*projection.keys())
            out = found if out is None else out.unionByName(found)
    return out


def referring(plan: JoinPlan, seen: dict[str, DataFrame], hops: tuple[str, ...], keys: Keys | None) -> dict[tuple[str, ...], DataFrame]:
    """The tables between a changed table at ``hops`` and the fact, each narrowed to rows that lead to the changed ones."""
    tables, out = plan.tables(), {}
    while hops and keys is not None and not keys.empty:
        below, hops = hops, hops[:-1]
        fk = plan.catalog.hop(tables[hops], below[-1]).fk
        out[hops] = seen[tables[hops]].where(keys.holds(fk))
        if hops:
            keys = Keys.of(out[hops].select(f"`{plan.catalog.source(tables[hops]).key[0]}`"))
    return out
