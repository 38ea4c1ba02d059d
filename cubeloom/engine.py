"""The engine: rollups of one catalog, kept in one folder."""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.config import Config
from cubeloom.errors import ChangeLogOverflowError, ConcurrentWriteError, CubeError
from cubeloom.model.definition import Definition, Rollup
from cubeloom.operators import verify as verification
from cubeloom.operators.cells import affected_cells
from cubeloom.operators.query import Query
from cubeloom.operators.recompute import Recompute
from cubeloom.plans.joins import JoinPlan
from cubeloom.plans.keys import Keys
from cubeloom.plans.projection import Projection
from cubeloom.registry import Registry
from cubeloom.sources.catalog import Catalog
from cubeloom.sources.changelog import ChangeLog
from cubeloom.sources.store import START, RollupStore
from cubeloom.streaming.capture import TablePolicy, capture_policy, row_changes
from cubeloom.streaming.drain import drain_stream

AnyRollup = type[Rollup] | Definition | str


class Engine:
    """Explicit context for everything: there is no global state beside the class declarations."""

    def __init__(self, spark: SparkSession, catalog: Catalog, folder: str, config: Config | None = None) -> None:
        self.spark, self.catalog, self.folder = spark, catalog, folder.rstrip("/")
        self.config = config or Config()
        self.registry = Registry(catalog)
        self.log = ChangeLog(spark, f"{self.folder}/{self.config.log_name}")
        self.logger = logging.getLogger(self.config.logger)
        self._stores: dict[str, RollupStore] = {}

    # Declarations

    def register(self, *rollups: type[Rollup] | Definition) -> Engine:
        for r in rollups:
            self.registry.register(r)
        return self

    def bind(self, *rollups: type[Rollup]) -> Engine:
        """Register classes and let them be read, built and verified through this engine by their own methods."""
        for r in rollups:
            self.registry.register(r)
            r.bound_engine = self
        return self

    def _definition(self, rollup: AnyRollup) -> Definition:
        if isinstance(rollup, str):
            return self.registry.lookup(rollup)
        d = rollup if isinstance(rollup, Definition) else rollup.definition()
        if d not in self.registry.definitions():
            self.registry.register(d)
        return d

    def plan(self, rollup: AnyRollup) -> JoinPlan:
        return JoinPlan(self._definition(rollup), self.catalog)

    def projection(self, rollup: AnyRollup) -> Projection:
        return Projection(self._definition(rollup), self.catalog, self.config.time_zone)

    def store(self, rollup: AnyRollup) -> RollupStore:
        d = self._definition(rollup)
        if d.name not in self._stores:
            name = d.table_name(self.config.table_prefix)
            self._stores[d.name] = RollupStore(self.spark, f"{self.folder}/{name}", self.projection(d).schema(), d.keys, self.config.buckets)
        return self._stores[d.name]

    def _recompute(self, d: Definition) -> Recompute:
        return Recompute(self.plan(d), self.projection(d), self.store(d), self.config.broadcast_cells)

    def describe(self, rollup: AnyRollup) -> str:
        """Table, schema, joins and capture of a rollup, as text."""
        d = self._definition(rollup)
        lines = [f"{d.table_name(self.config.table_prefix)} ({d.name})"]
        lines += [f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' not null'}{' key' if f.name in d.keys else ''}" for f in self.projection(d).schema()]
        lines += [f"  joins {'.'.join(h)}: {t}" for h, t in self.plan(d).tables().items() if h]
        lines += [f"  logs {p.table}: {'every update' if p.columns is None else ', '.join(p.columns)}" for p in capture_policy([d], self.catalog).values()]
        return "\n".join(lines)

    # Reading

    def rows(self, rollup: AnyRollup) -> DataFrame:
        """The rollup table as committed."""
        return self.store(rollup).read()

    def query(self, rollup: AnyRollup) -> Query:
        d = self._definition(rollup)
        return Query(d, d.table_name(self.config.table_prefix), lambda: self.rows(d))

    def live_query(self, rollup: AnyRollup) -> Query:
        """The same reads straight from the source, for comparison."""
        d = self._definition(rollup)
        return Query(d, d.table_name(self.config.table_prefix), lambda: self._recompute(d).source_rows())

    def register_views(self) -> list[str]:
        names = []
        for d in self.registry.definitions():
            self.rows(d).createOrReplaceTempView(name := d.table_name(self.config.table_prefix))
            names.append(name)
        return names

    # Building

    def slices(self, rollup: AnyRollup, from_: Any = None) -> DataFrame:
        """Distinct days (or tenants, without a time dimension) that have data, in order, nulls last."""
        d = self._definition(rollup)
        p = self.projection(d)
        key = p.key(d.time or d.tenant)
        rows = p.filtered(self.plan(d).frame())
        if from_ is not None:
            rows = rows.where(self._from(d, p, from_))
        return rows.select(key.alias("slice")).distinct().orderBy(F.col("slice").asc_nulls_last())

    @staticmethod
    def _from(d: Definition, p: Projection, from_: Any):
        late = p.key(d.time or d.tenant) >= F.lit(from_)
        return late & p.around(first=from_) if d.temporal else late

    def backfill(self, rollup: AnyRollup, from_: Any = None, pause: float = 0.0, on_slice: Callable[[Any, int, int], None] | None = None, group: int | None = None) -> int:
        """Build from history; returns the number of slices rebuilt.

        Without ``from_`` the table is replaced whole, so cells whose source rows
        are gone go too. With it, the slices from there on that have data are
        replaced. Either way in one commit: no reader sees a slice half-built.
        ``on_slice(value, number, of)`` is called for every slice after that,
        ``pause`` seconds apart.

        ``group`` commits so many slices at a time, each after the other: the
        callback and the pause come between commits, and a build that failed
        goes on with ``from_`` at the last slice it told of.
        """
        d = self._definition(rollup)
        store, recompute = self.store(d), self._recompute(d)
        offset = self.log.end()
        if group is not None:
            return self._backfill_groups(d, from_, pause, on_slice, group, offset)
        name = (d.time or d.tenant).name
        if from_ is None:
            # The table that was written says which slices there are.
            written = store.read(recompute.everything(store.replaceable(), offset))
            return self._told(written.select(name).distinct(), pause, on_slice)
        base = store.version()
        fresh = self.projection(d).aggregated(self.plan(d).frame().where(self._from(d, self.projection(d), from_))).persist()
        try:
            # The list of days or tenants is a small table; it is joined, not listed in the plan.
            wanted = fresh.select(F.col(name).alias("slice")).distinct()
            kept = store.read(base).alias("s").join(wanted, F.col(f"s.{name}") == F.col("slice"), "left_anti")
            # A partial build doesn't account for older changes elsewhere: the log offset stays.
            store.write(kept.unionByName(fresh), base, base.offset if base.built else START)
            return self._told(wanted, pause, on_slice)
        finally:
            fresh.unpersist()

    def _told(self, slices: DataFrame, pause: float, on_slice: Callable[[Any, int, int], None] | None) -> int:
        """The number of slices in a one-column frame, each told to ``on_slice`` in order, nulls last."""
        if on_slice is None:
            return slices.count()
        ordered = [r[0] for r in slices.orderBy(F.col(f"`{slices.columns[0]}`").asc_nulls_last()).collect()]  # days or tenants
        for i, value in enumerate(ordered, 1):
            on_slice(value, i, len(ordered))
            clock.sleep(pause)
        return len(ordered)

    def _backfill_groups(self, d: Definition, from_: Any, pause: float, on_slice: Callable[[Any, int, int], None] | None, group: int, offset: tuple[int, int]) -> int:
        store, recompute, name = self.store(d), self._recompute(d), (d.time or d.tenant).name
        wanted = [r["slice"] for r in self.slices(d, from_).collect()]  # days or tenants
        done = store.version()
        before = done.offset if done.built else START
        for at in range(0, len(wanted), group):
            part = wanted[at : at + group]
            matches = Keys.listed(part).holds
            done = recompute.slice(name, matches, done, before)
            for i, value in enumerate(part, at + 1):
                if on_slice is not None:
                    on_slice(value, i, len(wanted))
            clock.sleep(pause)
        if from_ is None:
            # What no slice holds any more goes, and with it the changes logged before the build began are accounted for.
            known = Keys.listed(wanted).holds
            store.write(store.read(done).where(F.coalesce(known(F.col(f"`{name}`")), F.lit(False))), done, offset)
        return len(wanted)

    def recompute_cells(self, rollup: AnyRollup, cells: DataFrame) -> int:
        """Rebuild the given cells (columns: the keys); returns how many."""
        d = self._definition(rollup)
        base = self.store(d).version()
        return self._recompute(d).cells(cells, base, base.offset)[1]

    def recompute_slice(self, rollup: AnyRollup, value: Any) -> None:
        """Rebuild one day, or one tenant of a rollup without time; null is a slice too."""
        d = self._definition(rollup)
        base = self.store(d).version()
        self._recompute(d).slice((d.time or d.tenant).name, lambda c: c.eqNullSafe(F.lit(value)), base, base.offset)

    # Changes

    def capture_policy(self) -> dict[str, TablePolicy]:
        return capture_policy(self.registry.definitions(), self.catalog)

    def record(self, table: str, before: DataFrame, after: DataFrame) -> int:
        """Log what leads from ``before`` to ``after``, as narrowly as the registered rollups allow; returns the entries."""
        return self.record_all({table: (before, after)})

    def record_all(self, states: dict[str, tuple[DataFrame, DataFrame]]) -> int:
        """Log the changes of several tables in one append."""
        policy = self.capture_policy()
        changes = {}
        for table, (before, after) in states.items():
            if table in policy:
                changes[table] = row_changes(self.catalog.source(table), before, after, policy[table].columns)
        return self.log.append(changes)

    def mutate(self, **after: DataFrame) -> int:
        """Put tables in new states: log the changes, then let the catalog serve the new rows."""
        logged = self.record_all({t: (self.catalog.frame(t), frame) for t, frame in after.items()})
        for t, frame in after.items():
            self.catalog.replace(t, frame)
        return logged

    def pending(self) -> int:
        return self.log.pending(self._oldest_offset())

    def _oldest_offset(self) -> tuple[int, int]:
        offsets = [self.store(d).version().offset for d in self.registry.definitions()]
        return min(offsets) if offsets else START

    def drain_step(self, limit: int | None = None) -> int:
        """Claim the next entries, recompute the cells they may have touched, commit; returns the entries claimed.

        Each rollup commits its rows and its offset together, so a crash between
        two rollups, or a repeated call, applies nothing twice.
        """
        definitions = self.registry.definitions()
        if not definitions:
            return 0
        start = self._oldest_offset()
        schemas = {t: self.catalog.schema(t) for t in self.registry.tables()}
        until, claimed = self.log.claim(start, limit or self.config.batch_size, schemas)
        if not claimed:
            return 0
        for d in definitions:
            self._apply(d, until)
        return claimed

    def _apply(self, d: Definition, until: tuple[int, int]) -> None:
        """Bring one rollup up to an offset; if another writer commits meanwhile, take it up from there."""
        for attempt in range(self.config.commit_attempts):
            store = self.store(d)
            base = store.version()
            if base.offset >= until:
                return
            if not base.built:
                raise CubeError(f"{d.name} was never built; backfill it before draining")
            try:
                # Rollups that none of the changed tables concerns are not planned at all.
                concerned = any(d in self.registry.for_table(t) for t in self.log.changed(base.offset, until))
                cells = affected_cells(self.plan(d), self.projection(d), self.log, base.offset, until) if concerned else None
                if cells is None:
                    store.advance(base, until)
                else:
                    self._recompute(d).cells(cells, base, until)
                return
            except ConcurrentWriteError as e:
                self.logger.info("%s: %s; reading it again", d.name, e)
                if attempt + 1 == self.config.commit_attempts:
                    raise

    def drain(self, limit: int | None = None, max_seconds: float | None = None) -> int:
        """Steps until the log is empty or the time is up; at least one. Returns the entries claimed."""
        most = self.config.max_pending
        if most is not None and (n := self.pending()) > most:
            raise ChangeLogOverflowError(f"{n} changes are pending, {most} are allowed; backfill instead")
        deadline = clock.monotonic() + (self.config.max_run_seconds if max_seconds is None else max_seconds)
        total = 0
        while True:
            done = self.drain_step(limit)
            total += done
            if not done or clock.monotonic() >= deadline:
                return total

    def drain_stream(self, checkpoint: str, **trigger: Any):
        """A streaming query that drains as appends are committed; ``trigger`` as in writeStream.trigger."""
        return drain_stream(self, checkpoint, **trigger)

    def vacuum(self) -> dict[str, int]:
        """Delete data that no current version and no pending change needs."""
        out = {d.name: self.store(d).vacuum() for d in self.registry.definitions()}
        return out | {"changes": self.log.vacuum(self._oldest_offset())}

    # Verifying

    def discrepancies(self, rollup: AnyRollup, tenant: Any = None, between: tuple | None = None) -> DataFrame:
        """Cells that differ from the source: keys, stored_*, expected_* and kind, in key order."""
        d = self._definition(rollup)
        stored = verification.scope(d, self.rows(d), tenant, between)
        expected = verification.scope(d, self._recompute(d).source_rows(between), tenant, between)
        return verification.discrepancies(d, stored, expected).orderBy(*[F.col(k).asc_nulls_last() for k in d.keys])

    def verify(self, rollup: AnyRollup, tenant: Any = None, between: tuple | None = None, repair: bool = False) -> verification.Report:
        """What disagrees, in the given scope; ``repair`` recomputes those cells. The report keeps what was found."""
        d = self._definition(rollup)
        found = self.discrepancies(d, tenant, between).persist()
        try:
            out = verification.report(d, found)
            if repair and not out.clean:
                out = out.with_repaired(self.recompute_cells(d, found.select(*d.keys)))
            return out
        finally:
            found.unpersist()
