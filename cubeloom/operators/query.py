"""Guarded, immutable reads of a rollup.

``engine.query(R).where(nation_id=3).between(a, b).by("brand", ordered_on="month")``
gives a DataFrame, SQL text, rows, a dict or single values. Without a tenant it
refuses, unless ``across_tenants()`` was said.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.errors import CubeError, MissingTenantError, UnknownDimensionError
from cubeloom.functions.scalars import COARSER, coarsen, divided, to_type
from cubeloom.model.definition import Definition, Measure


def plain(value: Any) -> Any:
    """Records stand for their ids, also inside lists."""
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    if not isinstance(value, (int, float, str, bytes, datetime.date)) and hasattr(value, "id"):
        return value.id
    return value


@dataclass(frozen=True)
class Query:
    definition: Definition
    table: str
    source: Callable[[], DataFrame]
    filters: tuple[tuple[str, Any], ...] = ()
    span: tuple[Any, Any] | None = None
    groups: tuple[tuple[str, str | None], ...] = ()
    crossing: bool = False

    # Narrowing

    def where(self, **filters: Any) -> Query:
        """Keep cells whose dimension equals a value, is in a list, or is null; a later filter replaces an earlier one."""
        merged = dict(self.filters)
        merged.update({self._name(k): plain(v) for k, v in filters.items()})
        return replace(self, filters=tuple(merged.items()))

    for_ = where

    def between(self, *span: Any) -> Query:
        """Days from the first to the last, both included."""
        if not self.definition.temporal:
            raise CubeError(f"{self.definition.name} has no time dimension")
        if len(span) == 1 and isinstance(span[0], (tuple, list)):
            span = tuple(span[0])
        if len(span) != 2 or any(not isinstance(s, (datetime.date, str)) for s in span):
            raise CubeError("between takes a first and a last day")
        return replace(self, span=(span[0], span[1]))

    def by(self, *names: str, **coarser: str) -> Query:
        """Group by dimensions, added to those before; ``by(ordered_on="month")`` coarsens the day."""
        merged = dict(self.groups)
        for n in names:
            merged[self._name(n)] = None
        for n, unit in coarser.items():
            key = self._name(n)
            if not self.definition.temporal or key != self.definition.time.name:
                raise CubeError(f"{n!r} is not a time dimension")
            if unit not in COARSER:
                raise CubeError(f"{unit!r} is not one of {COARSER}")
            merged[key] = unit
        return replace(self, groups=tuple(merged.items()))

    def across_tenants(self) -> Query:
        return replace(self, crossing=True)

    def _name(self, name: str) -> str:
        keys = self.definition.keys
        for found in (name, f"{name}_id"):
            if found in keys:
                return found
        raise UnknownDimensionError(f"{self.definition.name} has no dimension {name!r}; it has {list(keys)}")

    def _guard(self) -> None:
        if self.crossing:
            return
        value = dict(self.filters).get(self.definition.tenant.name)
        if value is None or (isinstance(value, list) and any(v is None for v in value)):
            raise MissingTenantError(f"name a {self.definition.tenant.name}, or cross tenants on purpose with across_tenants()")

    # Plans

    def df(self) -> DataFrame:
        """Groups, every measure and every ratio, ordered by the groups with nulls last."""
        self._guard()
        frame = self.source()
        for name, value in self.filters:
            frame = frame.where(_matches(F.col(name), value))
        if self.span is not None:
            frame = frame.where(F.col(self.definition.time.name).between(F.lit(self.span[0]).cast("date"), F.lit(self.span[1]).cast("date")))
        aggregates = [self._combined(m) for m in self.definition.measures]
        names = [g for g, _ in self.groups]
        if self.groups:
            keys = [(coarsen(F.col(n), unit) if unit else F.col(n)).alias(n) for n, unit in self.groups]
            frame = frame.groupBy(*keys).agg(*aggregates).orderBy(*[F.col(n).asc_nulls_last() for n in names])
        else:
            frame = frame.agg(*aggregates)
        ratios = [divided(F.col(r.of), F.col(r.over)).alias(r.name) for r in self.definition.ratios]
        return frame.select(*names, *[m.name for m in self.definition.measures], *ratios)

    @staticmethod
    def _combined(m: Measure) -> Column:
        value = getattr(F, m.coarser)(F.col(m.name))
        if m.coarser == "sum":
            value = F.coalesce(value, F.lit(0))
        return to_type(value, m.data_type).alias(m.name)

    def sql(self) -> str:
        """The same read as Spark SQL over the view that ``engine.register_views`` makes."""
        self._guard()
        keys = [(f"CAST(date_trunc('{u}', `{n}`) AS DATE)" if u and u != "day" else f"`{n}`") for n, u in self.groups]
        measures = []
        for m in self.definition.measures:
            value = f"{m.coarser}(`{m.name}`)"
            if m.coarser == "sum":
                value = f"coalesce({value}, 0)"
            if m.data_type.typeName() in ("long", "integer"):
                value = f"round({value})"
            measures.append(f"CAST({value} AS {m.data_type.simpleString()}) AS `{m.name}`")
        inner = ", ".join([*[f"{k} AS `{n}`" for k, (n, _) in zip(keys, self.groups, strict=True)], *measures])
        conditions = [_matches_sql(n, v) for n, v in self.filters]
        if self.span is not None:
            conditions.append(f"`{self.definition.time.name}` BETWEEN {_literal(self.span[0], 'DATE')} AND {_literal(self.span[1], 'DATE')}")
        text = f"SELECT {inner} FROM `{self.table}`" + (f" WHERE {' AND '.join(conditions)}" if conditions else "") + (f" GROUP BY {', '.join(keys)}" if keys else "")
        ratios = [f"CASE WHEN `{r.over}` != 0 THEN CAST(`{r.of}` AS DOUBLE) / CAST(`{r.over}` AS DOUBLE) END AS `{r.name}`" for r in self.definition.ratios]
        names = [f"`{n}`" for n, _ in self.groups]
        outer = ", ".join([*names, *[f"`{m.name}`" for m in self.definition.measures], *ratios])
        order = f" ORDER BY {', '.join(f'{n} ASC NULLS LAST' for n in names)}" if names else ""
        return f"SELECT {outer} FROM ({text}){order}"

    # Results

    def rows(self) -> list[dict[str, Any]]:
        """Rows as dicts, fetched once."""
        cached = self.__dict__.get("_rows")
        if cached is None:
            cached = [r.asDict() for r in self.df().collect()]
            object.__setattr__(self, "_rows", cached)
        return cached

    def to_dict(self) -> Any:
        """``{group: row}``, the group a value or a tuple of values; without groups the one row."""
        if not self.groups:
            return self.rows()[0]
        return {self._group_of(r): r for r in self.rows()}

    def _group_of(self, row: dict[str, Any]) -> Any:
        values = tuple(row[n] for n, _ in self.groups)
        return values[0] if len(values) == 1 else values

    def value(self, name: str) -> Any:
        """A measure or ratio: one value, or ``{group: value}``."""
        if name not in self._values():
            raise AttributeError(f"{self.definition.name} has no measure or ratio {name!r}")
        found = self.to_dict()
        return found[name] if not self.groups else {g: r[name] for g, r in found.items()}

    def _values(self) -> set[str]:
        return {m.name for m in self.definition.measures} | {r.name for r in self.definition.ratios}

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self._values():
            raise AttributeError(name)
        return self.value(name)

    def __dir__(self):
        return sorted({*super().__dir__(), *self._values()})


def _matches(column: Column, value: Any) -> Column:
    if value is None:
        return column.isNull()
    if not isinstance(value, list):
        return column == F.lit(value)
    known = [v for v in value if v is not None]
    found = column.isin(known) if known else F.lit(False)
    return found | column.isNull() if len(known) < len(value) else found


def _literal(value: Any, kind: str | None = None) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, datetime.date) or kind:
        return f"{kind or 'DATE'} '{value}'"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _matches_sql(name: str, value: Any) -> str:
    if value is None:
        return f"`{name}` IS NULL"
    if not isinstance(value, list):
        return f"`{name}` = {_literal(value)}"
    known = [_literal(v) for v in value if v is not None]
    found = f"`{name}` IN ({', '.join(known)})" if known else "FALSE"
    return f"({found} OR `{name}` IS NULL)" if len(known) < len(value) else found
