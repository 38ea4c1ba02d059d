"""Key columns, aggregates and filters of a rollup over its joined rows, and its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions.scalars import around_days, day_of, to_type
from cubeloom.model.definition import Definition, Dimension, Measure
from cubeloom.model.path import Path, alias_of
from cubeloom.sources.catalog import Catalog


class Projection:
    def __init__(self, definition: Definition, catalog: Catalog, time_zone: str) -> None:
        self.definition, self.catalog, self.time_zone = definition, catalog, time_zone

    def column(self, path: Path) -> Column:
        return F.col(f"{alias_of(path.hops)}.`{path.column}`")

    def key(self, d: Dimension) -> Column:
        if d.role != "time":
            return self.column(d.path)
        return day_of(self.column(d.path), self.catalog.field_at(self.definition.fact.source, d.path).dataType, self.time_zone)

    def around(self, first: object = None, last: object = None) -> Column:
        """A range on the time column as it is stored, wide enough for the days from ``first`` to ``last``."""
        path = self.definition.time.path
        return around_days(self.column(path), self.catalog.field_at(self.definition.fact.source, path).dataType, first, last)

    def keys(self) -> list[Column]:
        return [self.key(d).alias(d.name) for d in self.definition.dimensions]

    def aggregate(self, m: Measure) -> Column:
        """Counts and sums of nothing are 0, extremes of nothing are null."""
        if m.aggregate == "count":
            return to_type(F.count("*") if m.expression is None else F.count(F.expr(m.expression)), m.data_type).alias(m.name)
        value = getattr(F, m.aggregate)(F.expr(m.expression))
        if m.aggregate == "sum":
            value = F.coalesce(value, F.lit(0))
        return to_type(value, m.data_type).alias(m.name)

    def filter(self) -> Column | None:
        out = None
        for path, value in self.definition.fact.where:
            one = self.column(path).isNull() if value is None else self.column(path) == F.lit(value)
            out = one if out is None else out & one
        return out

    def filtered(self, joined: DataFrame) -> DataFrame:
        condition = self.filter()
        return joined if condition is None else joined.where(condition)

    def aggregated(self, joined: DataFrame) -> DataFrame:
        """One row per cell; nulls are coordinates like any other value."""
        names = self.definition.columns
        return self.filtered(joined).groupBy(*self.keys()).agg(*[self.aggregate(m) for m in self.definition.measures]).select(*names)

    def schema(self) -> T.StructType:
        """Key columns with the source's type and nullability, then measures; extremes can be null."""
        source, fields = self.definition.fact.source, []
        for d in self.definition.dimensions:
            f = self.catalog.field_at(source, d.path)
            fields.append(T.StructField(d.name, T.DateType() if d.role == "time" else f.dataType, f.nullable))
        for m in self.definition.measures:
            fields.append(T.StructField(m.name, m.data_type, m.aggregate in ("min", "max")))
        return T.StructType(fields)


def same_cell(left: str, right: str, keys: tuple[str, ...]) -> Column:
    """Null-safe equality of two aliases' key columns; Spark hashes and sorts by it like plain equality."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out
