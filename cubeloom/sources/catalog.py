"""Source tables and the many-to-one associations between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.errors import AssociationError, CubeError
from cubeloom.model.definition import Definition
from cubeloom.model.path import Path

Loader = Callable[[SparkSession], DataFrame]
#: Name of the row-identity column that the engine adds while looking for cells.
ROW_ID = "_row_id"


@dataclass(frozen=True)
class BelongsTo:
    """Rows hold ``fk``, the primary key of one row of ``target``."""

    target: str
    fk: str


@dataclass(frozen=True)
class HasMany:
    """The other direction; known so that a path through it is refused by name."""

    target: str
    fk: str


@dataclass(frozen=True)
class Source:
    """``loader`` gives the current rows. ``pk`` is a column, several, or empty for a table without a key."""

    name: str
    loader: Loader
    pk: str | tuple[str, ...] = "id"
    belongs_to: dict[str, BelongsTo] = field(default_factory=dict)
    has_many: dict[str, HasMany] = field(default_factory=dict)

    @property
    def key(self) -> tuple[str, ...]:
        return (self.pk,) if isinstance(self.pk, str) and self.pk else tuple(self.pk)

    @classmethod
    def parquet(cls, name: str, path: str, pk: str | tuple[str, ...] = "id", **associations) -> Source:
        """A table whose schema is read once: every further read would open a file for it."""
        known: list[T.StructType] = []

        def load(spark: SparkSession) -> DataFrame:
            if not known:
                known.append(spark.read.parquet(path).schema)
            return spark.read.schema(known[0]).parquet(path)

        return cls(name, load, pk, **associations)

    def row_id(self, columns: list[str]) -> Column:
        """Text that names a row: its key, or a digest of the whole row where there is none."""
        if len(self.key) == 1:
            return F.col(f"`{self.key[0]}`").cast("string")
        parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in (self.key or sorted(columns))]
        joined = F.concat_ws("\x1f", *parts)
        return joined if self.key else F.sha2(joined, 256)


class Catalog:
    """The sources of an engine. Frames are loaded once per ``snapshot``."""

    def __init__(self, spark: SparkSession, sources: list[Source]) -> None:
        self.spark = spark
        self._sources = {s.name: s for s in sources}
        self._schemas: dict[str, T.StructType] = {}

    def source(self, name: str) -> Source:
        try:
            return self._sources[name]
        except KeyError:
            raise CubeError(f"no source {name!r}; known: {sorted(self._sources)}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def names(self) -> list[str]:
        return sorted(self._sources)

    def frame(self, name: str) -> DataFrame:
        return self.source(name).loader(self.spark)

    def schema(self, name: str) -> T.StructType:
        if name not in self._schemas:
            self._schemas[name] = self.frame(name).schema
        return self._schemas[name]

    def with_frame(self, name: str, frame: DataFrame) -> Catalog:
        """A catalog in which ``name`` holds ``frame``; associations stay."""
        changed = Catalog(self.spark, list(self._sources.values()))
        changed._sources[name] = replace(self.source(name), loader=lambda _: frame)
        return changed

    def replace(self, name: str, frame: DataFrame) -> None:
        self._sources[name] = replace(self.source(name), loader=lambda _: frame)

    def hop(self, source: str, name: str) -> BelongsTo:
        own = self.source(source)
        if name in own.belongs_to:
            return own.belongs_to[name]
        if name in own.has_many:
            raise AssociationError(f"{source}.{name} leads to many rows; a rollup follows many-to-one associations only")
        raise AssociationError(f"{source} has no association {name!r}; it has {sorted(own.belongs_to)}")

    def table_at(self, fact: str, hops: tuple[str, ...]) -> str:
        """The table that a chain of hops from ``fact`` ends at."""
        at = fact
        for hop in hops:
            at = self.hop(at, hop).target
        return at

    def field_at(self, fact: str, path: Path) -> T.StructField:
        table = self.table_at(fact, path.hops)
        for f in self.schema(table):
            if f.name == path.column:
                return f
        raise AssociationError(f"{table} has no column {path.column!r}")

    def check(self, definition: Definition) -> None:
        """Raise unless every table, association and column that the definition names exists."""
        source = definition.fact.source
        self.source(source)
        for hops in definition.hop_chains:
            self.table_at(source, hops)
        for path in [d.path for d in definition.dimensions] + list(definition.filter_paths):
            self.field_at(source, path)
