"""Declaring rollups.

A rollup is a class whose attributes are declarations::

    class Revenue(Rollup):
        lines = fact("lineitem", where={"order": {"o_orderstatus": "F"}})
        nation_id = tenant({"order": {"customer": "c_nationkey"}})
        ordered_on = time({"order": "o_orderdate"}, bucket="day")
        brand = dimension({"part": "p_brand"})
        line_count = measure(count=True)
        revenue = measure(sum="f.cents", type="bigint")
        average = ratio(of="revenue", over="line_count")

Measure expressions are Spark SQL; the fact is ``f``, a joined table ``g_`` and
its hops. A declaration made twice under one name is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import types as T

from cubeloom.errors import CubeError, DefinitionError
from cubeloom.model.path import Path

BUCKETS = ("day",)
AGGREGATES = ("count", "sum", "min", "max")
#: Aggregates whose effect a delta could undo; metadata only, cells are always recomputed whole.
REVERSIBLE = ("count", "sum")
_SIMPLE_TYPES = {"bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "integer": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "decimal": T.DecimalType(38, 6)}


def measure_type(name: str) -> T.DataType:
    """The Spark type of a measure's ``type``; decimals without digits are decimal(38,6)."""
    if name in _SIMPLE_TYPES:
        return _SIMPLE_TYPES[name]
    if m := re.fullmatch(r"decimal\((\d+), *(\d+)\)", str(name)):
        return T.DecimalType(int(m[1]), int(m[2]))
    raise DefinitionError(f"{name!r} is not a measure type; choose from {sorted(_SIMPLE_TYPES)} or decimal(p,s)")


@dataclass(frozen=True)
class Fact:
    source: str
    where: tuple[tuple[Path, Any], ...] = ()


@dataclass(frozen=True)
class Dimension:
    role: str  # tenant, time or dimension
    path: Path
    name: str = ""
    bucket: str | None = None
    immutable: bool = False


@dataclass(frozen=True)
class Measure:
    aggregate: str
    expression: str | None
    type_name: str
    through: tuple[Path, ...] = ()
    name: str = ""

    @property
    def data_type(self) -> T.DataType:
        return measure_type(self.type_name)

    @property
    def reversible(self) -> bool:
        return self.aggregate in REVERSIBLE

    @property
    def coarser(self) -> str:
        """The aggregate that combines stored values of this measure."""
        return "sum" if self.aggregate == "count" else self.aggregate


@dataclass(frozen=True)
class Ratio:
    of: str
    over: str
    name: str = ""


def fact(source: str, where: dict | None = None) -> Fact:
    """The fact table and equalities on its columns or, one hop away, ``{"order": {"state": "paid"}}``."""
    if not isinstance(source, str) or not source:
        raise DefinitionError("a fact names its source")
    if where is not None and not isinstance(where, dict):
        raise DefinitionError("where is a dict of equalities")
    conditions = []
    for key, value in (where or {}).items():
        nested = value.items() if isinstance(value, dict) else [(None, value)]
        for column, literal in nested:
            if isinstance(literal, (dict, list, tuple, set)):
                raise DefinitionError(f"where compares {key!r} with one value; {literal!r} is not one")
            conditions.append((Path((key,), column) if column is not None else Path((), key), literal))
    return Fact(source, tuple(conditions))


def tenant(via: Any, immutable: bool = False) -> Dimension:
    return Dimension("tenant", Path.parse(via), immutable=immutable)


def time(via: Any, bucket: str | None = None, immutable: bool = False) -> Dimension:
    if bucket not in BUCKETS:
        raise DefinitionError(f"a time dimension is bucketed by one of {BUCKETS}, not {bucket!r}")
    return Dimension("time", Path.parse(via), bucket=bucket, immutable=immutable)


def dimension(via: Any, immutable: bool = False, bucket: str | None = None) -> Dimension:
    """``immutable`` promises that the path's columns never change: they are joined but not watched."""
    if bucket is not None:
        raise DefinitionError("only a time dimension has a bucket")
    return Dimension("dimension", Path.parse(via), immutable=immutable)


def measure(*, count: bool | str | None = None, sum: str | None = None, min: str | None = None, max: str | None = None, type: str | None = None, through: Any = None) -> Measure:  # noqa: A002
    given = {k: v for k, v in (("count", count), ("sum", sum), ("min", min), ("max", max)) if v is not None and v is not False}
    if len(given) != 1:
        raise DefinitionError(f"a measure has exactly one of {AGGREGATES}")
    (aggregate, expression), = given.items()
    if expression is True:
        if aggregate != "count":
            raise DefinitionError(f"{aggregate} needs an expression")
        expression = None
    if expression is not None and (not isinstance(expression, str) or not expression.strip()):
        raise DefinitionError(f"{aggregate} takes SQL text, not {expression!r}")
    if type is None and aggregate != "count":
        raise DefinitionError(f"{aggregate} needs a type")
    measure_type(type or "bigint")
    paths = through if isinstance(through, (list, tuple)) else [] if through is None else [through]
    return Measure(aggregate, expression, type or "bigint", tuple(Path.parse_association(p) for p in paths))


def ratio(of: str, over: str) -> Ratio:
    if of == over:
        raise DefinitionError(f"{of!r} divided by itself says nothing")
    return Ratio(of, over)


_DECLARATIONS = (Fact, Dimension, Measure, Ratio)


class _Body(dict):
    """A class body in which a declaration can't be replaced by another of its name."""

    def __setitem__(self, name: str, value: Any) -> None:
        if isinstance(self.get(name), _DECLARATIONS):
            raise DefinitionError(f"{name!r} is declared twice")
        super().__setitem__(name, value)


class RollupType(type):
    @classmethod
    def __prepare__(mcs, name, bases, **_):
        return _Body()

    def __new__(mcs, name, bases, body, **options):
        declared = {k: v for k, v in body.items() if isinstance(v, _DECLARATIONS)}
        cls = super().__new__(mcs, name, bases, {k: v for k, v in body.items() if k not in declared}, **options)
        cls._declared = declared
        return cls


def _snake_plural(name: str) -> str:
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    if snake.endswith("y") and snake[-2:-1] not in "aeiou":
        return snake[:-1] + "ies"
    return snake + ("es" if snake.endswith(("s", "x", "ch", "sh")) else "s")


class Rollup(metaclass=RollupType):
    """Base of declared rollups; ``definition()`` gives the checked declaration.

    Once ``engine.bind(R)`` was called, ``R.where(...)``, ``R.by(...)`` and the
    others go through that engine.
    """

    _declared: dict[str, Any] = {}
    bound_engine: Any = None

    @classmethod
    def definition(cls) -> Definition:
        cached = cls.__dict__.get("_definition")
        if cached is None:
            cached = Definition.of(cls.__name__, cls._declared)
            cls._definition = cached
        return cached

    @classmethod
    def engine(cls) -> Any:
        if cls.bound_engine is None:
            raise CubeError(f"{cls.__name__} belongs to no engine yet; call engine.bind({cls.__name__})")
        return cls.bound_engine

    @classmethod
    def query(cls) -> Any:
        return cls.engine().query(cls)

    @classmethod
    def where(cls, **filters: Any) -> Any:
        return cls.query().where(**filters)

    for_ = where

    @classmethod
    def between(cls, *span: Any) -> Any:
        return cls.query().between(*span)

    @classmethod
    def by(cls, *names: str, **coarse: str) -> Any:
        return cls.query().by(*names, **coarse)

    @classmethod
    def across_tenants(cls) -> Any:
        return cls.query().across_tenants()

    @classmethod
    def backfill(cls, **options: Any) -> int:
        return cls.engine().backfill(cls, **options)

    @classmethod
    def verify(cls, **options: Any) -> Any:
        return cls.engine().verify(cls, **options)


@dataclass(frozen=True)
class Definition:
    name: str
    fact: Fact
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    ratios: tuple[Ratio, ...]

    @classmethod
    def of(cls, name: str, declared: dict[str, Any]) -> Definition:
        """Check declarations, in the order made, and assemble them."""
        if not name or not name.isidentifier():
            raise DefinitionError("a rollup needs a class name")
        of = lambda kind: [replace(v, name=k) if kind is not Fact else v for k, v in declared.items() if isinstance(v, kind)]
        facts, dims, measures, ratios = of(Fact), of(Dimension), of(Measure), of(Ratio)
        if len(facts) != 1:
            raise DefinitionError(f"{name} needs exactly one fact, not {len(facts)}")
        roles = [d.role for d in dims]
        if roles.count("tenant") != 1:
            raise DefinitionError(f"{name} needs exactly one tenant")
        if roles.count("time") > 1:
            raise DefinitionError(f"{name} has more than one time dimension")
        if not measures:
            raise DefinitionError(f"{name} needs a measure")
        known = {m.name for m in measures}
        for r in ratios:
            for part in (r.of, r.over):
                if part not in known:
                    raise DefinitionError(f"ratio {r.name!r} of {name} divides measures; {part!r} is none")
        # Key order is a contract: tenant, time, then the others as declared.
        ordered = sorted(dims, key=lambda d: ("tenant", "time", "dimension").index(d.role))
        return cls(name, facts[0], tuple(ordered), tuple(measures), tuple(ratios))

    @cached_property
    def keys(self) -> tuple[str, ...]:
        return tuple(d.name for d in self.dimensions)

    @property
    def tenant(self) -> Dimension:
        return self.dimensions[0]

    @property
    def time(self) -> Dimension | None:
        return next((d for d in self.dimensions if d.role == "time"), None)

    @property
    def temporal(self) -> bool:
        return self.time is not None

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *(m.name for m in self.measures))

    def table_name(self, prefix: str) -> str:
        return prefix + _snake_plural(self.name)

    @property
    def watched_paths(self) -> tuple[Path, ...]:
        """Paths whose columns can move a row to another cell."""
        return tuple(d.path for d in self.dimensions if not d.immutable)

    @property
    def filter_paths(self) -> tuple[Path, ...]:
        return tuple(p for p, _ in self.fact.where)

    @property
    def measure_paths(self) -> tuple[Path, ...]:
        return tuple(dict.fromkeys(p for m in self.measures for p in m.through))

    @property
    def hop_chains(self) -> tuple[tuple[str, ...], ...]:
        """Every chain of hops to join, parents before children, each once."""
        wanted = [d.path.hops for d in self.dimensions] + [p.hops for p in self.measure_paths] + [p.hops for p in self.filter_paths]
        prefixes = [h[:n] for h in wanted for n in range(1, len(h) + 1)]
        return tuple(dict.fromkeys(prefixes))
