"""Chains of many-to-one hops from a fact to a column."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from cubeloom.errors import DefinitionError

MAX_HOPS = 3


@dataclass(frozen=True)
class Path:
    """``hops`` are association names from the fact on; ``column`` is None for a bare association."""

    hops: tuple[str, ...]
    column: str | None

    def __post_init__(self) -> None:
        if len(self.hops) > MAX_HOPS:
            raise DefinitionError(f"{self} has {len(self.hops)} hops; at most {MAX_HOPS} are followed")

    @classmethod
    def parse(cls, via: Any) -> Path:
        """``"column"`` or nested one-key dicts ending in a column: ``{"order": {"customer": "c_nationkey"}}``."""
        hops: list[str] = []
        while isinstance(via, dict):
            if len(via) != 1:
                raise DefinitionError(f"a path follows one association at a time, not {sorted(map(str, via))}")
            hop, via = next(iter(via.items()))
            hops.append(cls._name(hop))
        return cls(tuple(hops), cls._name(via))

    @classmethod
    def parse_association(cls, through: Any) -> Path:
        """``"order"`` or ``{"order": "customer"}``: hops without a column."""
        full = cls.parse(through)
        return cls((*full.hops, full.column), None)

    @staticmethod
    def _name(part: Any) -> str:
        if not isinstance(part, str) or not part:
            raise DefinitionError(f"a path is made of names, not {part!r}")
        return part

    @property
    def local(self) -> bool:
        return not self.hops

    def __str__(self) -> str:
        return ".".join((*self.hops, *([self.column] if self.column else [])))


def alias_of(hops: tuple[str, ...]) -> str:
    """Relation alias of a chain of hops; ``f`` is the fact. Two routes to one table stay apart."""
    return "_".join(("g", *hops)) if hops else "f"
