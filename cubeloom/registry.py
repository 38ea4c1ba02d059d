"""Which rollups there are, and which of them a table's changes concern."""

from __future__ import annotations

import logging
import re

from cubeloom.errors import CubeError, UnknownRollupError
from cubeloom.model.definition import Definition, Rollup
from cubeloom.sources.catalog import Catalog
from cubeloom.streaming.capture import watched_columns

log = logging.getLogger("cubeloom")


class Registry:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self._definitions: dict[str, Definition] = {}
        self._watched: dict[str, dict] = {}

    def register(self, rollup: type[Rollup] | Definition) -> Definition:
        d = rollup if isinstance(rollup, Definition) else rollup.definition()
        self.catalog.check(d)
        self._definitions[d.name] = d
        self._watched[d.name] = watched_columns(d, self.catalog)
        return d

    def discover(self, base: type[Rollup] = Rollup) -> list[Definition]:
        """Register all subclasses, at any depth, that are valid here; the others are warned about."""
        found = []
        for cls in base.__subclasses__():
            if cls._declared:
                try:
                    found.append(self.register(cls))
                except CubeError as e:
                    log.warning("left out %s: %s", cls.__name__, e)
            found.extend(self.discover(cls))
        return found

    def reset(self) -> None:
        self._definitions.clear()
        self._watched.clear()

    def definitions(self) -> list[Definition]:
        return list(self._definitions.values())

    def for_table(self, table: str) -> list[Definition]:
        """Rollups whose cells or numbers a change of ``table`` may alter."""
        return [d for d in self._definitions.values() if table in self._watched[d.name]]

    def tables(self) -> list[str]:
        return sorted({t for w in self._watched.values() for t in w})

    def lookup(self, name: str) -> Definition:
        """By class name in any spelling; a trailing "rollup" may be left out."""
        bare = lambda s: re.sub(r"rollup$", "", re.sub(r"[^a-z0-9]", "", s.lower()))
        for d in self._definitions.values():
            if bare(d.name) == bare(name):
                return d
        raise UnknownRollupError(f"no rollup {name!r}; registered: {sorted(self._definitions) or 'none, call engine.register first'}")
