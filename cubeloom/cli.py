"""``python -m cubeloom verify|repair|backfill|drain|capture|describe APP [ROLLUP]``

APP is ``module:function``; the function takes no arguments and returns an
Engine with its rollups registered. ``verify`` exits with 1 when a rollup
disagrees with its source.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from typing import Any


def _engine(app: str) -> Any:
    module, _, name = app.partition(":")
    return getattr(importlib.import_module(module), name or "engine")()


def _chosen(engine: Any, rollup: str | None) -> list:
    return [engine.registry.lookup(rollup)] if rollup else engine.registry.definitions()


def main(argv: list[str] | None = None, out: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(prog="cubeloom", description=__doc__)
    parser.add_argument("command", choices=["verify", "repair", "backfill", "drain", "capture", "describe"])
    parser.add_argument("app")
    parser.add_argument("rollup", nargs="?")
    parser.add_argument("--from", dest="from_", default=None, help="first slice to backfill")
    parser.add_argument("--tenant", default=None)
    parser.add_argument("--between", nargs=2, metavar=("FIRST", "LAST"), default=None, help="days to verify or repair")
    parser.add_argument("--limit", type=int, default=None, help="entries that a drain claims at a time")
    parser.add_argument("--seconds", type=float, default=None, help="time after which a drain claims no more")
    parser.add_argument("--pause", type=float, default=0.0, help="seconds between slices, or groups of them, of a backfill")
    parser.add_argument("--group", type=int, default=None, help="slices that a backfill commits at a time; all in one if left out")
    args = parser.parse_args(argv)
    engine = _engine(args.app)
    if args.command == "drain":
        out(f"{engine.drain(limit=args.limit, max_seconds=args.seconds)} changes applied")
        return 0
    if args.command == "capture":
        for p in engine.capture_policy().values():
            out(f"{p.table}: {'every update' if p.columns is None else ', '.join(p.columns)}")
        return 0
    dirty = False
    for d in _chosen(engine, args.rollup):
        if args.command == "describe":
            out(engine.describe(d))
        elif args.command == "backfill":
            out(f"{d.name}: {engine.backfill(d, from_=args.from_, pause=args.pause, group=args.group)} slices")
        else:
            tenant = args.tenant
            if tenant is not None and engine.projection(d).schema()[d.tenant.name].dataType.typeName() in ("long", "integer"):
                tenant = int(tenant)
            report = engine.verify(d, tenant=tenant, between=args.between and tuple(args.between), repair=args.command == "repair")
            out(str(report))
            dirty |= not report.clean and args.command == "verify"
    return int(dirty)


if __name__ == "__main__":
    sys.exit(main())
