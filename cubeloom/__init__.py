"""Incrementally maintained rollups on Spark."""

from cubeloom.config import Config
from cubeloom.engine import Engine
from cubeloom.model.definition import Definition, Rollup, dimension, fact, measure, ratio, tenant, time
from cubeloom.operators.query import Query
from cubeloom.operators.verify import Discrepancy, Report
from cubeloom.sources.catalog import BelongsTo, Catalog, HasMany, Source

__all__ = ["BelongsTo", "Catalog", "Config", "Definition", "Discrepancy", "Engine", "HasMany", "Query", "Report", "Rollup", "Source", "dimension", "fact", "measure", "ratio", "tenant", "time"]
