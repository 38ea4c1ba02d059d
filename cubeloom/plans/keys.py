"""Bounded sets of key values that a scan can skip by.

A handful of changed rows must not cost a pass over every table they join. Their
keys are brought to the driver, as a list while they are few and as a range
beyond, and put as a filter on the scan of whatever refers to them. The filter
only narrows: the joins above it stay as they are.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose text gives the value back and whose order parquet keeps statistics of.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)
#: Keys that are listed; more become a range.
LISTED = 1024


@dataclass(frozen=True)
class Keys:
    """Values of one column: ``values`` if they are listed, else all from ``low`` to ``high``; ``nulls`` if null is one."""

    low: Any = None
    high: Any = None
    values: tuple | None = None
    nulls: bool = False

    @property
    def empty(self) -> bool:
        return self.values == () and not self.nulls

    @classmethod
    def listed(cls, values) -> Keys:
        known = tuple(sorted(v for v in values if v is not None))
        return cls(known[0] if known else None, known[-1] if known else None, known, any(v is None for v in values))

    @classmethod
    def of(cls, column: DataFrame, most: int = LISTED) -> Keys | None:
        """The values of a one-column frame; None if its type is not fit for skipping."""
        if not isinstance(column.schema[0].dataType, EXACT):
            return None
        rows = column.distinct().limit(most + 1).collect()
        if len(rows) <= most:
            return cls.listed([r[0] for r in rows])
        name = F.col(f"`{column.columns[0]}`")
        low, high, nulls = column.agg(F.min(name), F.max(name), F.max(name.isNull())).first()
        return cls(low, high, None, bool(nulls))

    def holds(self, column: Column | str) -> Column:
        """A condition on a column or, for a long list quicker to plan, on a column's name."""
        named = F.col(f"`{column}`") if isinstance(column, str) else column
        if self.values is None:
            out = named.between(F.lit(self.low), F.lit(self.high))
        elif not self.values:
            out = F.lit(False)
        elif len(self.values) == 1:
            out = named == F.lit(self.values[0])
        else:
            # The range is for scans, which skip by a long list no better.
            out = named.between(F.lit(self.low), F.lit(self.high))
            out = out & (F.expr(f"`{column}` IN ({', '.join(map(_literal, self.values))})") if isinstance(column, str) else named.isin(*self.values))
        return out | named.isNull() if self.nulls else out


def _literal(value: Any) -> str:
    """SQL text of a value of one of the EXACT types."""
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"
    return f"DATE'{value.isoformat()}'" if isinstance(value, datetime.date) else str(value)
