"""Column expressions that reads and writes share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.errors import CubeError

#: Units that a day bucket can be coarsened to; weeks start on Monday.
COARSER = ("day", "week", "month", "quarter", "year")


def day_of(column: Column, data_type: T.DataType, time_zone: str) -> Column:
    """The calendar day: dates as they are, timestamps in ``time_zone``; those without a zone are UTC wall-clock."""
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.TimestampNTZType):
        if time_zone == "UTC":
            return column.cast("date")
        return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), column).cast("date")
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit(time_zone), column.cast("timestamp_ntz")).cast("date")
    raise CubeError(f"a day is cut from a date or timestamp, not from {data_type.simpleString()}")


def around_days(column: Column, data_type: T.DataType, first: object = None, last: object = None) -> Column:
    """A range on the raw column that holds all rows of the days from ``first`` to ``last``, in any time zone.

    It may hold rows of the days next to them, but a scan can skip row groups by it.
    """
    slack = 0 if isinstance(data_type, T.DateType) else 1
    kind = "date" if slack == 0 else data_type.simpleString()
    out = F.lit(True)
    if first is not None:
        out = out & (column >= F.date_sub(F.lit(first).cast("date"), slack).cast(kind))
    if last is not None:
        out = out & (column <= F.date_add(F.lit(last).cast("date"), 2 * slack).cast(kind))
    return out


def coarsen(column: Column, unit: str) -> Column:
    """First day of the unit that holds a day."""
    if unit not in COARSER:
        raise CubeError(f"{unit!r} is not one of {COARSER}")
    return column if unit == "day" else F.date_trunc(unit, column).cast("date")


def to_type(column: Column, data_type: T.DataType) -> Column:
    """Cast that rounds to whole numbers instead of cutting them."""
    if isinstance(data_type, (T.LongType, T.IntegerType)):
        return F.round(column).cast(data_type)
    return column.cast(data_type)


def divided(numerator: Column, denominator: Column) -> Column:
    """Ratio as a double; null over null or zero parts."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
