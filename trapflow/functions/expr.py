"""Small helpers for building Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the wire data has it: all Unicode blanks, not only U+0020.
OUTER_BLANKS = r"(?U)^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once; a plain Python use of a Column twice would evaluate it twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    """``value`` without outer white space of any kind; null stays null."""
    return F.regexp_replace(value, OUTER_BLANKS, "")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
