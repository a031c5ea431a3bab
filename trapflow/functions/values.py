"""Typed reading of attribute values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapflow.functions.expr import let, strip

KINDS = ("long", "double", "boolean", "timestamp", "string")
_LABEL = r"^\p{L}[\p{L}\p{N}_ .-]*\(\s*([+-]?[0-9]+)\s*\)$"
_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?) ?([Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
_OCTETS = r"^0[xX]([0-9a-fA-F]{4})([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})$"


def _without_unit(s: Column, unit: Column) -> Column:
    ends = unit.isNotNull() & F.lower(s).endswith(F.lower(unit))
    return F.when(ends, strip(F.substring(s, F.lit(1), F.length(s) - F.length(unit)))).otherwise(s)


def _long(s: Column) -> Column:
    """64 bits, signed or unsigned: between -2**63 and 2**64 - 1."""
    digits = F.when(s.rlike(_LABEL), F.regexp_extract(s, _LABEL, 1)).otherwise(s)

    def of(d: Column) -> Column:
        number = d.try_cast("decimal(38,0)")
        inside = F.when((number >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (number <= F.lit("18446744073709551615").cast("decimal(38,0)")), number.cast("string"))
        hexed = F.regexp_extract(d, r"^0[xX]0*([0-9a-fA-F]{1,16})$", 1)
        return F.when(d.rlike(r"^[+-]?[0-9]+$"), inside).when(hexed != "", F.conv(hexed, 16, 10))

    return let(digits, of)


def _double(s: Column) -> Column:
    def of(d: Column) -> Column:
        return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), (d + F.lit(0.0)).cast("string"))

    return F.when(s.rlike(r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"), let(F.replace(s, F.lit(","), F.lit(".")).try_cast("double"), of))


def _boolean(s: Column) -> Column:
    word = F.lower(F.regexp_replace(s, _LABEL, "$1"))
    return F.when(word.isin("true", "yes", "on", "1"), "true").when(word.isin("false", "no", "off", "2"), "false")


def _timestamp(s: Column) -> Column:
    """Microseconds since the epoch, as text."""
    iso = F.concat(
        F.regexp_extract(s, _ISO, 1), F.lit(" "), F.regexp_replace(F.replace(F.regexp_extract(s, _ISO, 2), F.lit(","), F.lit(".")), r"^(\d\d:\d\d)$", "$1:00"),
        F.regexp_replace(F.when(F.regexp_extract(s, _ISO, 3) == "", "Z").otherwise(F.upper(F.regexp_extract(s, _ISO, 3))), r"^([+-]\d\d):?(\d\d)?$", "$1:$2"),
    )
    part = [F.conv(F.regexp_extract(s, _OCTETS, i), 16, 10) for i in range(1, 8)]
    octets = F.when(part[6].try_cast("int") <= 9, F.concat(F.lpad(part[0], 4, "0"), F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0"), F.lit(" "), F.lpad(part[3], 2, "0"), F.lit(":"), F.lpad(part[4], 2, "0"), F.lit(":"), F.lpad(part[5], 2, "0"), F.lit("."), part[6], F.lit("Z")))

    def us(text: Column) -> Column:
        return F.unix_micros(text.try_cast("timestamp")).cast("string")

    seconds = s.try_cast("bigint")
    # 253402300799 is the last second of the year 9999.
    return (
        F.when(s.rlike(_ISO), us(F.regexp_replace(iso, r":$", ":00")))
        .when(s.rlike(_OCTETS), us(octets))
        .when(s.rlike(r"^[+-]?[0-9]{1,12}$") & (F.abs(seconds) <= 253402300799), (seconds * 1_000_000).cast("string"))
    )


def read_value(value: Column, kind: Column, unit: Column) -> Column:
    """Canonical text of ``value`` read as ``kind``, null if it can't be read.

    Equal values have equal text: integers in decimal, doubles as Spark prints them, ``true`` and
    ``false``, timestamps as microseconds since the epoch, strings without outer white space.
    """

    def of(s: Column) -> Column:
        bare = _without_unit(s, unit)
        return (
            F.when(s.isNull() | (s == ""), None)
            .when(kind == "long", let(bare, _long)).when(kind == "double", let(bare, _double))
            .when(kind == "boolean", _boolean(s)).when(kind == "timestamp", _timestamp(s)).when(kind == "string", s)
        )

    return let(strip(value), of)


def typed(text: Column, kind: str) -> Column:
    """Column of the kind's type from canonical text. ``long`` is DECIMAL(20,0): unsigned 64-bit counters fit."""
    if kind == "timestamp":
        return F.timestamp_micros(text.try_cast("bigint"))
    return text.try_cast({"long": "decimal(20,0)", "double": "double", "boolean": "boolean", "string": "string"}[kind])
