"""Object identifiers: notation, trap types, longest-prefix lookup."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapflow.functions.expr import let, strip

#: Fixed value: the branch of the generic notifications (SNMPv2-MIB snmpTraps).
GENERIC_TRAPS = "1.3.6.1.6.3.1.1.5"
_OID = r"^[0-9]+(\.[0-9]+)*$"
_V1 = r"^v1:\.*([0-9]+(?:\.[0-9]+)*):([0-9]{1,9}):([0-9]+)$"


def normalize(value: Column) -> Column:
    """Trim white space, then one leading dot: the notation that rules compare."""
    return F.regexp_replace(strip(value), r"^\.", "")


def plain(value: Column) -> Column:
    """Trim white space and all leading dots."""
    return F.regexp_replace(strip(value), r"^\.+", "")


def trap_type(value: Column) -> Column:
    """Dotted notification OID that ``value`` denotes, else null.

    ``v1:E:G:S`` denotes ``E.0.S`` if G is 6, else the generic trap G + 1.
    """

    def of(s: Column) -> Column:
        generic = F.regexp_extract(s, _V1, 2)
        number = (generic.try_cast("int") + 1).cast("string")
        v1 = F.when(generic == "6", F.concat_ws(".", F.regexp_extract(s, _V1, 1), F.lit("0"), F.regexp_extract(s, _V1, 3))).otherwise(F.concat_ws(".", F.lit(GENERIC_TRAPS), number))
        return F.when(s.rlike(_V1), v1).when(s.rlike(_OID), s)

    return let(plain(value), of)


def longest_prefix(oid: Column, listed: Mapping[str, int]) -> Column:
    """Number of the longest listed OID that equals ``oid`` or ends before one of its dots.

    One map lookup for each depth that occurs in ``listed``, deepest first; null if none fits.
    """
    if not listed:
        return F.lit(None).cast("int")
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in listed.items()))
    depths = sorted({k.count(".") + 1 for k in listed}, reverse=True)
    return F.coalesce(*(F.try_element_at(table, F.substring_index(oid, ".", d)) for d in depths))
