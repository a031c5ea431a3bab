"""Network addresses in canonical text, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapflow.functions.expr import let, strip

_V4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
_V6 = r"^[0-9a-f:]*:[0-9a-f:]*$"
_V4_TAIL = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))


def _dotted(text: Column) -> Column:
    """Dotted IPv4 without leading zeros, null if an octet is above 255."""
    return let(_octets(text), lambda o: F.when(F.forall(o, lambda x: x <= 255), F.array_join(o.cast("array<string>"), ".")))


def _hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def _unmix(text: Column) -> Column:
    """Write a dotted tail (``::ffff:10.0.0.1``) as two hexadecimal groups."""

    def tail(t: Column) -> Column:
        groups = let(_octets(t), lambda o: F.concat(_hex(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))), F.lit(":"), _hex(F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)))))
        return F.when(t == "", text).when(_dotted(t).isNotNull(), F.concat(F.regexp_replace(text, _V4_TAIL, ""), groups))

    return let(F.regexp_extract(text, f"({_V4_TAIL})", 1), tail)


def _groups(text: Column) -> Column:
    """The eight groups as ints, null where ``text`` is no IPv6 address."""

    def side(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def fill(parts: Column) -> Column:
        left, right = side(F.get(parts, F.lit(0))), side(F.get(parts, F.lit(1)))
        zeros = F.lit(8) - F.size(left) - F.size(right)
        return (
            F.when(F.size(parts) == 1, F.split(F.get(parts, F.lit(0)), ":"))
            .when((F.size(parts) == 2) & (zeros >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right))
        )

    def numbers(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(groups, lambda g: F.conv(g, 16, 10).try_cast("int")))

    return let(let(F.split(text, "::"), fill), numbers)


def _v6_text(groups: Column) -> Column:
    """Shortest lower-case text: the first longest run of two or more zero groups becomes ``::``."""

    def shorten(flags: Column) -> Column:
        hexes = F.transform(groups, _hex)
        out = F.array_join(hexes, ":")
        for n in range(2, 9):
            run = "z" * n
            at = F.instr(flags, run)
            short = F.concat(F.array_join(F.slice(hexes, F.lit(1), at - 1), ":"), F.lit("::"), F.array_join(F.slice(hexes, at + n, F.lit(8)), ":"))
            out = F.when(at > 0, short).otherwise(out)
        return out

    return let(F.array_join(F.transform(groups, lambda g: F.when(g == 0, "z").otherwise("n")), ""), shorten)


def _v6(text: Column) -> Column:
    def canonical(g: Column) -> Column:
        inner = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (F.get(g, F.lit(5)) == 65535)
        hi, lo = F.get(g, F.lit(6)), F.get(g, F.lit(7))
        v4 = F.concat_ws(".", F.shiftright(hi, 8).cast("string"), hi.bitwiseAND(255).cast("string"), F.shiftright(lo, 8).cast("string"), lo.bitwiseAND(255).cast("string"))
        return F.when(g.isNull(), None).when(inner, v4).otherwise(_v6_text(g))

    return let(_groups(_unmix(text)), canonical)


def source_address(value: Column) -> Column:
    """The address that ``value`` denotes: dotted IPv4, or the shortest lower-case IPv6 text.

    IPv4 mapped into IPv6 gives the IPv4 address. Outer blanks, brackets and a zone (``%eth0``)
    are dropped. Null, blank and unreadable text give null.
    """

    def of(s: Column) -> Column:
        return F.when(s.rlike(_V4), _dotted(s)).when(s.contains(":"), F.when(F.regexp_replace(s, _V4_TAIL, "").rlike(_V6), _v6(s)))

    return let(F.regexp_replace(F.lower(strip(value)), r"^\[|\]$|%.*$", ""), of)
