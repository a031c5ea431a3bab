"""Addresses, object identifiers and typed values."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from trapflow.functions.address import source_address
from trapflow.functions.oid import longest_prefix, normalize, plain, trap_type
from trapflow.functions.values import read_value, typed


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", fn(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def expected_address(text):
    if text is None:
        return None
    try:
        a = ipaddress.ip_address(text.strip().strip("[]").split("%")[0])
    except ValueError:
        return None
    return str(getattr(a, "ipv4_mapped", None) or a)


def test_addresses_agree_with_the_standard_library(spark):
    r = random.Random(1)
    values = [None, "", "  ", "10.0.0.1", " 10.0.0.1\t", "::FFFF:10.0.0.1", "0:0:0:0:0:ffff:0a00:0001", "::", "::1", "1::", "2001:DB8::1", "[2001:db8::1]", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
              "1::2::3", ":::", "12345::", "g::1", "1:2:3", "256.1.1.1", "1.2.3", "text", "1:0:0:2:0:0:0:3", "1:0:2:0:0:3:0:0", "64:ff9b::1.2.3.4", "::ffff:300.1.1.1"]
    for _ in range(300):
        groups = [r.choice([0, 0, 0, r.randrange(65536)]) for _ in range(8)]
        a = ipaddress.IPv6Address(int.from_bytes(b"".join(g.to_bytes(2) for g in groups)))
        values.append(r.choice([str(a), a.exploded, a.exploded.upper(), ":".join(f"{g:x}" for g in groups)]))
    assert column(spark, values, source_address) == [expected_address(v) for v in values]


def test_octets_above_255_and_leading_zeros(spark):
    assert column(spark, ["010.1.1.1", "999.1.1.1"], source_address) == ["10.1.1.1", None]


def test_trap_types(spark):
    got = column(spark, [None, "", " ", ".1.3.6", " 1.3.6\n", "v1:1.3.6.1:6:12", " v1:.1.3:0:0 ", "v1:1.3:4:9", "linkDown", "v1:1.3:x:1", "..1.3"], trap_type)
    assert got == [None, None, None, "1.3.6", "1.3.6", "1.3.6.1.0.12", "1.3.6.1.6.3.1.1.5.1", "1.3.6.1.6.3.1.1.5.5", None, None, "1.3"]


def test_notations(spark):
    assert column(spark, [" .1.3 ", "..1", None], normalize) == ["1.3", ".1", None]
    assert column(spark, ["..1.3\t"], plain) == ["1.3"]


def test_longest_prefix(spark):
    listed = {"1.3.6": 0, "1.3.6.1.2": 1, "1.3.6.1.2.5.7": 2}
    values = ["1.3.6", "1.3.6.9", "1.3.61", "1.3.6.1.2", "1.3.6.1.2.5", "1.3.6.1.2.5.7.1.1.1", "1.3", "", None]
    assert column(spark, values, lambda c: longest_prefix(c, listed)) == [0, 0, None, 1, 1, 2, None, None, None]
    assert column(spark, ["1.3"], lambda c: longest_prefix(c, {})) == [None]


@pytest.mark.parametrize(
    ("kind", "unit", "values", "want"),
    [
        ("long", None, ["7", " +7\n", "-0", "007", "0x1F", "0x", "0xzz", "up(2)", "DOWN (3)", "9223372036854775807", "18446744073709551615", "18446744073709551616", "-9223372036854775809", "0xffffffffffffffff", "0x1ffffffffffffffff", "1.5", "", "  ", None, "12 %"],
         ["7", "7", "0", "7", "31", None, None, "2", "3", "9223372036854775807", "18446744073709551615", None, None, "18446744073709551615", None, None, None, None, None, None]),
        ("long", "rpm", ["4000rpm", "4000 RPM", "rpm", "0x10 rpm"], ["4000", "4000", None, "16"]),
        ("double", "C", ["1,5", "1.50 C", "1.5e0", "-.5", "5.", "nan", "inf", "1e999", "1,2,3", "C", "3"], ["1.5", "1.5", "1.5", "-0.5", "5.0", None, None, None, None, None, "3.0"]),
        ("boolean", None, ["TRUE", "yes", "on", "1", "2", "Off", "false(2)", "x(1)", "0", "maybe", ""], ["true", "true", "true", "true", "false", "false", "false", "true", None, None, None]),
        ("string", None, [" a ", "", "\t", None], ["a", None, None, None]),
    ],
)
def test_values(spark, kind, unit, values, want):
    assert column(spark, values, lambda c: read_value(c, F.lit(kind), F.lit(unit).cast("string"))) == want


def test_timestamps(spark):
    at = lambda *a: str(int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)
    values = ["2018-01-02T03:04:05Z", "2018-01-02 03:04:05", "2018-01-02T03:04:05+02:00", "2018-01-02T03:04:05-0130", "2018-02-30T00:00:00Z", "2018-01-02T25:00:00Z", "2018-01-02", "1514862245", "0x07e2010203040500", "0x07e20d0203040500", "0x07e2010203040501", "2018-01-02T03:04", "yesterday", "1.5"]
    want = [at(2018, 1, 2, 3, 4, 5), at(2018, 1, 2, 3, 4, 5), at(2018, 1, 2, 1, 4, 5), at(2018, 1, 2, 4, 34, 5), None, None, None, at(2018, 1, 2, 3, 4, 5), at(2018, 1, 2, 3, 4, 5), None, str(int(at(2018, 1, 2, 3, 4, 5)) + 100_000), at(2018, 1, 2, 3, 4), None, None]
    assert column(spark, values, lambda c: read_value(c, F.lit("timestamp"), F.lit(None).cast("string"))) == want


def test_typed(spark):
    assert column(spark, ["18446744073709551615"], lambda c: typed(c, "long"))[0] == 18446744073709551615
    assert column(spark, ["1514862245000000"], lambda c: typed(c, "timestamp"))[0].year == 2018
