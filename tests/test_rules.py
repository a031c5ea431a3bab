"""Rule files, the match language, keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trapflow.config import LARGEST, ConfigError, byte_size, parse_rules, text_of
from trapflow.functions.keys import dedup_key, key_text
from trapflow.functions.matching import Event, compile_match, constant_number, java_pattern, number, static_value

MINIMAL = "dedup_defaults: {ttl_seconds: 0, key_fields: [source_ip]}\n"


def test_defaults():
    r = parse_rules(MINIMAL)
    assert (r.server["max_dedup_entries"], r.server["queue_size"], r.server["worker_count"], r.server["stats_log_interval_seconds"]) == (10000, 1024, 1, 60)
    assert (r.metrics["host"], r.metrics["port"], r.metrics["path"]) == ("127.0.0.1", 9163, "/metrics")
    assert parse_rules("").default_action == "keep"
    assert parse_rules("forwarders: [{host: h, port: 1}]").targets[0].enabled is False


def test_inheritance():
    r = parse_rules(MINIMAL + "alarms: [{id: a}, {id: b, dedup: {ttl_seconds: 5, key_fields: [x]}}]")
    assert [(a.ttl_seconds, a.key_fields) for a in r.alarms] == [(300, ("source_ip",)), (5, ("x",))]


@pytest.mark.parametrize(
    "text",
    ["server: {max_dedup_entries: -1}", "server: {queue_size: -1}", "server: {port: 70000}", "metrics: {enabled: true, path: metrics}", "runtime: {memory_limit: nope}", "filters: {default_action: maybe}",
     "filters: {rules: [{action: drop}]}", "filters: {rules: [{id: a}, {id: a}]}", "filters: {rules: [{id: a, action: odd}]}", "alarms: [{id: a}]", MINIMAL + "alarms: [{id: a, dedup: {hold_until_clear: true}}]",
     MINIMAL + "alarms: [{id: a, dedup: {clear: {key_fields: [x]}}}]", "receiver: {v3_users: [{user_name: ' '}]}", "receiver: {v3_users: [{user_name: u, authentication_protocol: rot13}]}", "- list", "a: [", "filters: 3",
     "server: {port: many}", "server: {queue_size: [1]}", "dedup_defaults: {ttl_seconds: soon}", "forwarders: [{host: h, port: x}]", "filters: {rules: [3]}", MINIMAL + "alarms: [{id: a, dedup: {key_fields: 5}}]"],
)
def test_refused(text):
    with pytest.raises(ConfigError):
        parse_rules(text)


def test_a_filter_and_an_alarm_may_share_an_id():
    assert parse_rules(MINIMAL + "filters: {rules: [{id: a}]}\nalarms: [{id: a}]").filters[0].action == "drop"


def test_clear_with_other_keys_is_warned_of():
    r = parse_rules(MINIMAL + "alarms: [{id: a, dedup: {clear: {match: {x: y}, key_fields: [other]}}}]")
    assert "alarm a" in r.warnings()[0]


@pytest.mark.parametrize(("text", "size"), [("", 0), ("64MiB", 64 * 2**20), ("128MB", 128_000_000), ("4096", 4096), ("off", LARGEST), (" 2 kib ", 2048)])
def test_sizes(text, size):
    assert byte_size(text) == size


@pytest.mark.parametrize("text", ["wat", "-1", "0", "10XB", "99999999999TB"])
def test_wrong_sizes(text):
    with pytest.raises(ConfigError):
        byte_size(text)


def test_scalars_as_text():
    r = parse_rules("filters: {rules: [{id: a, match: {all: [yes, 1e3, 12:30:00, 0x10, 010, 1_000, null, true, 1e6, 0.00001]}}]}")
    assert [text_of(x) for x in r.filters[0].match["all"]] == ["yes", "1000", "12:30:00", "16", "8", "1000", "<nil>", "true", "1e+06", "1e-05"]


EVENT = {"trap_oid": ".1.3.6", "n": "10", "name": "abc", "nan": "NaN", "odd": "1d", "big": "1e999", "line": "end\n", "varbind.1.2": " .x ", "blank": "", "dot": "."}


@pytest.fixture(scope="module")
def holds(spark):
    df = spark.createDataFrame([(EVENT, {"1.2": "Clear"})], "fields map<string,string>, raw_varbind_map map<string,string>")

    def evaluate(spec):
        return df.select(compile_match(Event(F.col("fields"), F.col("raw_varbind_map")), spec).value.alias("v")).first().v

    return evaluate


def one(field, op, value=None):
    return {"all": [{"field": field, "op": op, "value": value}]}


BAD, NO, YES = {"field": "n", "op": "no_such"}, {"field": "n", "value": "0"}, {"field": "n", "value": 10}


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, True), ({"n": 10, "name": "abc"}, True), ({"n": 10, "name": "x"}, False), ({"trap_oid": "1.3.6"}, True), ({"trap_oid": " .1.3.6 "}, True),
        (one("varbind.1.2", "eq", "x"), True), (one("varbind:.1.2", "eq", ".x"), True), (one("fields.name", "eq", "abc"), True), (one("gone", "ne", "x"), True), (one("gone", "exists"), False), (one("blank", "exists"), False),
        (one("gone", "eq"), False), (one("name", "contains", "b"), True), (one("name", "prefix", ""), True), (one("name", "suffix", "c"), True), (one("name", "SUFFIX", "c"), True),
        (one("name", "in", ["x", "abc"]), True), (one("name", "in", "abc"), False), (one("n", "in", [10]), True), (one("n", "gt", 9), True), (one("n", "ge", "10"), True), (one("n", "lt", 10), False), (one("n", "le", 10.5), True),
        (one("nan", "gt", 0), False), (one("nan", "lt", 0), False), (one("odd", "gt", 0), False), (one("big", "gt", 0), False), (one("n", "gt", "x"), False), (one("n", "lt", "1_000"), True), (one("n", "lt", "0x1p5"), True),
        (one("name", "regex", "B"), False), (one("name", "regex", "(?i)B"), True), (one("name", "regex", "^ab?c$"), True), (one("line", "regex", "end$"), False), (one("line", "regex", "(?m)end$"), True),
        (one("name", "regex", "a(?=b)"), None), (one("varbind.1.2", "regex", ".*x"), None), (one("name", "regex", "("), None),
        ({"all": [NO, BAD]}, False), ({"all": [BAD, NO]}, None), ({"all": [YES, BAD]}, None), ({"any": [YES, BAD]}, True), ({"any": [NO, BAD]}, None), ({"any": [NO, YES]}, True), ({"any": []}, True), ({"not": [YES]}, False), ({"not": [NO, BAD]}, None),
        ({"not": [YES, BAD]}, False), ({"all": [YES], "any": [NO], "not": [BAD]}, False), ({"all": "x"}, None), ({"all": ["x"]}, None), ({"all": None}, True), ({"all": [YES], "name": "ignored"}, True), ({"any": [YES], "not": [NO]}, True),
    ],
)
def test_matches(holds, spec, want):
    assert holds(spec) is want


def test_numbers(spark):
    texts = ["1", "-1.5e3", ".5", "5.", "+0", " 1", "1 ", "1f", "1e999", "-1e999", "inf", "Infinity", "nan", "0x1.8p1", "0x1", "1__0", "1_0", "_1", "", "1\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.t: r.v for r in df.select("t", number(F.col("t")).alias("v")).collect()}
    assert got == {t: constant_number(t) for t in texts}
    assert constant_number("-1.5e3") == -1500.0 and constant_number("0x1.8p1") == 3.0 and constant_number("1f") is None


@pytest.mark.parametrize("pattern", ["(?<=a)b", "a++", r"(a)\1", "(?>a)", "*a", "a**", "a{1001}", "a{3,2}", "[a", "(a", "a)", "a\\", r"\Z"])
def test_patterns_of_other_dialects_are_refused(pattern):
    assert java_pattern(pattern) is None


def test_static_values():
    assert static_value({"trap_oid": ".1.2"}, "trap_oid") == ".1.2"
    assert static_value({"all": [{"field": "trap_oid", "value": "1"}, {"field": "trap_oid", "op": "eq", "value": "1"}]}, "trap_oid") == "1"
    assert static_value({"all": [{"field": "trap_oid", "value": "1"}, {"field": "trap_oid", "value": "2"}]}, "trap_oid") is None
    assert static_value({"any": [{"field": "trap_oid", "value": "1"}]}, "trap_oid") is None
    assert static_value({"all": [{"field": "trap_oid", "op": "EQ", "value": "1"}]}, "trap_oid") is None


def test_keys(spark):
    fields = {"a": 'q"\\<\n\x01é\u2028', "b": " .1 ", "e": ""}
    df = spark.createDataFrame([(fields, {})], "fields map<string,string>, raw_varbind_map map<string,string>")
    event = Event(F.col("fields"), F.col("raw_varbind_map"))
    k = df.select(dedup_key(event, ("a", "b")).alias("k"), dedup_key(event, ("a", "e", "x")).alias("m"), dedup_key(event, ()).alias("z")).first()
    text = '[{"field":"a","value":"q\\"\\\\\\u003c\\n\\u0001é\\u2028"},{"field":"b","value":" .1 "}]'
    assert k.k.repr == text == key_text(["a", "b"], [fields["a"], fields["b"]])
    assert k.k.hash == hashlib.sha256(text.encode()).hexdigest()
    assert (k.m.hash, k.m.missing, k.z.hash, k.z.missing) == (None, ["e", "x"], None, [])
