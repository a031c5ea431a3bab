"""Queries over the operators of the relay, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapflow.config import Rules, parse_rules
from trapflow.functions import ber
from trapflow.functions.expr import micros
from trapflow.functions.keys import dedup_key
from trapflow.functions.matching import Event, compile_match
from trapflow.functions.oid import normalize
from trapflow.operators.counters import ingest_counters, interval_stats, load_ramp, outcome_counters, queue_drops, step_deltas
from trapflow.operators.suppression import alarms_and_duplicates, cleared, states, swept
from trapflow.plans.oracles import ORACLES as TRAP_ORACLES
from trapflow.plans.relay import clear_notes, clear_operations, filtered, marked, outcomes, verdicts
from trapflow.sources.decode import decode_packets, field_map, raw_varbind_map
from trapflow.sources.shared import materialize
from trapflow.sources.sinks import alert_line, audit_log, summary
from trapflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(TRAP_ORACLES)


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


#: The rule set of the queries: it uses each kind of rule once.
RULES = """
filters:
  default_action: keep
  rules:
    - {id: keep_lab_links, action: keep, match: {all: [{field: community, value: lab}, {field: trap_oid, op: prefix, value: 1.3.6.1.6.3.1.1.5}]}}
    - {id: drop_lab, action: drop, match: {community: lab}}
    - {id: drop_odd_ports, match: {all: [{field: source_port, op: ge, value: 60000}, {field: version, op: in, value: [0, 1]}], not: [{field: trap_oid, op: exists}]}}
dedup_defaults:
  ttl_seconds: 600
  key_fields: [source_ip, trap_oid]
alarms:
  - id: link
    match: {trap_oid: 1.3.6.1.6.3.1.1.5.3}
    dedup: {clear: {match: {trap_oid: 1.3.6.1.6.3.1.1.5.4}}}
  - id: start
    match: {any: [{field: trap_oid, value: 1.3.6.1.6.3.1.1.5.1}, {field: trap_oid, value: 1.3.6.1.6.3.1.1.5.2}]}
    dedup: {ttl_seconds: 300, key_fields: [source_ip]}
  - id: neighbour
    match: {trap_oid: 1.3.6.1.6.3.1.1.5.6}
    dedup: {hold_until_clear: true, key_fields: [source_ip], clear: {match: {trap_oid: 1.3.6.1.6.3.1.1.5.2}}}
  - id: module
    match: {trap_oid: 1.3.6.1.4.1.99871.21.0.9}
    dedup: {ttl_seconds: 60, key_fields: [fields.device_id, trap_oid]}
"""


def rules() -> Rules:
    return parse_rules(RULES)


def events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "trap_event")


# ---- fields

_PLAIN = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g'), '^\.', '')"


def _norm(x: str) -> str:
    return _PLAIN.format(x)


_VARBINDS = "list_filter(varbinds, lambda v: {} = regexp_replace(regexp_replace(v.oid, '^\\s+|\\s+$', '', 'g'), '^\\.', ''))"
ALIASES = {".1.3.6.1.2.1.2.2.1.1": "shadowed", "1.3.6.1.2.1.2.2.1.1": "if_index", "1.3.6.1.4.1.99871.10.1": "device"}


@_add(
    "trap_fields",
    f"""SELECT seq, source_port::VARCHAR AS source_port, version::VARCHAR AS version, nullif(request_id, 0)::VARCHAR AS request_id, nullif({_norm('trap_oid')}, '') AS trap_oid,
    CASE WHEN version = 3 THEN 'v3' END AS snmp_version, {_VARBINDS.format("'1.3.6.1.4.1.99871.10.1'")}[-1].value AS device, {_VARBINDS.format("'1.3.6.1.2.1.2.2.1.1'")}[-1].value AS if_index FROM trap_event""",
)
def trap_fields(spark: SparkSession, root: str) -> DataFrame:
    df = events(spark, root)
    fields = df.select("seq", field_map(df, ALIASES).alias("f"))
    return fields.select("seq", *(F.try_element_at("f", F.lit(n)).alias(n) for n in ("source_port", "version", "request_id", "trap_oid", "snmp_version", "device")), F.try_element_at("f", F.lit("fields.if_index")).alias("if_index"))


@_add(
    "alias_lookup",
    r"SELECT e.seq, a.attr_name, count(*) AS n FROM (SELECT seq, unnest(varbinds) AS v FROM trap_event) e JOIN oid_alias a ON regexp_replace(regexp_replace(v.oid, '^\s+|\s+$', '', 'g'), '^\.', '') = ltrim(a.oid, '.') GROUP BY ALL",
)
def alias_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Bindings joined with the alias dimension; Spark broadcasts it while it is small."""
    bound = events(spark, root).select("seq", F.explode("varbinds").alias("v")).select("seq", normalize(F.col("v.oid")).alias("oid"))
    alias = table(spark, root, "oid_alias").select(normalize(F.col("oid")).alias("oid"), "attr_name")
    return bound.join(alias, "oid").groupBy("seq", "attr_name").agg(F.count(F.lit(1)).alias("n"))


@_add("oid_normalize", f"SELECT seq, {_norm('trap_oid')} AS oid FROM trap_event")
def oid_normalize(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).select("seq", normalize(F.coalesce("trap_oid", F.lit(""))).alias("oid"))


@_add(
    "event_summary",
    """SELECT seq, concat_ws(' ', 'src=' || concat_ws(':', source_ip, source_port::VARCHAR), 'version=' || version, coalesce('trap_oid=' || nullif(trap_oid, ''), 'pdu=' || nullif(pdu_type, '')),
    'enterprise=' || nullif(enterprise_oid, ''), 'generic=' || nullif(generic_trap_name, ''), 'specific=' || nullif(specific_trap, '')) AS summary FROM trap_event""",
)
def event_summary(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).select("seq", summary().alias("summary"))


@_add(
    "generic_trap_names",
    """SELECT seq, CASE generic_trap WHEN '0' THEN 'coldStart' WHEN '1' THEN 'warmStart' WHEN '2' THEN 'linkDown' WHEN '3' THEN 'linkUp' WHEN '4' THEN 'authenticationFailure' WHEN '5' THEN 'egpNeighborLoss'
    WHEN '6' THEN 'enterpriseSpecific' ELSE generic_trap END AS name FROM trap_event WHERE generic_trap IS NOT NULL""",
)
def generic_trap_names(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ber.GENERIC_NAMES))
    number = F.col("generic_trap").try_cast("int")
    return events(spark, root).where("generic_trap is not null").select("seq", F.coalesce(F.get(names, number), "generic_trap").alias("name"))


@_add(
    "alerts_log_line",
    """SELECT seq, regexp_replace(regexp_replace(strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') || 'Z ' || concat_ws(':', source_ip, source_port::VARCHAR) || ' -> TRAP '
    || CASE WHEN coalesce(trap_oid, '') = '' THEN '-' ELSE trap_oid END || ' ' || CASE WHEN len(varbinds) > 0 THEN '[ ' || array_to_string(list_transform(varbinds, lambda v: v.oid || ' = "' || coalesce(v.value, '') || '"'), ', ') || ' ]' ELSE '' END AS line
    FROM trap_event WHERE received_at IS NOT NULL""",
)
def alerts_log_line(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).where("received_at is not null").select("seq", alert_line(micros(F.col("received_at"))).alias("line"))


# ---- match language


def _event() -> Event:
    return Event(F.coalesce("fields", F.create_map().cast("map<string,string>")), F.coalesce("raw_varbind_map", F.create_map().cast("map<string,string>")))


def _f(name: str) -> str:
    return f"coalesce(fields['{name}'], '')"


_NUM = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, {_NUM}) THEN try_cast({x} AS DOUBLE) END"


_TEMP = "varbind.1.3.6.1.4.1.99871.10.3.2"
_TRAP = _norm("fields['trap_oid']")
MATCHES: dict[str, tuple[dict[str, Any], str]] = {
    "match_empty": ({}, "TRUE"),
    "match_simple_map": ({"version": 1, "trap_oid": ".1.3.6.1.6.3.1.1.5.3"}, f"{_f('version')} = '1' AND {_TRAP} = '1.3.6.1.6.3.1.1.5.3'"),
    "match_exists": ({"all": [{"field": "fields.device_id", "op": "exists"}]}, "coalesce(fields['fields.device_id'], fields['device_id'], '') <> ''"),
    "match_eq": ({"all": [{"field": "trap_oid", "value": "1.3.6.1.6.3.1.1.5.1"}]}, f"{_TRAP} = '1.3.6.1.6.3.1.1.5.1'"),
    "match_ne": ({"all": [{"field": "device_id", "op": "ne", "value": "nd-000000"}]}, f"{_f('device_id')} <> 'nd-000000'"),
    "match_contains": ({"all": [{"field": "source_ip", "op": "contains", "value": "db8"}]}, f"contains({_f('source_ip')}, 'db8')"),
    "match_prefix": ({"all": [{"field": "trap_oid", "op": "prefix", "value": "1.3.6.1.4.1"}]}, f"starts_with({_TRAP}, '1.3.6.1.4.1')"),
    "match_suffix": ({"all": [{"field": "trap_oid", "op": "suffix", "value": ".0.9"}]}, f"ends_with({_TRAP}, '0.9')"),
    "match_regex": ({"all": [{"field": "source_ip", "op": "regex", "value": r"^10\.7[0-5]\."}]}, rf"regexp_matches({_f('source_ip')}, '^10\.7[0-5]\.')"),
    "match_in": ({"all": [{"field": "version", "op": "in", "value": [0, 3]}]}, f"{_f('version')} IN ('0', '3')"),
    **{
        f"match_{op}": ({"all": [{"field": _TEMP, "op": op, "value": 42.7}]}, f"coalesce({_number(_norm(f'fields[{chr(39)}{_TEMP}{chr(39)}]'))} {sign} 42.7, FALSE)")
        for op, sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="))
    },
    "match_all_any_not": (
        {"all": [{"field": "version", "value": 1}], "any": [{"field": "source_port", "op": "lt", "value": 5000}, {"field": "device_id", "op": "exists"}], "not": [{"field": "trap_oid", "op": "prefix", "value": "1.3.6.1.6"}]},
        f"{_f('version')} = '1' AND (coalesce({_number(_f('source_port'))} < 5000, FALSE) OR {_f('device_id')} <> '') AND NOT starts_with({_TRAP}, '1.3.6.1.6')",
    ),
}


def _matching(spec: dict[str, Any]) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return events(spark, root).select("seq", compile_match(_event(), spec).value.alias("hit")).where("hit").select("seq")

    return query


for _name, (_spec, _sql) in MATCHES.items():
    QUERIES[_name] = _matching(_spec)
    ORACLES[_name] = f"SELECT seq FROM trap_event WHERE {_sql}"


_WRONG = {"field": "trap_oid", "op": "no_such", "value": 1}
_RIGHT = {"field": "version", "value": 1}
_V1 = f"{_f('version')} = '1'"
#: Conditions that can't be decided: what stands before them decides, what stands after is not looked at.
ERRORS: dict[str, tuple[dict[str, Any], str]] = {
    "match_error_after_false": ({"all": [_RIGHT, _WRONG]}, f"CASE WHEN NOT {_V1} THEN FALSE END"),
    "match_error_before_false": ({"all": [_WRONG, _RIGHT]}, "CAST(NULL AS BOOLEAN)"),
    "match_error_in_any": ({"any": [_RIGHT, _WRONG]}, f"CASE WHEN {_V1} THEN TRUE END"),
    "match_error_in_not": ({"all": [_RIGHT], "not": [{"field": "trap_oid", "op": "prefix", "value": "1.3.6.1.6"}, _WRONG]}, f"CASE WHEN NOT {_V1} OR starts_with({_TRAP}, '1.3.6.1.6') THEN FALSE END"),
    "match_error_no_list": ({"all": {"field": "version"}}, "CAST(NULL AS BOOLEAN)"),
    "match_error_pattern": ({"all": [_RIGHT, {"field": "community", "op": "regex", "value": "(a)\\1"}]}, f"CASE WHEN NOT {_V1} THEN FALSE END"),
    "match_op_case": ({"all": [{"field": "trap_oid", "op": "PREFIX", "value": " .1.3.6.1.4.1 "}]}, f"starts_with({_TRAP}, '1.3.6.1.4.1')"),
    "match_ne_missing": ({"all": [{"field": "varbind.9.9", "op": "ne", "value": "x"}, {"field": "varbind:.9.9", "op": "eq"}]}, "FALSE"),
    "match_wrong_number": ({"all": [{"field": "trap_oid", "op": "gt", "value": 1}]}, "FALSE"),
    "match_regex_dialect": ({"any": [{"field": "community", "op": "regex", "value": "^(?i)NOC-R.$"}, {"field": "pdu_type", "op": "regex", "value": "^[[:alpha:]]+v2"}]}, f"regexp_matches({_f('community')}, '^(?i)noc-r.$') OR regexp_matches({_f('pdu_type')}, '^[a-zA-Z]+v2')"),
}


def _deciding(spec: dict[str, Any]) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return events(spark, root).select("seq", compile_match(_event(), spec).value.alias("hit"))

    return query


for _name, (_spec, _sql) in ERRORS.items():
    QUERIES[_name] = _deciding(_spec)
    ORACLES[_name] = f"SELECT seq, {_sql} AS hit FROM trap_event"


# ---- filters, alarms, keys

_LAB, _LINKS = f"{_f('community')} = 'lab'", f"starts_with({_TRAP}, '1.3.6.1.6.3.1.1.5')"
_ODD = f"coalesce({_number(_f('source_port'))} >= 60000, FALSE) AND {_f('version')} IN ('0', '1') AND {_TRAP} = ''"
_FILTER = f"CASE WHEN {_LAB} AND {_LINKS} THEN NULL WHEN {_LAB} THEN 'drop_lab' WHEN {_ODD} THEN 'drop_odd_ports' END"


@_add("filter_first_match", f"SELECT seq, {_FILTER} AS rule FROM trap_event")
def filter_first_match(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).select("seq", filtered(_event(), rules())[1].alias("rule"))


@_add("filter_keep_whitelist", f"SELECT seq, CASE WHEN {_LAB} THEN NULL ELSE '__default_drop__' END AS rule FROM trap_event")
def filter_keep_whitelist(spark: SparkSession, root: str) -> DataFrame:
    """Only what a keep rule names passes; all else is dropped by default."""
    kept = parse_rules("filters: {default_action: drop, rules: [{id: lab, action: keep, match: {community: lab}}]}")
    return events(spark, root).select("seq", filtered(_event(), kept)[1].alias("rule"))


_IS = lambda n: f"{_TRAP} = '1.3.6.1.6.3.1.1.5.{n}'"
_ALARM = f"CASE WHEN {_IS(3)} THEN 'link' WHEN {_IS(1)} OR {_IS(2)} THEN 'start' WHEN {_IS(6)} THEN 'neighbour' WHEN {_TRAP} = '1.3.6.1.4.1.99871.21.0.9' THEN 'module' END"
_CLEARED = f"({_IS(4)} OR {_IS(2)})"


@_add("alarm_first_match", f"SELECT seq, CASE WHEN {_FILTER} IS NULL AND NOT {_CLEARED} THEN {_ALARM} END AS rule, {_FILTER} IS NULL AND {_CLEARED} AS cleared FROM trap_event")
def alarm_first_match(spark: SparkSession, root: str) -> DataFrame:
    return verdicts(events(spark, root), rules()).select("seq", F.col("alarm_rule").alias("rule"), F.col("matched_clear").alias("cleared"))


def _item(name: str, value: str) -> str:
    special = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        a_sql = f"chr({ord(a)})" if ord(a) < 32 else f"'{a}'"
        special = f"replace({special}, {a_sql}, '{b}')"
    return f"""'{{"field":"{name}","value":"' || {special} || '"}}'"""


_DEVICE = "coalesce(fields['fields.device_id'], fields['device_id'], '')"
_KEY = f"'[' || {_item('fields.device_id', _DEVICE)} || ',' || {_item('trap_oid', _f('trap_oid'))} || ']'"


@_add("dedup_key_hash", f"SELECT seq, {_KEY} AS key_repr, sha256({_KEY}) AS key_hash FROM trap_event WHERE {_DEVICE} <> '' AND {_f('trap_oid')} <> ''")
def dedup_key_hash(spark: SparkSession, root: str) -> DataFrame:
    key = events(spark, root).select("seq", dedup_key(_event(), ("fields.device_id", "trap_oid")).alias("k"))
    return key.where("k.hash is not null").select("seq", F.col("k.repr").alias("key_repr"), F.col("k.hash").alias("key_hash"))


@_add("dedup_missing_fields", f"SELECT seq, concat_ws(',', CASE WHEN {_DEVICE} = '' THEN 'fields.device_id' END, CASE WHEN {_f('trap_oid')} = '' THEN 'trap_oid' END) AS missing FROM trap_event")
def dedup_missing_fields(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).select("seq", F.array_join(dedup_key(_event(), ("fields.device_id", "trap_oid"))["missing"], ",").alias("missing"))


@_add(
    "clear_trap_oid_substitution",
    f"""SELECT seq, CASE WHEN {_IS(4)} THEN 'link' ELSE 'neighbour' END AS rule_id, sha256('[' || {_item('source_ip', _f('source_ip'))} || CASE WHEN {_IS(4)} THEN ',{{"field":"trap_oid","value":"1.3.6.1.6.3.1.1.5.3"}}]' ELSE ']' END) AS key_hash
    FROM trap_event WHERE {_CLEARED} AND {_f('source_ip')} <> '' AND {_FILTER} IS NULL""",
)
def clear_trap_oid_substitution(spark: SparkSession, root: str) -> DataFrame:
    """Keys that clears name: a clear takes the alarm's own trap type for the one it came with."""
    decided = verdicts(events(spark, root), rules())
    return decided.select("seq", F.explode("clears").alias("c")).select("seq", "c.rule_id", "c.key_hash")


@_add("clear_varbind_regex", rf"SELECT seq, {_TRAP} LIKE '1.3.6.1.4.1.%' AND regexp_matches(coalesce(raw_varbind_map['1.3.6.1.4.1.99871.10.41'], ''), '(?i)restored|up$') AS cleared FROM trap_event")
def clear_varbind_regex(spark: SparkSession, root: str) -> DataFrame:
    made = parse_rules(
        r"alarms: [{id: text, match: {trap_oid: '1.2.3'}, dedup: {key_fields: [source_ip], clear: {match: {all: [{field: trap_oid, op: prefix, value: '1.3.6.1.4.1.'}]}, varbind_oid: .1.3.6.1.4.1.99871.10.41, regex: '(?i)restored|up$'}}}]"
    )
    return verdicts(events(spark, root), made).select("seq", F.col("matched_clear").alias("cleared"))


# ---- suppression, on the plain event table

_US = "epoch_us(ts)"


def _leaders(source: str, part: str, ttl_us: int) -> str:
    return f"""lead_ AS (SELECT {part}, min(seq) AS seq, arg_min(us, seq) AS us FROM {source} GROUP BY {part} UNION ALL
    SELECT {", ".join(f"l.{p.strip()}" for p in part.split(","))}, min(a.seq), arg_min(a.us, a.seq) FROM lead_ l JOIN {source} a ON {" AND ".join(f"a.{p.strip()} = l.{p.strip()}" for p in part.split(","))} AND a.seq > l.seq AND a.us >= l.us + {ttl_us} GROUP BY {", ".join(f"l.{p.strip()}" for p in part.split(","))}, l.seq)"""


def _stream(spark: SparkSession, root: str, kind: str, ttl: int, hold: bool = False) -> DataFrame:
    rows = table(spark, root, "events").where(F.col("event_type") == kind)
    return rows.select(F.lit("r").alias("rule_id"), F.col("user_id").cast("string").alias("key_hash"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("us"), F.lit(ttl).alias("ttl_seconds"), F.lit(hold).alias("hold"))


def _suppressed(spark: SparkSession, root: str, ttl: int, hold: bool, clears: bool) -> DataFrame:
    cleared = _stream(spark, root, "signup", ttl).select("rule_id", "key_hash", "seq")
    return alarms_and_duplicates(_stream(spark, root, "error", ttl, hold), cleared if clears else cleared.where(F.lit(False)))


_ERRORS = f"a AS (SELECT user_id, event_id AS seq, {_US} AS us FROM events WHERE event_type = 'error')"
_EPOCHS = f"""o AS (SELECT user_id, event_id AS seq, {_US} AS us, event_type FROM events WHERE event_type IN ('error', 'signup')),
e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS epoch FROM o), a AS (SELECT user_id, epoch, seq, us FROM e WHERE event_type = 'error')"""
DAY = 86_400
_DECIDED = "SELECT a.seq, CASE WHEN l.seq IS NULL THEN 'duplicate' ELSE 'alarm' END AS reason FROM a LEFT JOIN lead_ l ON a.seq = l.seq"


@_add("dedup_ttl", f"WITH RECURSIVE {_ERRORS}, {_leaders('a', 'user_id', DAY * 1_000_000)} {_DECIDED}")
def dedup_ttl(spark: SparkSession, root: str) -> DataFrame:
    return _suppressed(spark, root, DAY, False, False).select("seq", "reason")


@_add("dedup_ttl_with_clear", f"WITH RECURSIVE {_EPOCHS}, {_leaders('a', 'user_id, epoch', 2 * DAY * 1_000_000)} {_DECIDED}")
def dedup_ttl_with_clear(spark: SparkSession, root: str) -> DataFrame:
    return _suppressed(spark, root, 2 * DAY, False, True).select("seq", "reason")


@_add("dedup_hold_until_clear", f"WITH {_EPOCHS} SELECT seq, CASE WHEN row_number() OVER (PARTITION BY user_id, epoch ORDER BY seq) = 1 THEN 'alarm' ELSE 'duplicate' END AS reason FROM a")
def dedup_hold_until_clear(spark: SparkSession, root: str) -> DataFrame:
    return _suppressed(spark, root, DAY, True, True).select("seq", "reason")


@_add(
    "suppressed_counts",
    f"""WITH RECURSIVE {_ERRORS}, {_leaders('a', 'user_id', DAY * 1_000_000)}, n AS (SELECT a.user_id, a.seq, a.us, count(l.seq) OVER (PARTITION BY a.user_id ORDER BY a.seq) AS w, l.seq IS NOT NULL AS opens FROM a LEFT JOIN lead_ l ON a.seq = l.seq)
    SELECT user_id::VARCHAR AS key_hash, min(seq) AS first_seq, min(us) AS first_us, max(us) AS last_us, count(*) - 1 AS suppressed_count FROM n GROUP BY user_id, w""",
)
def suppressed_counts(spark: SparkSession, root: str) -> DataFrame:
    marked = materialize(_suppressed(spark, root, DAY, False, False), "marked")
    return states(marked).select("key_hash", "first_seq", "first_us", "last_us", "suppressed_count")


# ---- the whole relay

_TTL = "CASE rule WHEN 'link' THEN 600000000 WHEN 'start' THEN 300000000 WHEN 'module' THEN 60000000 END"
_RELAY = f"""WITH RECURSIVE d AS (SELECT seq, epoch_us(received_at) AS us, {_FILTER} AS dropped, {_CLEARED} AS cleared, {_IS(4)} AS up, {_IS(2)} AS warm, {_ALARM} AS rule, {_f('source_ip')} AS ip, {_DEVICE} AS device, {_f('trap_oid')} AS oid FROM trap_event),
k AS (SELECT *, CASE WHEN rule = 'module' THEN nullif(device, '') || '|' || oid WHEN rule = 'link' THEN nullif(ip, '') || '|' || nullif(oid, '') ELSE nullif(ip, '') END AS key FROM d),
ops AS (SELECT rule, key, seq, us, 1 AS rank FROM k WHERE dropped IS NULL AND NOT cleared AND rule IS NOT NULL AND key IS NOT NULL AND us IS NOT NULL
  UNION ALL SELECT 'link', ip || '|1.3.6.1.6.3.1.1.5.3', seq, NULL, 0 FROM k WHERE dropped IS NULL AND up AND ip <> '' UNION ALL SELECT 'neighbour', ip, seq, NULL, 0 FROM k WHERE dropped IS NULL AND warm AND ip <> ''),
e AS (SELECT *, sum(1 - rank) OVER (PARTITION BY rule, key ORDER BY seq, rank) AS epoch FROM ops), a AS (SELECT *, coalesce({_TTL}, 1000000000000000) AS ttl FROM e WHERE rank = 1),
lead_ AS (SELECT rule, key, epoch, min(seq) AS seq, arg_min(us, seq) AS us, any_value(ttl) AS ttl FROM a GROUP BY rule, key, epoch UNION ALL
  SELECT l.rule, l.key, l.epoch, min(a.seq), arg_min(a.us, a.seq), any_value(l.ttl) FROM lead_ l JOIN a ON a.rule = l.rule AND a.key = l.key AND a.epoch = l.epoch AND a.seq > l.seq AND a.us >= l.us + l.ttl GROUP BY l.rule, l.key, l.epoch, l.seq),
r AS (SELECT k.seq, k.dropped, k.rule, CASE WHEN dropped IS NOT NULL THEN 'filtered' WHEN cleared OR k.rule IS NULL THEN 'pass-through' WHEN a.seq IS NULL THEN 'dedup_disabled' WHEN l.seq IS NULL THEN 'duplicate' ELSE 'alarm' END AS reason
  FROM k LEFT JOIN a USING (seq) LEFT JOIN lead_ l USING (seq))"""
_RULE = "CASE WHEN reason = 'filtered' THEN dropped WHEN reason <> 'pass-through' THEN rule END"


@_add("relay_outcomes", f"{_RELAY} SELECT seq, reason IN ('pass-through', 'dedup_disabled', 'alarm') AS forwarded, reason, {_RULE} AS rule_id FROM r")
def relay_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Every trap through the rule set: filtered, passed, forwarded as an alarm or held back."""
    return outcomes(events(spark, root), rules()).select("seq", "forwarded", "reason", "rule_id")


@_add("relay_counts", f"{_RELAY} SELECT reason, {_RULE} AS rule_id, count(*) AS n FROM r GROUP BY ALL")
def relay_counts(spark: SparkSession, root: str) -> DataFrame:
    return relay_outcomes(spark, root).groupBy("reason", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "dedup_states",
    f"""{_RELAY}, held AS (SELECT l.rule, l.seq AS first_seq, l.us AS first_us, count(*) - 1 AS suppressed_count FROM a ASOF JOIN lead_ l ON a.rule = l.rule AND a.key = l.key AND a.epoch = l.epoch AND a.seq >= l.seq GROUP BY ALL)
    SELECT rule AS rule_id, first_seq, first_us, source_ip, source_port, {_norm('trap_oid')} AS trap_oid, suppressed_count FROM held JOIN trap_event t ON t.seq = held.first_seq""",
)
def dedup_states(spark: SparkSession, root: str) -> DataFrame:
    """Every window with its first event (time, sender, type) and how many it held back."""
    decided = materialize(verdicts(events(spark, root), rules(), "source_ip", "source_port", "trap_oid"), "verdicts")
    held = states(materialize(marked(decided, rules()), "marked"))
    first = decided.select(F.col("seq").alias("first_seq"), "source_ip", "source_port", normalize(F.coalesce("trap_oid", F.lit(""))).alias("trap_oid"))
    return held.join(first, "first_seq").select("rule_id", "first_seq", "first_us", "source_ip", "source_port", "trap_oid", "suppressed_count")


@_add(
    "clears_of_states",
    f"""{_RELAY}, c AS (SELECT e.rule, e.key, e.seq, e.epoch, k.us FROM e JOIN k USING (seq) WHERE e.rank = 0), last_ AS (SELECT rule, key, epoch, max(seq) AS seq, arg_max(us, seq) AS us, any_value(ttl) AS ttl FROM lead_ GROUP BY ALL),
    n AS (SELECT l.rule, l.seq, count(*) - 1 AS suppressed_count FROM a ASOF JOIN lead_ l ON a.rule = l.rule AND a.key = l.key AND a.epoch = l.epoch AND a.seq >= l.seq GROUP BY ALL)
    SELECT c.rule AS rule_id, c.seq, coalesce(l.seq IS NOT NULL AND (c.us IS NULL OR c.us < l.us + l.ttl), FALSE) AS active, CASE WHEN c.us IS NULL OR c.us < l.us + l.ttl THEN l.us END AS first_us, CASE WHEN c.us IS NULL OR c.us < l.us + l.ttl THEN n.suppressed_count END AS suppressed_count
    FROM c LEFT JOIN last_ l ON l.rule = c.rule AND l.key = c.key AND l.epoch = c.epoch - 1 LEFT JOIN n ON n.rule = l.rule AND n.seq = l.seq""",
)
def clears_of_states(spark: SparkSession, root: str) -> DataFrame:
    """The audit log's clears: whether each found an open window, since when and with how many held back."""
    decided = materialize(verdicts(events(spark, root), rules()), "verdicts")
    got = cleared(materialize(marked(decided, rules()), "marked"), clear_operations(decided))
    return got.select("rule_id", "seq", "active", "first_us", "suppressed_count")


@_add("clear_notes", f"SELECT seq, 'trap_clear_skipped' AS event, CASE WHEN {_IS(4)} THEN 'link' ELSE 'neighbour' END AS rule_id, 'source_ip' AS missing FROM trap_event WHERE {_CLEARED} AND {_f('source_ip')} = '' AND {_FILTER} IS NULL")
def notes(spark: SparkSession, root: str) -> DataFrame:
    """Clears that name no key, and the field that is missing."""
    return clear_notes(verdicts(events(spark, root), rules()))


@_add("ttl_sweep", "SELECT rule_id, key_hash FROM dedup_state WHERE NOT hold_until_clear AND epoch_us(first_seen_at) + ttl_seconds::BIGINT * 1000000 <= epoch_us(TIMESTAMP '2018-01-15 00:00:00')")
def ttl_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Stored states that a sweep in the middle of the month drops."""
    return swept(table(spark, root, "dedup_state"), F.lit("2018-01-15 00:00:00").cast("timestamp")).select("rule_id", "key_hash")


@_add(
    "audit_log",
    f"""{_RELAY}, o AS (SELECT seq, reason, {_RULE} AS rule_id FROM r) SELECT seq, CASE reason WHEN 'filtered' THEN 'trap_filtered' WHEN 'alarm' THEN 'trap_forwarded' WHEN 'duplicate' THEN 'trap_deduplicated' WHEN 'dedup_disabled' THEN 'trap_forwarded_dedup_disabled' ELSE 'trap_passed' END AS event, rule_id,
    CASE WHEN reason IN ('alarm', 'duplicate') THEN CASE rule_id WHEN 'neighbour' THEN 'none' WHEN 'link' THEN '600s' WHEN 'start' THEN '300s' ELSE '60s' END END AS ttl, CASE WHEN reason IN ('alarm', 'duplicate') AND rule_id = 'neighbour' THEN TRUE END AS hold_until_clear FROM o""",
)
def audit(spark: SparkSession, root: str) -> DataFrame:
    """Each outcome as the audit log names it, with how long its rule holds repeats back."""
    return audit_log(outcomes(events(spark, root), rules()), rules()).select("seq", "event", "rule_id", "ttl", "hold_until_clear")


#: The notification that an event's own columns and bindings say, where the stored ``trap_oid`` is blank or written oddly.
_SAID = f"CASE WHEN e.version = 0 THEN 'v1:' || e.enterprise_oid || ':' || e.generic_trap || ':' || e.specific_trap ELSE {_norm(_VARBINDS.format(chr(39) + ber.TRAP_OID + chr(39)).replace('varbinds', 'e.varbinds') + '[-1].value')} END"
#: Events of the packets that can be read, as the decoder gives them: what rules may name is built from the packet.
_PACKET_EVENTS = """(SELECT p.seq, p.received_at, MAP {'source_ip': coalesce(p.source_ip, ''), 'source_port': coalesce(p.source_port::VARCHAR, ''), 'version': e.version::VARCHAR, 'community': e.community, 'trap_oid': {said},
 'device_id': coalesce({device}, '')} AS fields, {said} AS trap_oid FROM raw_packet p JOIN trap_event e USING (seq))""".replace("{said}", _SAID).replace("{device}", _VARBINDS.format("'1.3.6.1.4.1.99871.10.1'").replace("varbinds", "e.varbinds") + "[-1].value")
_RELAY_PACKETS = _RELAY.replace("FROM trap_event)", f"FROM {_PACKET_EVENTS})", 1)


def _packet_outcomes(spark: SparkSession, root: str, read: DataFrame) -> DataFrame:
    read = read.where("error is null").drop("error")
    mapped = read.withColumn("raw_varbind_map", raw_varbind_map()).withColumn("fields", field_map(read, {"1.3.6.1.4.1.99871.10.1": "device_id"}))
    return outcomes(mapped, rules())


@_add("relay_packets", f"{_RELAY_PACKETS} SELECT reason, {_RULE} AS rule_id, count(*) AS n FROM r GROUP BY ALL")
def relay_packets(spark: SparkSession, root: str) -> DataFrame:
    """Datagrams decoded and relayed in one plan: counts by reason."""
    return _packet_outcomes(spark, root, decode_packets(table(spark, root, "raw_packet"))).groupBy("reason", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "ingest_snapshot",
    f"""{_RELAY_PACKETS} SELECT (SELECT count(*) FROM raw_packet) AS received, (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY epoch_us(received_at) // 60000000 ORDER BY seq) AS n FROM raw_packet) WHERE n > 2) AS queue_dropped,
    (SELECT count(*) FROM raw_packet ANTI JOIN trap_event USING (seq)) AS parse_failed, 0::BIGINT AS handle_failed, count(*) FILTER (reason IN ('pass-through', 'dedup_disabled', 'alarm')) AS accepted, count(*) FILTER (reason IN ('pass-through', 'dedup_disabled', 'alarm')) AS forwarded,
    count(*) FILTER (reason = 'filtered') AS filtered, count(*) FILTER (reason = 'duplicate') AS duplicates, count(*) FILTER (reason = 'pass-through') AS pass_through, count(*) FILTER (reason = 'alarm') AS alarms, count(*) FILTER (reason = 'dedup_disabled') AS dedup_disabled, 0::BIGINT AS forward_failed FROM r""",
)
def ingest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """All counters of one run over the packets, counted; the drops are those a queue of 2 a minute would make."""
    packets = table(spark, root, "raw_packet")
    read = materialize(decode_packets(packets), "decoded")
    return ingest_counters(queue_drops(packets, "received_at", "seq", 2, 60), read, _packet_outcomes(spark, root, read), "dropped")


@_add(
    "load_ramp",
    """SELECT rate, count(*) AS ticks, sum(rate)::BIGINT AS packets, sum(greatest(rate - 3, 0))::BIGINT AS dropped, sum(greatest(rate - 3, 0)) = 0 AS loss_free FROM (SELECT count(*) AS rate FROM raw_packet GROUP BY epoch_us(received_at) // 600000000) GROUP BY rate""",
)
def ramp(spark: SparkSession, root: str) -> DataFrame:
    """Ticks of ten minutes by rate, and what a queue of 3 would have dropped."""
    return load_ramp(table(spark, root, "raw_packet"), "received_at", 600, 3)


# ---- wire format

_V1_ONLY = ("enterprise_oid", "agent_address", "generic_trap", "generic_trap_name", "specific_trap")


@_add(
    "decode_packets",
    f"""SELECT p.seq, e.seq IS NOT NULL AS readable, e.version, e.community, e.uptime, CASE WHEN e.version = 1 THEN '0xa7' WHEN e.version = 0 THEN '0xa4' END AS pdu_type, CASE WHEN e.seq IS NULL THEN '' ELSE {_SAID} END AS trap_oid, len(e.varbinds) AS n_varbinds,
    {", ".join(f"coalesce(e.{c}, '') AS {c}" for c in _V1_ONLY)} FROM raw_packet p LEFT JOIN trap_event e USING (seq)""",
)
def decode(spark: SparkSession, root: str) -> DataFrame:
    read = decode_packets(table(spark, root, "raw_packet"))
    v1 = [F.coalesce(c, F.lit("")).alias(c) for c in _V1_ONLY]
    return read.select("seq", F.col("error").isNull().alias("readable"), "version", "community", "uptime", "pdu_type", normalize(F.coalesce("trap_oid", F.lit(""))).alias("trap_oid"), F.size("varbinds").alias("n_varbinds"), *v1)


@_add("decode_requests", "SELECT seq, e.request_id, e.error_status, e.error_index FROM raw_packet p JOIN trap_event e USING (seq) WHERE e.request_id IS NOT NULL AND e.pdu_type = '0xa7'")
def decode_requests(spark: SparkSession, root: str) -> DataFrame:
    """Request and error numbers of the packets whose stored event has them."""
    stored = events(spark, root).where("request_id is not null and pdu_type = '0xa7'").select("seq")
    return decode_packets(table(spark, root, "raw_packet")).join(stored, "seq", "left_semi").select("seq", "request_id", "error_status", "error_index")


@_add("decode_varbinds", "SELECT seq, unnest(range(len(varbinds))) AS place, ltrim(unnest(varbinds).oid, '.') AS oid, unnest(varbinds).type_name AS type_name, CASE WHEN unnest(varbinds).type_name = 'OctetString' THEN unnest(varbinds).value ELSE trim(unnest(varbinds).value) END AS value FROM raw_packet p JOIN trap_event e USING (seq)")
def decode_varbinds(spark: SparkSession, root: str) -> DataFrame:
    """Every binding of the packets: place, identifier, type and value as text."""
    read = decode_packets(table(spark, root, "raw_packet"), short_names=True)
    return read.select("seq", F.posexplode("varbinds").alias("place", "v")).select("seq", F.col("place").cast("bigint").alias("place"), "v.oid", "v.type_name", "v.value")


@_add("decode_library", "SELECT seq, e.version, CASE WHEN e.version = 1 THEN 'SNMPv2Trap' ELSE 'Trap' END AS pdu_type, NULL::BIGINT AS request_id, 'OctetString' AS a_type FROM raw_packet p JOIN trap_event e USING (seq) WHERE len(list_filter(e.varbinds, lambda v: v.type_name = 'OctetString')) > 0")
def decode_library(spark: SparkSession, root: str) -> DataFrame:
    """Events in the other shape: kinds by name, short type names, no request numbers."""
    read = decode_packets(table(spark, root, "raw_packet"), library=True).where("error is null")
    return read.select("seq", "version", "pdu_type", "request_id", F.get(F.filter("varbinds", lambda v: v.type_name == "OctetString"), F.lit(0)).type_name.alias("a_type")).where("a_type is not null")


@_add("ber_roundtrip", rf"SELECT seq, {_norm('trap_oid')} AS trap_oid, coalesce(len(varbinds), 0) AS n_varbinds, coalesce(varbinds[1].value, '') AS first_value FROM trap_event WHERE regexp_full_match({_norm('trap_oid')}, '[0-9]+(\.[0-9]+)+')")
def ber_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Traps written to the wire and read again."""

    @F.pandas_udf("struct<trap_oid:string,n_varbinds:int,first_value:string>")
    def again(oids: pd.Series, bound: pd.Series) -> pd.DataFrame:
        out = []
        for oid, vbs in zip(oids, bound, strict=True):
            pairs = [(v["oid"], ber.octets(v["value"] or "")) for v in (vbs if vbs is not None else [])]
            got = ber.read_message(ber.v2_trap(oid, pairs)).varbinds
            out.append((got[1][2], len(got) - 2, got[2][2] if len(got) > 2 else ""))
        return pd.DataFrame(out, columns=["trap_oid", "n_varbinds", "first_value"])

    rows = events(spark, root).select("seq", normalize(F.coalesce("trap_oid", F.lit(""))).alias("oid"), "varbinds").where(F.col("oid").rlike(r"^[0-9]+(\.[0-9]+)+$"))
    return rows.select("seq", again("oid", "varbinds").alias("a")).select("seq", "a.*")


# ---- counters

@_add(
    "outcome_counts",
    """SELECT count(*) FILTER (accepted) AS accepted, count(*) FILTER (forwarded) AS forwarded, count(*) FILTER (reason = 'filtered') AS filtered, count(*) FILTER (reason = 'duplicate') AS duplicates,
    count(*) FILTER (reason = 'pass-through') AS pass_through, count(*) FILTER (reason = 'alarm') AS alarms, count(*) FILTER (reason = 'dedup_disabled') AS dedup_disabled, count(*) FILTER (reason = 'forward_failed') AS forward_failed,
    count(*) FILTER (reason = 'failed') AS handle_failed FROM outcome""",
)
def outcome_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "outcome").agg(*outcome_counters())


@_add(
    "stats_by_interval",
    """WITH c AS (SELECT (epoch_us(received_at) // 3600000000 + 1) * 3600 AS at_s, count(*) AS received, count(*) FILTER (accepted) AS accepted, count(*) FILTER (reason = 'duplicate') AS duplicates FROM outcome JOIN trap_event USING (seq) WHERE received_at IS NOT NULL GROUP BY 1)
    SELECT at_s, (sum(received) OVER w)::BIGINT AS received, (sum(accepted) OVER w)::BIGINT AS accepted, (sum(duplicates) OVER w)::BIGINT AS duplicates FROM c WINDOW w AS (ORDER BY at_s)""",
)
def stats_by_interval(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "outcome").join(events(spark, root).select("seq", "received_at"), "seq")
    return interval_stats(rows, "received_at", 3600).select(F.unix_timestamp("at").alias("at_s"), "received", "accepted", "duplicates")


@_add(
    "metrics_step_delta",
    """SELECT * FROM (SELECT epoch_us(snapshot_at) AS at_us, received - lag(received) OVER w AS received, forwarded - lag(forwarded) OVER w AS forwarded, accepted - lag(accepted) OVER w AS sent, queue_dropped - lag(queue_dropped) OVER w = 0 AND received - lag(received) OVER w >= accepted - lag(accepted) OVER w AS loss_free FROM metrics_snapshot WINDOW w AS (ORDER BY snapshot_at)) WHERE received IS NOT NULL""",
)
def metrics_step_delta(spark: SparkSession, root: str) -> DataFrame:
    """Counters between snapshots; what was accepted stands for what a sender counts as sent."""
    rows = step_deltas(table(spark, root, "metrics_snapshot").withColumn("sent", F.col("accepted")), "snapshot_at", ["received", "forwarded", "queue_dropped", "sent"])
    return rows.select(F.unix_micros("snapshot_at").alias("at_us"), "received", "forwarded", "sent", "loss_free")


@_add("queue_drop_simulation", "SELECT seq, row_number() OVER (PARTITION BY epoch_us(received_at) // 60000000 ORDER BY seq) > 2 AS dropped FROM raw_packet")
def queue_drop_simulation(spark: SparkSession, root: str) -> DataFrame:
    return queue_drops(table(spark, root, "raw_packet"), "received_at", "seq", capacity=2, tick_s=60)


