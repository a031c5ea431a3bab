"""Events through a rule set: filter, clear, classify, suppress; outcomes, alerts and counters.

Everything but alarm or duplicate is decided row by row in one projection. Only events with a key go
through the shuffle by key, as (key, seq, time); their outcome is joined back by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapflow.config import AlarmRule, Rules
from trapflow.functions.expr import micros
from trapflow.functions.keys import dedup_key
from trapflow.functions.matching import Event, Slotted, compiles, compile_match, first_match, java_pattern, plain_oid, static_value
from trapflow.operators.suppression import alarms_and_duplicates
from trapflow.sources.shared import materialize

DEFAULT_DROP = "__default_drop__"


def _name(names: list[str], number: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), number) if names else F.lit(None).cast("string")


def filtered(event: Event, rules: Rules) -> tuple[Column, Column]:
    """(number of the first matching filter rule, its id if the event is dropped); -2: an error."""
    number = first_match([compile_match(event, f.match) for f in rules.filters])
    drops = [i for i, f in enumerate(rules.filters) if f.action == "drop"]
    dropped = F.when(number.isin(drops), _name([f.id for f in rules.filters], number)) if drops else F.lit(None).cast("string")
    return number, F.coalesce(dropped, F.when(number == -1, DEFAULT_DROP)) if rules.default_action == "drop" else dropped


_CLEAR_KEY = "struct<rule_id:string,key_hash:string,key_repr:string>"
_NOTE = "struct<event:string,rule_id:string,missing:string>"
# What the audit log calls a clear that did not get as far as its key.
CLEAR_ERROR, CLEAR_PATTERN, CLEAR_SKIPPED = "clear_match_error", "clear_regex_invalid", "trap_clear_skipped"


def _clear(event: Event, alarm: AlarmRule) -> tuple[Column, Column, Column]:
    """(what the alarm's clear says, key it clears, note): TRUE matched, FALSE pattern failed, NULL no match.
    The note says why a clear names no key: an error in its match, a wrong pattern, a missing field."""
    c = alarm.clear
    match = compile_match(event, c.match)
    matched = F.coalesce(match.value, F.lit(False))  # an error in a clear is passed over
    keys = c.key_fields or alarm.key_fields
    static = static_value(alarm.match, "trap_oid") if "trap_oid" in keys else None
    made = dedup_key(event.replaced(trap_oid=F.lit(static)) if static else event, keys)
    key = F.struct(F.lit(alarm.id).alias("rule_id"), made["hash"].alias("key_hash"), made["repr"].alias("key_repr"))

    def note(event_name: str, missing: Column | None = None) -> Column:
        return F.struct(F.lit(event_name).alias("event"), F.lit(alarm.id).alias("rule_id"), (F.lit(None).cast("string") if missing is None else missing).alias("missing"))

    failed = F.when(match.value.isNull(), note(CLEAR_ERROR)) if match.fails else F.lit(None).cast(_NOTE)
    hit = matched
    if c.varbind_oid and c.regex:
        java = java_pattern(c.regex)
        if java is None or not compiles(java):
            return F.when(matched, True), F.lit(None).cast(_CLEAR_KEY), F.coalesce(failed, F.when(matched, note(CLEAR_PATTERN)))
        hit = F.coalesce(F.try_element_at(event.varbinds, F.lit(plain_oid(c.varbind_oid))), F.lit("")).rlike(java)
    skipped = F.when(matched & hit & made["hash"].isNull(), note(CLEAR_SKIPPED, F.array_join(made["missing"], ",")))
    return F.when(matched, hit), F.when(matched & hit & made["hash"].isNotNull(), key), F.coalesce(failed, skipped)


def verdicts(events: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """seq, us, ``keep`` and the stateless decisions of each event.

    ``filter_rule`` (dropped by), ``failed`` (an error in a filter or alarm), ``matched_clear``,
    ``clears`` (keys it clears), ``notes`` (clears that name no key, and why), ``alarm_rule``, ``key_hash``,
    ``key_repr``, ``missing``. Each field that a rule names is looked up once.
    """
    empty = F.create_map().cast("map<string,string>")
    event = Slotted(F.coalesce(F.col("fields"), empty), F.coalesce(F.col("raw_varbind_map"), empty))
    number, dropped = filtered(event, rules)
    with_clear = [_clear(event, a) for a in rules.alarms if a.clear]
    said = F.lit(False)
    for verdict, *_ in with_clear:
        said = F.coalesce(verdict, said)  # a later alarm's clear overrules an earlier one's
    clears = F.filter(F.array(*(k for _, k, _ in with_clear)), lambda k: k.isNotNull()) if with_clear else F.array().cast(f"array<{_CLEAR_KEY}>")
    notes = F.filter(F.array(*(n for *_, n in with_clear)), lambda n: n.isNotNull()) if with_clear else F.array().cast(f"array<{_NOTE}>")
    alarm = first_match([compile_match(event, a.match) for a in rules.alarms])
    by_fields: dict[tuple[str, ...], list[int]] = {}
    for i, a in enumerate(rules.alarms):
        by_fields.setdefault(a.key_fields, []).append(i)
    key = F.lit(None).cast("struct<hash:string,repr:string,missing:array<string>>")
    for names, numbers in by_fields.items():
        key = F.when(F.col("_alarm").isin(*numbers), dedup_key(event, names)).otherwise(key)
    # Each field that a rule names is looked up once; verdicts and keys read these columns.
    resolved = events.select("seq", micros(F.col("received_at")).alias("us"), *keep, "raw_varbind_map", *(c.alias(n) for n, c in event.made.items()))
    first = resolved.select("*", number.alias("_filter"), dropped.alias("filter_rule"), said.alias("matched_clear"), clears.alias("clears"), notes.alias("notes"), alarm.alias("_alarm"))
    passes = F.col("filter_rule").isNull() & (F.col("_filter") != -2)
    goes_on = passes & ~F.col("matched_clear")
    out = first.withColumn("_key", F.when(goes_on & (F.col("_alarm") >= 0), key))
    return out.select(
        "seq", "us", *keep, "filter_rule", ((F.col("_filter") == -2) | goes_on & (F.col("_alarm") == -2)).alias("failed"), (F.col("matched_clear") & passes).alias("matched_clear"),
        F.when(passes, F.col("clears")).otherwise(F.array().cast(f"array<{_CLEAR_KEY}>")).alias("clears"), F.when(passes, F.col("notes")).otherwise(F.array().cast(f"array<{_NOTE}>")).alias("notes"),
        F.when(goes_on, _name([a.id for a in rules.alarms], F.when(F.col("_alarm") >= 0, F.col("_alarm")))).alias("alarm_rule"),
        F.col("_key.hash").alias("key_hash"), F.col("_key.repr").alias("key_repr"), F.col("_key.missing").alias("missing"),
    )


def held_for(rules: Rules, rule: str = "alarm_rule") -> tuple[Column, Column]:
    """(ttl_seconds, hold) of the alarm rule whose id is in column ``rule``."""
    if not rules.alarms:
        return F.lit(None).cast("int"), F.lit(None).cast("boolean")
    at = (F.array_position(F.array(*(F.lit(a.id) for a in rules.alarms)), F.col(rule)) - 1).cast("int")
    return F.get(F.array(*(F.lit(a.ttl_seconds) for a in rules.alarms)), at), F.get(F.array(*(F.lit(a.hold_until_clear) for a in rules.alarms)), at)


def plain_reason() -> Column:
    """Reason of an event that has no key to hold it back by."""
    return F.when(F.col("filter_rule").isNotNull(), "filtered").when(F.col("failed"), "failed").when(F.col("matched_clear") | F.col("alarm_rule").isNull(), "pass-through").otherwise("dedup_disabled")


def marked(decided: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """Alarm or duplicate for each event with a key (see ``alarms_and_duplicates``)."""
    ttl, hold = held_for(rules)
    alarms = decided.where("key_hash is not null and us is not null").select(F.col("alarm_rule").alias("rule_id"), "key_hash", "key_repr", "seq", "us", ttl.alias("ttl_seconds"), hold.alias("hold"), *keep)
    return alarms_and_duplicates(alarms, clear_operations(decided).select("rule_id", "key_hash", "seq"))


def clear_operations(decided: DataFrame) -> DataFrame:
    """A row for each key that an event's clears name."""
    return decided.where(F.size("clears") > 0).select("seq", "us", F.explode("clears").alias("c")).select("c.rule_id", "c.key_hash", "c.key_repr", "seq", "us")


def clear_notes(decided: DataFrame) -> DataFrame:
    """(seq, event, rule_id, missing) of clears that name no key."""
    return decided.where(F.size("notes") > 0).select("seq", F.explode("notes").alias("n")).select("seq", "n.*")


def outcomes(events: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """(seq, keep, accepted, forwarded, reason, rule_id) of each event.

    Reasons: failed (an error: neither accepted nor counted further), filtered, pass-through,
    dedup_disabled (a key field or the time is missing), alarm, duplicate. A sink may turn alarm,
    pass-through and dedup_disabled into forward_failed later. Null maps count as empty; seq must be
    unique. The decisions are written once to the shared folder, as they are read several times.
    """
    decided = materialize(verdicts(events, rules, *keep), "verdicts")
    plain = F.col("key_hash").isNull() | F.col("us").isNull()
    without_key = decided.where(plain).select("seq", *keep, plain_reason().alias("reason"), F.coalesce("filter_rule", "alarm_rule").alias("rule_id"))
    with_key = marked(decided, rules, *keep).select("seq", *keep, "reason", "rule_id")
    rows = without_key.unionByName(with_key)
    accepted = F.col("reason").isin("pass-through", "dedup_disabled", "alarm")
    rule = F.when(~F.col("reason").isin("pass-through", "failed"), F.col("rule_id"))
    return rows.select("seq", *keep, accepted.alias("accepted"), accepted.alias("forwarded"), "reason", rule.alias("rule_id"))
