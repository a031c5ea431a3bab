"""Where outcomes go: alert lines, the audit log, datagrams to other receivers."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapflow.config import Rules, Target


def shown(value: Column) -> Column:
    """A dash for what is blank or missing."""
    return F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(value)


def rfc3339(us: Column) -> Column:
    """Time with as many digits of a second as it needs, in UTC."""
    text = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def endpoint() -> Column:
    return F.concat_ws(":", "source_ip", F.col("source_port").cast("string"))


def summary() -> Column:
    """One line that names an event: sender, version, type or kind, and what only version 1 has."""
    def part(label: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}="), F.col(c)))

    kind = F.coalesce(part("trap_oid", "trap_oid"), part("pdu", "pdu_type"))
    return F.concat_ws(" ", F.concat(F.lit("src="), endpoint()), F.concat(F.lit("version="), F.col("version").cast("string")), kind, part("enterprise", "enterprise_oid"), part("generic", "generic_trap_name"), part("specific", "specific_trap"))


def alert_line(us: Column) -> Column:
    """``<time> <sender> -> TRAP <type> [ <oid> = "<value>", ... ]``; a blank at the end if there is nothing to list."""
    pairs = F.transform(F.coalesce("varbinds", F.array().cast("array<struct<oid:string,type_name:string,value:string>>")), lambda v: F.concat(v["oid"], F.lit(' = "'), F.coalesce(v["value"], F.lit("")), F.lit('"')))
    listed = F.when(F.size(pairs) > 0, F.concat(F.lit("[ "), F.array_join(pairs, ", "), F.lit(" ]"))).otherwise("")
    return F.concat(rfc3339(us), F.lit(" "), endpoint(), F.lit(" -> TRAP "), shown(F.col("trap_oid")), F.lit(" "), listed)


def write_alerts(lines: DataFrame, path: str) -> None:
    """Append alert lines (column ``line``) as text files."""
    lines.select("line").write.mode("append").text(path)


# What the audit log calls each outcome.
EVENT_NAMES = {"filtered": "trap_filtered", "alarm": "trap_forwarded", "duplicate": "trap_deduplicated", "dedup_disabled": "trap_forwarded_dedup_disabled", "pass-through": "trap_passed", "failed": "trap_handle_failed", "forward_failed": "trap_forward_failed", "parse_failed": "trap_parse_failed"}


def audit_log(outcomes: DataFrame, rules: Rules) -> DataFrame:
    """A row for each outcome: its event name, rule and how long the rule holds repeats back.

    ``ttl`` is ``<n>s`` or ``none`` for rules that hold until cleared, with ``hold_until_clear`` and a note.
    """
    names = F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv))
    ids = F.array(*(F.lit(a.id) for a in rules.alarms)) if rules.alarms else F.array().cast("array<string>")
    at = (F.array_position(ids, F.col("rule_id")) - 1).cast("int")
    has = F.col("reason").isin("alarm", "duplicate") & (at >= 0)
    ttl = F.get(F.array(*(F.lit(a.ttl_seconds) for a in rules.alarms)), at) if rules.alarms else F.lit(None).cast("int")
    hold = F.get(F.array(*(F.lit(a.hold_until_clear) for a in rules.alarms)), at) if rules.alarms else F.lit(None).cast("boolean")
    return outcomes.select(
        "*", F.try_element_at(names, F.col("reason")).alias("event"), F.when(has, F.when(hold, "none").otherwise(F.concat(ttl.cast("string"), F.lit("s")))).alias("ttl"),
        F.when(has & ~hold, ttl).alias("ttl_seconds"), F.when(has & hold, True).alias("hold_until_clear"), F.when(has & hold, "held until a clear arrives").alias("ttl_note"),
    )


def _open(targets: Sequence[Target]) -> list[tuple[Target, socket.socket]]:
    out = []
    for t in targets:
        family, _, _, _, address = socket.getaddrinfo(t.host, t.port, type=socket.SOCK_DGRAM)[0]
        s = socket.socket(family, socket.SOCK_DGRAM)
        if t.source_host:
            s.bind((t.source_host, 0))
        s.connect(address)
        out.append((t, s))
    return out


def fan_out(packets: DataFrame, targets: Sequence[Target], payload: str = "raw_bytes") -> DataFrame:
    """Send each row's bytes to every enabled target: (seq, forward_failed, error).

    All targets are tried, their errors are joined. Sending is an effect of evaluation: evaluate the
    result once (a lost task sends again, so delivery is at least once). A null payload is not sent.
    """
    enabled = [t for t in targets if t.enabled]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sockets = _open(enabled)
        try:
            for pdf in batches:
                rows = []
                for seq, data in zip(pdf["seq"], pdf["payload"], strict=True):
                    errors = []
                    for t, s in sockets if data is not None else ():
                        try:
                            s.send(bytes(data))
                        except OSError as e:
                            errors.append(f"{t.name or t.host}: {e}")
                    rows.append((seq, bool(errors), "; ".join(errors) or None))
                yield pd.DataFrame(rows, columns=["seq", "forward_failed", "error"])
        finally:
            for _, s in sockets:
                s.close()

    return packets.select("seq", F.col(payload).alias("payload")).mapInPandas(send, "seq bigint, forward_failed boolean, error string")


def with_forwarding(outcomes: DataFrame, sent: DataFrame) -> DataFrame:
    """Outcomes in which what any target refused has reason forward_failed; a key stays held all the same."""
    rows = outcomes.join(sent.select("seq", "forward_failed"), "seq", "left")
    bad = F.coalesce("forward_failed", F.lit(False)) & F.col("forwarded")
    return rows.withColumn("reason", F.when(bad, "forward_failed").otherwise(F.col("reason"))).withColumn("forwarded", F.col("forwarded") & ~bad).drop("forward_failed")


def address_family(host: str) -> str:
    """udp4 or udp6, for a literal address."""
    return "udp6" if ipaddress.ip_address(host).version == 6 else "udp4"
