"""The relay as a whole: scenarios, random replays, sinks, counters, the stream."""

import random
import socket

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trapflow.config import Target, parse_rules
from trapflow.operators import suppression, windows_from_first
from trapflow.operators.counters import exposition, interval_stats, queue_drops, snapshot
from trapflow.operators.suppression import alarms_and_duplicates, replay, states
from trapflow.plans.relay import outcomes, verdicts
from trapflow.sources.sinks import alert_line, audit_log, fan_out, with_forwarding
from trapflow.streaming.suppression import suppress_stream

SCHEMA = "seq long, t double, fields map<string,string>, raw_varbind_map map<string,string>"


def frame(spark, rows):
    df = spark.createDataFrame([(i, float(t), f, v) for i, (t, f, v) in enumerate(rows)], SCHEMA)
    return df.select("seq", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("received_at"), "fields", "raw_varbind_map")


def trap(t, oid, index="7", device="A", varbinds=None):
    return (t, {k: v for k, v in {"trap_oid": oid, "ifIndex": index, "device_id": device}.items() if v is not None}, varbinds or {})


def reasons(spark, yaml, rows):
    return [r.reason for r in outcomes(frame(spark, rows), parse_rules(yaml)).orderBy("seq").collect()]


def link(extra="", keys="[fields.ifIndex, fields.device_id]"):
    return f"alarms: [{{id: link_down, match: {{trap_oid: alarm.1}}, dedup: {{ttl_seconds: 60, key_fields: {keys}{extra}}}}}]"


CLEAR = ", clear: {match: {trap_oid: clear.1}}"
A, D, P, X, F_ = "alarm", "duplicate", "pass-through", "dedup_disabled", "filtered"


@pytest.mark.parametrize(
    ("yaml", "rows", "want"),
    [
        (link(CLEAR), [trap(0, "alarm.1"), trap(1, "alarm.1"), trap(2, "clear.1"), trap(3, "alarm.1")], [A, D, P, A]),
        (link(", hold_until_clear: true" + CLEAR, "[trap_oid, ifIndex, device_id]"), [trap(0, "alarm.1"), trap(900, "alarm.1"), trap(901, "clear.1"), trap(902, "alarm.1")], [A, D, P, A]),
        (link(", hold_until_clear: true, clear: {match: {trap_oid: alarm.1}, varbind_oid: .1.3, regex: '(?i)clear'}"), [trap(0, "alarm.1"), trap(1, "alarm.1", varbinds={"1.3": "CLEARED"}), trap(2, "alarm.1")], [A, P, A]),
        ("filters: {rules: [{id: d, match: {trap_oid: drop.1}}]}", [trap(0, "drop.1"), trap(1, "x")], [F_, P]),
        (link(), [trap(0, "alarm.1"), trap(59, "alarm.1"), trap(60, "alarm.1")], [A, D, A]),
        (link(), [trap(0, "alarm.1"), trap(40, "alarm.1"), trap(70, "alarm.1")], [A, D, A]),
        (link(), [trap(0, "alarm.1", device=None)] * 2, [X, X]),
        ("filters: {default_action: drop}", [trap(0, "x")], [F_]),
        (link(), [trap(100, "alarm.1"), trap(0, "alarm.1"), trap(159, "alarm.1"), trap(160, "alarm.1")], [A, D, D, A]),
        (link(", ttl_seconds: -5".replace("ttl_seconds", "x")), [trap(0, "other")], [P]),
        ("filters: {rules: [{id: bad, match: {all: [{field: trap_oid, op: odd}]}}]}", [trap(0, "x")], ["failed"]),
        (link(", clear: {match: {all: [{field: trap_oid, op: odd}]}}"), [trap(0, "alarm.1")], [A]),
        (link(", clear: {match: {trap_oid: clear.1}, varbind_oid: '1', regex: '('}"), [trap(0, "alarm.1"), trap(1, "clear.1"), trap(2, "alarm.1")], [A, P, D]),
        (link(CLEAR), [trap(0, "alarm.1"), trap(1, "clear.1", device=None), trap(2, "alarm.1")], [A, P, D]),
    ],
)
def test_scenarios(spark, yaml, rows, want):
    assert reasons(spark, yaml, rows) == want


def test_a_later_clear_that_fails_overrules_an_earlier_one(spark):
    yaml = """
alarms:
- {id: one, match: {trap_oid: x}, dedup: {key_fields: [device_id], clear: {match: {trap_oid: x}}}}
- {id: two, match: {trap_oid: y}, dedup: {key_fields: [device_id], clear: {match: {trap_oid: x}, varbind_oid: '1', regex: never}}}
"""
    assert reasons(spark, yaml, [trap(0, "x"), trap(1, "x")]) == [A, A]  # cleared, then an alarm, each time


def test_an_error_in_an_alarm_comes_after_its_clears(spark):
    yaml = """
alarms:
- {id: one, match: {trap_oid: x}, dedup: {key_fields: [device_id], clear: {match: {trap_oid: c}, varbind_oid: '1', regex: yes}}}
- {id: two, match: {all: [{field: trap_oid, value: c}, {field: a, op: odd}]}, dedup: {key_fields: [device_id], clear: {match: {trap_oid: c}, varbind_oid: '1', regex: never}}}
"""
    assert reasons(spark, yaml, [trap(0, "x"), trap(1, "c", varbinds={"1": "yes"}), trap(2, "x")]) == [A, "failed", A]


def operations(seed, n=600):
    """Alarms of seven keys, also late ones, with ttl, hold or a negative ttl, and clears."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k, clear = r.choice("abcdefg"), r.random() < 0.05
        rows.append({"rule_id": "r1" if k < "d" else "r2" if k < "f" else "h", "key_hash": k, "seq": i * 7, "rank": 0 if clear else 1, "us": 0 if clear else int((i * 3 + r.choice([0, 0, 0, -40, -90, 5])) * 1e6), "ttl_seconds": 60 if k < "d" else 25 if k < "e" else -30 if k < "f" else 0, "hold": k == "f"})
    return pd.DataFrame(rows)


@pytest.mark.parametrize("largest", [1_000_000, 5])
def test_random_streams_agree_with_a_replay(spark, monkeypatch, largest):
    monkeypatch.setattr(suppression, "KEY_ROWS", largest)
    monkeypatch.setattr(suppression, "CHUNK", 500)
    monkeypatch.setattr(windows_from_first, "SMALL", largest)
    ops = operations(largest)
    df = spark.createDataFrame(ops)
    marked = alarms_and_duplicates(df.where("rank = 1").drop("rank"), df.where("rank = 0").select("rule_id", "key_hash", "seq"))
    assert {r.seq: r.reason for r in marked.collect()} == dict(replay(ops))


def test_states_and_capacity(spark):
    ops = pd.DataFrame([("r", "k", s, 1, u * 1_000_000, 60, False) for s, u in enumerate((0, 10, 5, 60, 61))], columns=["rule_id", "key_hash", "seq", "rank", "us", "ttl_seconds", "hold"])
    df = spark.createDataFrame(ops)
    got = sorted((r.first_seq, r.first_us, r.last_us, r.suppressed_count) for r in states(alarms_and_duplicates(df.drop("rank"), df.where("false").select("rule_id", "key_hash", "seq"))).collect())
    assert got == [(0, 0, 5_000_000, 2), (3, 60_000_000, 61_000_000, 1)]
    three = pd.DataFrame([("r", k, s, 1, s, 60, False) for s, k in enumerate("aba")], columns=ops.columns)
    assert [x for _, x in replay(three, 1)] == [A, A, A] and [x for _, x in replay(three, 2)] == [A, A, D]


def test_empty_and_null_rows(spark):
    rules = parse_rules(link(CLEAR))
    assert outcomes(frame(spark, []), rules).count() == 0
    df = spark.createDataFrame([(1, None, None, None, "x"), (2, None, {"trap_oid": "alarm.1", "ifIndex": "1", "device_id": "d"}, None, "x")], "seq long, received_at timestamp, fields map<string,string>, raw_varbind_map map<string,string>, reason string")
    assert {r.seq: r.reason for r in outcomes(df, rules).collect()} == {1: P, 2: X}
    assert verdicts(df, parse_rules("")).count() == 2


def test_alert_lines(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", 162, "1.3", [("1.2", "t", 'v"')], 1_500_000), (2, "h", 1, "", None, 0)], "seq long, source_ip string, source_port int, trap_oid string, varbinds array<struct<oid:string,type_name:string,value:string>>, us long")
    lines = [r.line for r in df.select("seq", alert_line(F.col("us")).alias("line")).orderBy("seq").collect()]
    assert lines == ['1970-01-01T00:00:01.5Z 10.0.0.1:162 -> TRAP 1.3 [ 1.2 = "v"" ]', "1970-01-01T00:00:00Z h:1 -> TRAP - "]


def test_audit_log(spark):
    rules = parse_rules(link(", hold_until_clear: true" + CLEAR))
    r = audit_log(outcomes(frame(spark, [trap(0, "alarm.1")]), rules), rules).first()
    assert (r.event, r.ttl, r.ttl_seconds, r.hold_until_clear) == ("trap_forwarded", "none", None, True)


def test_fan_out(spark):
    receiver = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    receiver.bind(("127.0.0.1", 0))
    receiver.settimeout(10)
    targets = [Target("a", "127.0.0.1", receiver.getsockname()[1], True), Target("off", "127.0.0.1", 9, False)]
    df = spark.createDataFrame([(1, bytearray(b"one"))], "seq long, raw_bytes binary")
    sent = fan_out(df, targets).collect()
    assert receiver.recv(100) == b"one" and [tuple(r) for r in sent] == [(1, False, None)]
    receiver.close()
    out = spark.createDataFrame([(1, True, True, "alarm", "r"), (2, False, False, "duplicate", "r")], "seq long, accepted boolean, forwarded boolean, reason string, rule_id string")
    failed = spark.createDataFrame([(1, True), (2, True)], "seq long, forward_failed boolean")
    assert {r.seq: (r.reason, r.forwarded) for r in with_forwarding(out, failed).collect()} == {1: ("forward_failed", False), 2: ("duplicate", False)}


def test_counters(spark):
    rules = parse_rules(link(CLEAR))
    rows = frame(spark, [trap(t, o) for t, o in ((0, "alarm.1"), (1, "alarm.1"), (2, "clear.1"), (70, "x"), (71, "alarm.1"))])
    out = outcomes(rows, rules)
    row = snapshot(out, parse_failed=2).first().asDict()
    assert (row["received"], row["accepted"], row["alarms"], row["duplicates"], row["pass_through"]) == (7, 4, 2, 1, 2)
    assert row["received"] == sum(row[k] for k in ("queue_dropped", "parse_failed", "handle_failed", "filtered", "duplicates", "accepted"))
    text = exposition(row)
    assert "trapflow_alarms_total 2\n" in text and text.count("# TYPE") == len(row)
    stats = interval_stats(out.join(rows.select("seq", "received_at"), "seq"), "received_at", 60).orderBy("at").collect()
    assert [r.received for r in stats] == [3, 5]


def test_queue_drops(spark):
    df = frame(spark, [trap(t / 10, "x") for t in (0, 1, 2, 11)])
    assert [r.dropped for r in queue_drops(df, "received_at", "seq", 2).orderBy("seq").collect()] == [False, False, True, False]


def test_stream_agrees_with_batch(spark, tmp_path):
    rules = parse_rules("""
alarms:
- {id: down, match: {trap_oid: a}, dedup: {ttl_seconds: 60, key_fields: [dev], clear: {match: {trap_oid: c}}}}
- {id: held, match: {trap_oid: h}, dedup: {key_fields: [dev, trap_oid], hold_until_clear: true, clear: {match: {trap_oid: c}}}}
""")
    r = random.Random(3)
    df = frame(spark, [(i * 3 + r.choice([0, 0, -20]), {"trap_oid": r.choice("aaahhc"), "dev": r.choice("xyz")}, {}) for i in range(120)])
    for k in range(3):
        df.where(f"seq >= {k * 40} and seq < {k * 40 + 40}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = suppress_stream(stream, rules).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(300)
    got = {r.seq: r.reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.seq: r.reason for r in outcomes(df, rules).where("reason in ('alarm', 'duplicate')").collect()}


def test_udp_source(spark):
    from trapflow.sources.udp import UdpReader

    reader = UdpReader({"queue_size": "2"})
    rows, at = reader.read({"seq": 5})
    assert list(rows) == [] and at == {"seq": 5}
    sender = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    got = []
    for n in range(2):
        sender.sendto(b"p%d" % n, reader.socket.getsockname())
    for _ in range(200):
        rows, end = reader.read(at)
        got += list(rows)
        at = end
        if len(got) == 2:
            break
        __import__("time").sleep(0.02)
    assert [(r[0], r[4]) for r in got] == [(5, b"p0"), (6, b"p1")]
    for n in range(5):  # the buffer holds two
        sender.sendto(b"q%d" % n, reader.socket.getsockname())
    for _ in range(200):
        if reader.dropped == 3:
            break
        __import__("time").sleep(0.02)
    rows, at = reader.read(at)
    assert len(list(rows)) == 2
    sender.sendto(b"last", reader.socket.getsockname())
    for _ in range(200):
        rows, at = reader.read(at)
        if last := list(rows):
            break
        __import__("time").sleep(0.02)
    assert sum(r[5] for r in got) == 0 and reader.told == 3 and last[0][4] == b"last"
    reader.socket.close()
    sender.close()
