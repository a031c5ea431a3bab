"""The whole relay as a stream, held against the batch plan and a replay."""

import datetime as dt
import random
import socket
import time
import urllib.error
import urllib.request

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_relay import CLEAR, F_, A, D, P, X, frame, link, trap
from trapflow.config import ConfigError, parse_rules
from trapflow.functions import ber
from trapflow.operators.suppression import replay
from trapflow.plans.relay import outcomes
from trapflow.streaming.run import Runner, serve, totals
from trapflow.streaming.relay import ALARM, CLEAR as CLEAR_RANK, fold, next_at, relay_stream

SCENARIOS = f"""
filters: {{rules: [{{id: dropped, match: {{trap_oid: drop.1}}}}, {{id: bad, match: {{all: [{{field: trap_oid, value: bad.1}}, {{field: trap_oid, op: odd}}]}}}}]}}
alarms:
- {{id: link_down, match: {{trap_oid: alarm.1}}, dedup: {{ttl_seconds: 60, key_fields: [fields.ifIndex, fields.device_id]{CLEAR}}}}}
- {{id: held, match: {{trap_oid: hold.1}}, dedup: {{hold_until_clear: true, key_fields: [trap_oid, ifIndex, device_id], clear: {{match: {{trap_oid: hold.2}}}}}}}}
- {{id: worded, match: {{trap_oid: word.1}}, dedup: {{hold_until_clear: true, key_fields: [device_id], clear: {{match: {{trap_oid: word.1}}, varbind_oid: .1.3, regex: '(?i)clear'}}}}}}
- {{id: short, match: {{trap_oid: short.1}}, dedup: {{ttl_seconds: 1, key_fields: [device_id], clear: {{match: {{all: [{{field: trap_oid, value: hold.2}}, {{field: trap_oid, op: odd}}]}}}}}}}}
"""
ROWS = [
    trap(0, "alarm.1"), trap(1, "alarm.1"), trap(2, "clear.1"), trap(3, "alarm.1"),  # S1
    trap(0, "hold.1"), trap(900, "hold.1"), trap(901, "hold.2"), trap(902, "hold.1"),  # S2
    trap(0, "word.1"), trap(1, "word.1", varbinds={"1.3": "CLEARED"}), trap(2, "word.1"),  # S3
    trap(0, "drop.1"), trap(0, "bad.1"),  # S4, an error
    trap(1, "alarm.1", "7", "B"), trap(2, "alarm.1", "8", "B"), trap(3, "alarm.1", "7", "B"),  # S5 without a bound
    trap(100, "short.1"), trap(100.5, "short.1"), trap(101, "short.1"),  # S7
    trap(200, "alarm.1", "9"), trap(240, "alarm.1", "9"), trap(270, "alarm.1", "9"),  # S8
    trap(0, "alarm.1", device=None), trap(0, "alarm.1", device=None), trap(5, "clear.1", device=None),  # S9, a clear without a key
]
WANT = [A, D, P, A, A, D, P, A, A, P, A, F_, "failed", A, A, D, A, D, A, A, D, A, X, X, P]


def events(spark, rows):
    return frame(spark, rows).select("*", F.lit("10.0.0.1").alias("source_ip"), F.lit(162).alias("source_port"), F.col("fields")["trap_oid"].alias("trap_oid"), F.encode(F.col("seq").cast("string"), "utf-8").alias("raw_bytes"))


def run(spark, df, rules, path, parts=3):
    n = df.count()
    for k in range(parts):
        df.where(f"seq >= {k * n // parts} and seq < {(k + 1) * n // parts}").coalesce(1).write.parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    query = relay_stream(stream, rules, "raw_bytes", grace_seconds=None).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.read.parquet(f"{path}/out")


def test_scenarios_through_stream_and_batch(spark, tmp_path):
    rules, df = parse_rules(SCENARIOS), events(spark, ROWS)
    batch = {r.seq: (r.reason, r.rule_id, r.forwarded) for r in outcomes(df, rules).collect()}
    assert [batch[k][0] for k in range(len(ROWS))] == WANT
    log = run(spark, df, rules, tmp_path).collect()
    assert {r.seq: (r.reason, r.rule_id, r.forwarded) for r in log if r.reason} == batch
    assert sum(bool(r.reason) for r in log) == len(ROWS) and all((r.raw_bytes is None) != bool(r.reason) for r in log)
    cleared = {(r.seq, r.rule_id): (r.active, r.suppressed, r.first_us) for r in log if r.event == "trap_cleared"}
    assert cleared == {(2, "link_down"): (True, 1, 0), (6, "held"): (True, 1, 0), (9, "worded"): (True, 0, 0)}
    notes = {(r.seq, r.event, r.rule_id, r.missing) for r in log if not r.reason and r.event != "trap_cleared"}
    assert notes == {(6, "clear_match_error", "short", None), (24, "trap_clear_skipped", "link_down", "fields.device_id")}
    duplicate = next(r for r in log if r.seq == 1)
    assert (duplicate.first_us, duplicate.first_ip, duplicate.first_port, duplicate.first_oid, duplicate.suppressed, duplicate.ttl_seconds) == (0, "10.0.0.1", 162, "alarm.1", 1, 60)
    assert {r.event for r in log if r.reason} == {"trap_forwarded", "trap_deduplicated", "trap_passed", "trap_filtered", "trap_handle_failed", "trap_forwarded_dedup_disabled"}


def random_operations(seed, n=400):
    r = random.Random(seed)
    rows = [{"rule_id": "r", "key_hash": "k", "seq": i, "rank": CLEAR_RANK if r.random() < 0.05 else ALARM, "us": int((i * 3 + r.choice([0, 0, -40, 5])) * 1e6), "ttl_seconds": -30 if seed == 3 else 60, "hold": seed % 2 == 0} for i in range(n)]
    return pd.DataFrame(rows)


@pytest.mark.parametrize("seed", range(4))
def test_folding_in_parts_agrees_with_a_replay(seed):
    ops, held, got = random_operations(seed), None, []
    for part in np.array_split(np.arange(len(ops)), 7):
        rows = ops.iloc[part].assign(source_ip="h", source_port=1, trap_oid="t").reset_index(drop=True)
        out, held = fold(rows, held)
        got += [(int(rows["seq"][i]), "alarm" if opens else "duplicate") for i, opens, *_ in out if rows["rank"][i] == ALARM]
    assert got == replay(ops)


def test_next_at():
    us = np.array([1, 5, 2, 9] * 100 + [50])
    assert [next_at(us, s, 401, b) for s, b in ((0, 5), (2, 5), (0, 50), (0, 51), (400, 1))] == [1, 3, 400, 401, 400]


def test_states_that_are_over_are_dropped_by_their_timers(spark, tmp_path):
    rules = parse_rules(link(", ttl_seconds: 1".replace("ttl_seconds", "x")).replace("ttl_seconds: 60", "ttl_seconds: 1"))
    df = events(spark, [trap(k, "alarm.1", str(k)) for k in range(5)])
    df.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
    log = relay_stream(stream, rules, grace_seconds=0).writeStream.format("memory").queryName("swept").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while spark.sql("select * from swept where event = 'dedup_cleanup'").count() < 5 and time.monotonic() < end:
            time.sleep(0.5)
        rows = spark.sql("select * from swept").collect()
        assert sorted(r.event for r in rows) == ["dedup_cleanup"] * 5 + ["trap_forwarded"] * 5
        assert all(r.first_oid == "alarm.1" and r.active is False for r in rows if r.event == "dedup_cleanup")
    finally:
        log.stop()
    held = spark.read.format("statestore").option("stateVarName", "window").load(f"{tmp_path}/check")
    assert held.count() == 0


RULES_1 = """
alarms: [{id: down, match: {trap_oid: 1.3.6.1.6.3.1.1.5.3}, dedup: {ttl_seconds: 600, key_fields: [source_ip], clear: {match: {trap_oid: 1.3.6.1.6.3.1.1.5.4}}}}]
forwarders: [{name: a, host: 127.0.0.1, port: %d, enabled: true}, {name: off, host: 127.0.0.1, port: 9}]
"""


def test_a_running_relay_reloads_and_counts(spark, tmp_path):
    receiver = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    receiver.bind(("127.0.0.1", 0))
    receiver.settimeout(10)
    (tmp_path / "rules.yaml").write_text(RULES_1 % receiver.getsockname()[1])
    down, up = (ber.v2_trap(f"1.3.6.1.6.3.1.1.5.{k}", []) for k in (3, 4))
    schema = "seq long, received_at timestamp, source_ip string, source_port int, payload binary, dropped long"

    def land(k, payloads):
        rows = [(k * 10 + i, dt.datetime(2024, 1, 1, 0, k, i), "10.0.0.1", 162, bytearray(p), 4 if i == 1 else 0) for i, p in enumerate(payloads)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    land(0, [down, down, b"junk"])
    runner = Runner(spark, lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/rules.yaml", f"{tmp_path}/out", {"availableNow": True}, None)
    assert totals(spark, f"{tmp_path}/out")["received"] == 0
    assert runner.start().awaitTermination(120)
    assert receiver.recv(500) == down
    (tmp_path / "rules.yaml").write_text("alarms: [{id: down}]")
    with pytest.raises(ConfigError):
        runner.reload()
    (tmp_path / "rules.yaml").write_text(RULES_1.replace("ttl_seconds: 600", "ttl_seconds: 1") % receiver.getsockname()[1])
    land(1, [down, up, down])  # the window that is open keeps its 600 seconds until it is cleared
    assert runner.reload().awaitTermination(120)
    got = totals(spark, f"{tmp_path}/out")
    assert {k: v for k, v in got.items() if v} == {"received": 14, "queue_dropped": 8, "parse_failed": 1, "accepted": 3, "forwarded": 3, "duplicates": 2, "pass_through": 1, "alarms": 2}
    log = {(r.seq, r.event) for r in spark.read.parquet(f"{tmp_path}/out/audit").collect()}
    assert log == {(0, "trap_forwarded"), (1, "trap_deduplicated"), (2, "trap_parse_failed"), (10, "trap_deduplicated"), (11, "trap_cleared"), (11, "trap_passed"), (12, "trap_forwarded")}
    lines = {r.value for r in spark.read.text(f"{tmp_path}/out/alerts").collect()}
    assert len(lines) == 3 and "2024-01-01T00:00:00Z 10.0.0.1:162 -> TRAP 1.3.6.1.6.3.1.1.5.3 [ " in min(lines)
    server = serve(lambda: totals(spark, f"{tmp_path}/out"), port=0)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert "trapflow_alarms_total 2\n" in urllib.request.urlopen(f"{at}/metrics").read().decode()
    assert urllib.request.urlopen(f"{at}/healthz").read() == b"ok\n"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/other")
    server.shutdown()
    receiver.close()
