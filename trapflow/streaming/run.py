"""The relay as a running query: packets in, outcomes, alert lines, audit log, datagrams and counters out.

Each micro-batch is written to a folder of its own number and replaces what an earlier attempt left there, so
files hold each batch once; datagrams are sent at least once. Counters are one small row a batch.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trapflow.config import Rules, load_rules
from trapflow.functions.expr import micros
from trapflow.operators.counters import COUNTERS, exposition, outcome_counters
from trapflow.sources.decode import decode_packets, field_map, raw_varbind_map
from trapflow.sources.shared import delete
from trapflow.sources.sinks import EVENT_NAMES, alert_line, fan_out, with_forwarding
from trapflow.streaming.relay import relay_stream

KEEP = ("raw_bytes", "alert", "dropped")


def packet_events(packets: DataFrame, rules: Rules, **options) -> DataFrame:
    """Events of packets (seq, received_at, source_ip, source_port, payload; ``dropped``: packets refused before this
    one, if there is such a column); those that cannot be read have an ``error``."""
    packets = packets if "dropped" in packets.columns else packets.withColumn("dropped", F.lit(0).cast("bigint"))
    read = decode_packets(packets, users=rules.users, **options)
    read = read.withColumn("raw_varbind_map", raw_varbind_map()).withColumn("fields", field_map(read, rules.aliases))
    return read.withColumn("alert", alert_line(micros(F.col("received_at"))))


def write_batch(log: DataFrame, number: int, rules: Rules, folder: str) -> None:
    """Send what is forwarded and write one batch: ``outcomes``, ``alerts``, ``audit`` and ``counters``."""
    spark = log.sparkSession
    # Sending is an effect: the log is fixed first, and what was sent is written before it is read.
    at = lambda kind: f"{folder}/{kind}/batch={number}"
    log.write.mode("overwrite").parquet(at("log"))
    log = spark.read.schema(log.schema).parquet(at("log"))
    if log.isEmpty():  # timers make batches of their own
        delete(spark, at("log"))
        return
    outcomes = log.where("reason is not null")
    if any(t.enabled for t in rules.targets):
        fan_out(outcomes.where("forwarded"), rules.targets).write.mode("overwrite").parquet(at("sent"))
        outcomes = with_forwarding(outcomes, spark.read.parquet(at("sent")))
    names = F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv))
    outcomes = outcomes.withColumn("event", F.coalesce(F.try_element_at(names, F.col("reason")), "event"))
    outcomes.drop(*KEEP).unionByName(log.where("reason is null").drop(*KEEP)).write.mode("overwrite").parquet(at("audit"))
    outcomes.select("seq", "accepted", "forwarded", "reason", "rule_id").write.mode("overwrite").parquet(at("outcomes"))
    outcomes.where("forwarded").select("alert").write.mode("overwrite").text(at("alerts"))
    unread = F.count_if(F.col("reason") == "parse_failed").alias("parse_failed")
    refused = F.coalesce(F.sum("dropped"), F.lit(0))
    counted = outcomes.agg((F.count(F.lit(1)) + refused).alias("received"), refused.alias("queue_dropped"), unread, *outcome_counters())
    counted.select(*COUNTERS).coalesce(1).write.mode("overwrite").parquet(at("counters"))


def totals(spark: SparkSession, folder: str) -> dict[str, int]:
    """Counters of all batches so far; all 0 before the first."""
    schema = ", ".join(f"{c} bigint" for c in COUNTERS)
    try:
        row = spark.read.schema(schema).parquet(f"{folder}/counters").agg(*(F.sum(c).alias(c) for c in COUNTERS)).first().asDict()
    except Exception as e:  # noqa: BLE001 - no batch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = {}
    return {c: int(row.get(c) or 0) for c in COUNTERS}


class Runner:
    """Starts the relay over ``packets()``, a fresh streaming frame, and starts it again with new rules.

    ``reload`` reads the rule file first: if it cannot be used, a ConfigError is raised and the query goes on as
    it was. Otherwise the running batch is ended, and a new query goes on from the same checkpoint: open windows
    keep the ttl and hold they were opened with. Timers make a query run on, so with the trigger ``availableNow``
    (in which no clock runs) ``grace_seconds`` must be None.
    """

    def __init__(self, spark: SparkSession, packets: Callable[[], DataFrame], rules_path: str, folder: str, trigger: dict | None = None, grace_seconds: float | None = 3600) -> None:
        self.spark, self.packets, self.path, self.folder = spark, packets, rules_path, folder
        self.trigger, self.grace = trigger or {"processingTime": "1 second"}, grace_seconds
        if "availableNow" in self.trigger and grace_seconds is not None:
            raise ValueError("a query with timers does not end by itself: give grace_seconds=None")
        self.rules = load_rules(rules_path)
        self.query: StreamingQuery | None = None

    def start(self) -> StreamingQuery:
        rules = self.rules
        log = relay_stream(packet_events(self.packets(), rules), rules, *KEEP, grace_seconds=self.grace)
        writer = log.writeStream.foreachBatch(lambda df, n: write_batch(df, n, rules, self.folder))
        self.query = writer.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**self.trigger).start()
        return self.query

    def reload(self) -> StreamingQuery:
        rules = load_rules(self.path)
        if self.query is not None:
            self.query.stop()
        self.rules = rules
        return self.start()


def serve(counters: Callable[[], dict[str, float]], host: str = "127.0.0.1", port: int = 9163, path: str = "/metrics") -> ThreadingHTTPServer:
    """Answer ``path`` with the counters as exposition text and ``/healthz`` with ok, in a thread; ``shutdown`` ends it."""

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the base class's name
            known = {path: lambda: exposition(counters()), "/healthz": lambda: "ok\n"}.get(self.path.split("?")[0])
            body = known().encode() if known else b"not found\n"
            self.send_response(200 if known else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8" if known and self.path != "/healthz" else "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
