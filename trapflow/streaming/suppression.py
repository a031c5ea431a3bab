"""Only alarms and duplicates of a stream: what the relay says of events with a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapflow.config import Rules
from trapflow.streaming.relay import relay_stream

#: Setting of the state store that the stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def suppress_stream(events: DataFrame, rules: Rules, grace_seconds: float | None = None) -> DataFrame:
    """alarm or duplicate for each event with a key (append mode), with the start of its window and how many
    it has held back so far. ``grace_seconds``: see ``relay_stream``; None: states are dropped by clears only."""
    log = relay_stream(events, rules, grace_seconds=grace_seconds).where(F.col("reason").isin("alarm", "duplicate"))
    return log.select("rule_id", "key_hash", "seq", "us", "reason", "first_us", "suppressed")
