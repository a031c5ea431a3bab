"""Counters of outcomes: totals, per interval, as snapshots and as exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Counters and gauges of a snapshot, with their help texts.
COUNTERS = {
    "received": "Packets read.", "queue_dropped": "Packets dropped as the queue was full.", "parse_failed": "Packets that could not be read.", "handle_failed": "Events whose handling failed.",
    "accepted": "Events accepted.", "forwarded": "Events forwarded.", "filtered": "Events dropped by a filter.", "duplicates": "Repeated alarms held back.", "pass_through": "Events forwarded without an alarm rule.",
    "alarms": "Alarms forwarded.", "dedup_disabled": "Events forwarded without a key.", "forward_failed": "Events that a target refused.",
}
GAUGES = {"queue_depth": "Packets waiting.", "queue_capacity": "Room of the queue.", "worker_count": "Workers."}
_REASONS = {"filtered": "filtered", "duplicates": "duplicate", "pass_through": "pass-through", "alarms": "alarm", "dedup_disabled": "dedup_disabled", "forward_failed": "forward_failed", "handle_failed": "failed"}


#: Intervals that are sorted in one task.
INTERVALS = 10_000


def outcome_counters() -> list[Column]:
    """Aggregates over outcomes: accepted, forwarded, and one for each reason."""
    reasons = [F.count_if(F.col("reason") == r).alias(n) for n, r in _REASONS.items()]
    return [F.count_if("accepted").alias("accepted"), F.count_if("forwarded").alias("forwarded"), *reasons]


def ingest_counters(packets: DataFrame, decoded: DataFrame, outcomes: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row of all counters, counted from the rows themselves.

    ``packets``: a row for each packet that came in, ``dropped`` a boolean column of those the queue refused
    (default: none); ``decoded``: a row for each packet that was read, with ``error``; ``outcomes``: a row for
    each event. Failed sends are counted whatever else the event's reason was. Each table is aggregated by
    itself to one row.
    """
    refused = F.count_if(F.col(dropped)) if dropped else F.lit(0).cast("bigint")
    came = packets.agg(F.count(F.lit(1)).alias("received"), refused.alias("queue_dropped"))
    read = decoded.agg(F.count_if(F.col("error").isNotNull()).alias("parse_failed"))
    one = F.lit(1).alias("_one")
    rows = [t.select("*", one) for t in (came, read, outcomes.agg(*outcome_counters()))]
    return rows[0].join(rows[1], "_one").join(rows[2], "_one").select(*COUNTERS)


def snapshot(outcomes: DataFrame, received: int | None = None, parse_failed: int = 0, queue_dropped: int = 0) -> DataFrame:
    """One row of all counters. ``received`` defaults to what was handled, failed and dropped."""
    total = F.count(F.lit(1)) + F.lit(parse_failed + queue_dropped) if received is None else F.lit(received)
    row = outcomes.agg(total.cast("bigint").alias("received"), *outcome_counters())
    return row.withColumns({"parse_failed": F.lit(parse_failed).cast("bigint"), "queue_dropped": F.lit(queue_dropped).cast("bigint")}).select(*COUNTERS)


def interval_stats(outcomes: DataFrame, time: str, seconds: int = 60) -> DataFrame:
    """Counters at the end of each interval that has events, as they stand by then (running totals).

    The line of intervals is cut into stretches of INTERVALS: a task sorts one stretch, and what stands
    before a stretch is summed over the stretches. Rows without a time are left out.
    """
    counts = outcomes.where(F.col(time).isNotNull()).groupBy(F.window(F.col(time).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("received"), *outcome_counters())
    names = ["received", "accepted", "forwarded", *_REASONS]
    rows = counts.select(F.col("w.end").alias("at"), F.floor(F.unix_timestamp("w.end") / F.lit(seconds * INTERVALS)).alias("_part"), *names)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    stretches = rows.groupBy("_part").agg(*(F.sum(n).alias(n) for n in names)).select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names))
    inside = Window.partitionBy("_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("at", "_part", *(F.sum(n).over(inside).alias(n) for n in names)).join(stretches, "_part")
    return rows.select("at", *((F.col(n) + F.col(f"_{n}")).alias(n) for n in names))


def step_deltas(snapshots: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Counters between each snapshot and the one before, and ``loss_free``: nothing dropped between, and as
    much received as sent (``sent``, a column of ``columns``, if there is one).

    The line of snapshots is cut into days: a task sorts one day, and each day's first snapshot is
    held against the last one of the day before it that has any. Null times are left out.
    """
    rows = snapshots.where(F.col(time).isNotNull()).select(time, *columns, F.to_date(time).alias("_day"))
    lasts = rows.groupBy("_day").agg(F.max_by(F.struct(*columns), time).alias("_last"))
    lasts = lasts.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_last"))  # a row a day
    w = Window.partitionBy("_day").orderBy(time)
    rows = rows.withColumn("_before", F.lag(F.struct(*columns)).over(w)).join(lasts, "_day")
    before = F.coalesce("_before", "_last")
    out = rows.select(time, *((F.col(c) - before[c]).alias(c) for c in columns)).where(F.col(columns[0]).isNotNull())
    loss_free = F.col("queue_dropped") == 0
    return out.withColumn("loss_free", loss_free & (F.col("received") >= F.col("sent")) if "sent" in columns else loss_free)


def load_ramp(packets: DataFrame, time: str, tick_s: int = 1, capacity: int | None = None, order: str = "seq") -> DataFrame:
    """Ticks by the rate at which packets came, slowest first: (rate, ticks, packets, dropped, loss_free).

    ``capacity``: packets that a tick can take (default: all). Packets without a time are left out.
    """
    tick = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(tick_s * 1_000_000))
    ticks = packets.where(F.col(time).isNotNull()).groupBy(tick.alias("_tick")).agg(F.count(F.lit(1)).alias("rate"))
    lost = F.greatest(F.col("rate") - F.lit(capacity), F.lit(0)) if capacity is not None else F.lit(0)
    by = ticks.withColumn("lost", lost).groupBy("rate").agg(F.count(F.lit(1)).alias("ticks"), F.sum("rate").alias("packets"), F.sum("lost").cast("bigint").alias("dropped"))
    return by.withColumn("loss_free", F.col("dropped") == 0).orderBy("rate")


def exposition(row: dict[str, float], prefix: str = "trapflow") -> str:
    """Text format of the counters and gauges of one snapshot."""
    lines = []
    for kind, names, suffix in (("counter", COUNTERS, "_total"), ("gauge", GAUGES, "")):
        for n, help_text in names.items():
            if row.get(n) is not None:
                name = f"{prefix}_{n}{suffix}"
                lines += [f"# HELP {name} {help_text}", f"# TYPE {name} {kind}", f"{name} {row[n]:g}" if isinstance(row[n], float) else f"{name} {row[n]}"]
    return "\n".join(lines) + "\n"


def queue_drops(packets: DataFrame, time: str, order: str, capacity: int, tick_s: int = 1) -> DataFrame:
    """Which packets a bounded queue would refuse if it were emptied once a tick: (order, dropped).

    In each tick the first ``capacity`` packets by ``order`` are taken, later ones are dropped. A tick
    is cut by its own rows only. A packet without a time is a tick of its own.
    """
    tick = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(tick_s * 1_000_000))
    rn = F.row_number().over(Window.partitionBy("_tick", F.when(F.col("_tick").isNull(), F.col(order))).orderBy(order))
    return packets.select(order, tick.alias("_tick")).withColumn("dropped", rn > capacity).drop("_tick")
