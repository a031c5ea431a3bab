"""Repeated alarms held back: a window from the first alarm of a key, ended by its length or a clear.

A key's first alarm opens a window; alarms before ``first + ttl`` are duplicates, however late they
arrive; one at or after it opens the next window. Held keys stay open until a clear. A clear closes
the window; of one event's clear and alarm, the clear comes first. Order is arrival (``seq``), which
need not be that of time.

In arrival order every opening alarm is later than all alarms before it since the last clear, so only
those rows (running maxima) can open a window and they rise in both orders. One that is a ttl or more
after the maximum before it opens a window for certain; only where such stretches are as long as the
ttl must windows be followed one by one (``windows_from_first``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapflow.operators.prefix import running
from trapflow.operators.skew import hot_split_join
from trapflow.operators.windows_from_first import assign_windows
from trapflow.sources.shared import materialize

KEYS = ["rule_id", "key_hash"]
#: With no more operations than this in all, no key can have more, and each is sorted in one task. Otherwise
#: the sequences of all keys are cut into chunks of arrivals.
KEY_ROWS = 1_000_000
#: Arrivals in one such chunk.
CHUNK = 1_000_000


def operations(alarms: DataFrame, clears: DataFrame) -> DataFrame:
    """Alarms (rank 1) and clears (rank 0) in one table; rows with a null among key, seq and us are left out."""
    ops = alarms.withColumn("rank", F.lit(1)).unionByName(clears.select(*KEYS, "seq", F.lit(0).alias("rank")).distinct(), allowMissingColumns=True)
    return ops.where("rule_id is not null and key_hash is not null and seq is not null and (rank = 0 or us is not null)")


def _sequence(ops: DataFrame, chunked: bool) -> DataFrame:
    """Alarms with ``epoch`` (clears before), ``latest`` (largest time before in the epoch) and ``stretch``
    (number of the run of maxima that are less than a ttl apart)."""
    opens = lambda: (F.col("latest").isNull() | (F.col("us") - F.col("latest") >= F.col("ttl_us"))).cast("int")
    if not chunked:
        line = Window.partitionBy(*KEYS).orderBy("seq", "rank", "us")
        rows = ops.withColumn("epoch", F.sum(1 - F.col("rank")).over(line)).where("rank = 1")
        inside = Window.partitionBy(*KEYS, "epoch").orderBy("seq", "us")
        rows = rows.withColumn("latest", F.max("us").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        return rows.withColumn("stretch", F.sum(opens()).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chunk = F.floor(F.col("seq") / F.lit(CHUNK))
    rows = materialize(running(ops, KEYS, ["seq", "rank", "us"], chunk, "epoch", 1 - F.col("rank"), "sum", True), "epochs").where("rank = 1")
    rows = materialize(running(rows, [*KEYS, "epoch"], ["seq", "us"], chunk, "latest", F.col("us"), "max", False), "latest")
    return materialize(running(rows, [*KEYS, "epoch"], ["seq", "us"], chunk, "stretch", opens(), "sum", True), "stretches")


def _spans(rows: DataFrame, chunked: bool) -> DataFrame:
    """Add ``from_us`` and ``until_us``, first and last maximum of the row's stretch, and their number ``risen``."""
    rising = F.when(F.col("latest").isNull() | (F.col("us") > F.col("latest")), F.col("us"))
    if not chunked:
        whole = Window.partitionBy(*KEYS, "epoch", "stretch")
        return rows.select("*", F.min(rising).over(whole).alias("from_us"), F.max(rising).over(whole).alias("until_us"), F.count(rising).over(whole).alias("risen"))
    spans = rows.groupBy(*KEYS, "epoch", "stretch").agg(F.min(rising).alias("from_us"), F.max(rising).alias("until_us"), F.count(rising).alias("risen"), F.count(F.lit(1)).alias("_n"))
    return hot_split_join(rows, spans, [*KEYS, "epoch", "stretch"], "_n", ["from_us", "until_us", "risen"], "seq")


def alarms_and_duplicates(alarms: DataFrame, clears: DataFrame) -> DataFrame:
    """Add ``reason`` (alarm or duplicate) to ``alarms``.

    ``alarms``: rule_id, key_hash, seq, us, ttl_seconds, hold and any other columns; ``clears``:
    rule_id, key_hash, seq. Both are read more than once: give what is cheap to read. With a negative
    ttl every alarm opens a window, also one that is late by more than that. Rows with a null among key, seq and us are left out; several rows
    of one seq and key are ordered by us. An empty table gives an empty result.
    """
    ops = operations(alarms, clears).withColumn("ttl_us", F.col("ttl_seconds").cast("bigint") * 1_000_000)
    chunked = ops.count() > KEY_ROWS
    # Written once: the few chains that need more steps are split off below.
    rows = materialize(_spans(_sequence(ops, chunked), chunked), "spans")
    first = F.col("latest").isNull()
    rises = first | (F.col("us") > F.col("latest"))
    chained = ~F.col("hold") & (F.col("ttl_seconds") >= 1) & (F.col("until_us") - F.col("from_us") >= F.col("ttl_us"))
    simple = F.when(F.col("hold"), first).when(F.col("ttl_seconds") < 0, True).when(F.col("ttl_seconds") == 0, first | (F.col("us") >= F.col("latest"))).otherwise(rises & (F.col("us") == F.col("from_us")))
    columns = [c for c in alarms.columns]
    # At first + ttl the window is over: of whole microseconds, it is one shorter.
    followed = assign_windows(rows.where(chained & rises).select(*columns, "epoch", "stretch", "ttl_us", "risen"), [*KEYS, "epoch", "stretch"], "us", F.col("ttl_us") - 1, F.col("risen"))
    decided = rows.where(~(chained & rises)).select(*columns, (~chained & simple).alias("opens"))
    both = decided.unionByName(followed.select(*columns, (F.col("us") == F.col("anchor")).alias("opens")))
    return both.select(*columns, F.when(F.col("opens"), "alarm").otherwise("duplicate").alias("reason"))


def numbered(marked: DataFrame) -> DataFrame:
    """Add ``window``, the number of the key's window, from 1."""
    opens: Column = (F.col("reason") == "alarm").cast("int")
    return running(marked, KEYS, ["seq", "us"], F.floor(F.col("seq") / F.lit(CHUNK)), "window", opens, "sum", True)


def states(marked: DataFrame) -> DataFrame:
    """One row for each window: first and last time, first event and number of suppressed alarms.

    ``last_us`` is the time of the last arrival, not the largest time.
    """
    return numbered(marked).groupBy(*KEYS, "window").agg(
        F.min(F.when(F.col("reason") == "alarm", F.col("seq"))).alias("first_seq"), F.min(F.when(F.col("reason") == "alarm", F.col("us"))).alias("first_us"), F.max_by("us", "seq").alias("last_us"),
        F.first("ttl_seconds").alias("ttl_seconds"), F.first("hold").alias("hold"), F.sum((F.col("reason") == "duplicate").cast("bigint")).alias("suppressed_count"),
    )


def swept(states: DataFrame, now: Column, first: str = "first_seen_at", ttl: str = "ttl_seconds", hold: str = "hold_until_clear") -> DataFrame:
    """The states that a sweep at ``now`` drops: those not held whose first time and ttl are over (at the very
    end as well). A null time or ttl is never over; a null hold is none."""
    over = F.col(first) + F.make_interval(secs=F.col(ttl)) <= now
    return states.where(~F.coalesce(F.col(hold), F.lit(False)) & over)


def cleared(marked: DataFrame, clears: DataFrame) -> DataFrame:
    """(rule_id, key_hash, seq, active, first_seq, first_us, suppressed_count) of each clear (rule_id, key_hash, seq, us).

    A clear is active if the last thing before it, of its key, was a window that is held or not over by the
    clear's time. Only windows and clears are put in order, not alarms. A clear without a time finds any window.
    """
    windows = states(marked).select(*KEYS, F.col("first_seq").alias("seq"), F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("us"), F.struct("first_seq", "first_us", "suppressed_count", "ttl_seconds", "hold").alias("w"))
    ops = windows.unionByName(clears.select(*KEYS, "seq", F.lit(0).alias("rank"), "us").distinct(), allowMissingColumns=True)
    rows = ops.withColumn("before", F.lag("w").over(Window.partitionBy(*KEYS).orderBy("seq", "rank"))).where("rank = 0")
    b = F.col("before")
    live = F.col("before").isNotNull() & (b.hold | F.col("us").isNull() | (b.ttl_seconds >= 0) & (F.col("us") < b.first_us + b.ttl_seconds.cast("bigint") * 1_000_000))
    return rows.select(*KEYS, "seq", F.coalesce(live, F.lit(False)).alias("active"), *(F.when(live, b[c]).alias(c) for c in ("first_seq", "first_us", "suppressed_count")))


def replay(ops: pd.DataFrame, capacity: int = 0) -> list[tuple[int, str]]:
    """Sequential replay of one stream with a bound on the states held (0: none): (seq, reason) of alarms.

    ``ops``: rule_id, key_hash, seq, rank, us, ttl_seconds, hold. Above the bound, the state with the
    oldest last arrival time goes, ties by first time, rule and key. The bound spans all keys, so this
    is one sequence by nature: it is for exact small replays, and is the oracle of the tests.
    """
    held: dict[tuple[str, str], list] = {}
    out = []
    for o in ops.sort_values(["seq", "rank", "us"]).itertuples():
        key = (o.rule_id, o.key_hash)
        if o.rank == 0:
            held.pop(key, None)
            continue
        state = held.get(key)
        if state and not state[2] and (state[3] < 0 or state[0] + state[3] * 1_000_000 <= o.us):
            del held[key]
            state = None
        if state:
            state[1] = o.us
            out.append((o.seq, "duplicate"))
            continue
        if capacity > 0 and len(held) >= capacity:
            del held[min(held, key=lambda k: (held[k][1], held[k][0], k))]
        held[key] = [o.us, o.us, bool(o.hold), o.ttl_seconds]
        out.append((o.seq, "alarm"))
    return out
