"""The whole relay as a stream: every event's outcome, and what happens to the keyed states.

Events are decided row by row as in batch. Those with a key, and clears, go to the state of their rule
and key; all others pass by in buckets without a state, so the source is read once. A state holds what the
first event was, the ttl and hold it was opened with, and how many were held back since; a timer drops a
state that is over, so states don't grow without end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle

from trapflow.config import Rules
from trapflow.plans.relay import held_for, plain_reason, verdicts
from trapflow.sources.sinks import EVENT_NAMES

#: first_us .. first_oid: the event that opened the window; last_us: time of the last arrival.
STATE = "first_us bigint, first_ip string, first_port int, first_oid string, last_us bigint, ttl_seconds int, hold boolean, suppressed bigint"
#: One row for each outcome, each key that a clear names and each state that a timer drops.
LOG = (
    "seq bigint, us bigint, event string, accepted boolean, forwarded boolean, reason string, rule_id string, key_hash string, key_repr string, missing string, "
    "ttl_seconds int, hold boolean, active boolean, first_us bigint, first_ip string, first_port int, first_oid string, suppressed bigint"
)
_LOG = [c.split()[0] for c in LOG.split(", ")]
PLAIN, ALARM, CLEAR, NOTE = 2, 1, 0, 3
# Names of the audit log for what happens to a state.
CLEARED, SWEPT = "trap_cleared", "dedup_cleanup"
#: Rows without a key are spread over so many groups.
BUCKETS = 256


class _Held:
    """The open window of a key."""

    __slots__ = ("first", "last", "ttl", "hold", "suppressed")

    def __init__(self, first: tuple, last: int, ttl: int, hold: bool, suppressed: int) -> None:
        self.first, self.last, self.ttl, self.hold, self.suppressed = first, last, ttl, hold, suppressed

    @classmethod
    def of(cls, row: tuple) -> _Held:
        return cls((row[0], row[1], row[2], row[3]), row[4], row[5], row[6], row[7])

    def row(self) -> tuple:
        return (*self.first, self.last, self.ttl, self.hold, self.suppressed)

    @property
    def until(self) -> int:
        return self.first[0] + self.ttl * 1_000_000

    def over(self, us: int) -> bool:
        """Whether a time is past the window; with a negative ttl every time is."""
        return not self.hold and (self.ttl < 0 or us >= self.until)


def next_at(us: np.ndarray, start: int, end: int, bound: int) -> int:
    """First place in ``us[start:end]`` with a time of ``bound`` or more; ``end`` if there is none."""
    step = 64
    while start < end:
        stop = min(end, start + step)
        late = us[start:stop] >= bound
        if late.any():
            return start + int(late.argmax())
        start, step = stop, step * 2
    return end


def fold(rows: pd.DataFrame, held: _Held | None) -> tuple[list[tuple[int, bool, _Held | None, int]], _Held | None]:
    """Follow the operations of one key (sorted by arrival): ([(row, opens or active, window, suppressed)], window left).

    Works from window to window, not from row to row.
    """
    rank, us = rows["rank"].to_numpy(), rows["us"].to_numpy()
    cuts = np.append(np.flatnonzero(rank == CLEAR), len(rows))
    out: list[tuple[int, bool, _Held | None, int]] = []
    i = 0
    for cut in cuts.tolist():
        while i < cut:
            if held is None or held.over(us[i]):
                r = rows.iloc[i]
                held = _Held((int(us[i]), r["source_ip"], None if pd.isna(r["source_port"]) else int(r["source_port"]), r["trap_oid"]), int(us[i]), int(r["ttl_seconds"]), bool(r["hold"]), 0)
                out.append((i, True, held, 0))
                i += 1
            k = cut if held.hold else i if held.ttl < 0 else next_at(us, i, cut, held.until)
            out += [(at, False, held, held.suppressed + n + 1) for n, at in enumerate(range(i, k))]
            if k > i:
                held.suppressed, held.last = held.suppressed + k - i, int(us[k - 1])
            i = k
        if cut < len(rows):
            active = held is not None and not held.over(us[cut])
            out.append((cut, active, held if active else None, held.suppressed if active else 0))
            held, i = None, cut + 1
    return out, held


class Relay(StatefulProcessor):
    """``grace_seconds``: a state stays that much longer than its ttl, by the clock, for events that wait to be
    processed; None: no state is ever dropped by the clock."""

    def __init__(self, keep: list[str], grace_seconds: float | None) -> None:
        self.keep, self.grace = keep, grace_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] == "":
            for pdf in rows:
                yield self._plain(pdf)
            return
        batch = pd.concat(list(rows)).sort_values(["seq", "rank", "us"]).reset_index(drop=True)
        before = _Held.of(tuple(self.state.get())) if self.state.exists() else None
        opened = before.first if before else None
        got, held = fold(batch, before)
        if held is None:
            self.state.clear()
        else:
            self.state.update(held.row())
        if self.grace is not None and (held is None or held.first != opened):
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if held is not None and not held.hold:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int((max(held.ttl, 0) + self.grace) * 1000) + 1)
        if got:
            yield self._keyed(key, batch, got)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            held = _Held.of(tuple(self.state.get()))
            self.state.clear()
            row = dict.fromkeys([*_LOG, *self.keep]) | {"us": held.until, "event": SWEPT, "rule_id": key[0], "key_hash": key[1], **self._window(held, held.suppressed), "active": False}
            yield self._typed(pd.DataFrame([row]))

    def _window(self, held: _Held | None, suppressed: int) -> dict[str, Any]:
        if held is None:
            return dict.fromkeys(("ttl_seconds", "hold", "first_us", "first_ip", "first_port", "first_oid", "suppressed"))
        return {"ttl_seconds": held.ttl, "hold": held.hold, "first_us": held.first[0], "first_ip": held.first[1], "first_port": held.first[2], "first_oid": held.first[3], "suppressed": suppressed}

    def _typed(self, df: pd.DataFrame) -> pd.DataFrame:
        for c in ("seq", "us", "first_us", "suppressed", "ttl_seconds", "first_port"):
            df[c] = df[c].astype("Int64")
        for c in ("accepted", "forwarded", "hold", "active"):
            df[c] = df[c].astype("boolean")
        return df[[*_LOG, *self.keep]]

    def _plain(self, pdf: pd.DataFrame) -> pd.DataFrame:
        outcome = pdf["rank"] == PLAIN
        passes = pdf["reason"].isin(("pass-through", "dedup_disabled"))
        event = pdf["reason"].map(EVENT_NAMES).where(outcome, pdf["reason"])
        out = pd.DataFrame({c: pdf[c] if c in pdf else None for c in [*_LOG, *self.keep]})
        return self._typed(out.assign(event=event, accepted=passes.where(outcome, None), forwarded=passes.where(outcome, None), reason=pdf["reason"].where(outcome, None), rule_id=pdf["plain_rule"], key_hash=None, ttl_seconds=None, hold=None))

    def _keyed(self, key: Any, batch: pd.DataFrame, got: list[tuple[int, bool, _Held | None, int]]) -> pd.DataFrame:
        at = [i for i, *_ in got]
        out = batch.loc[at, ["seq", "us", "key_repr", "rank", *self.keep]].reset_index(drop=True)
        opens = pd.Series([o for _, o, *_ in got])
        clear = out["rank"] == CLEAR
        reason = opens.map({True: "alarm", False: "duplicate"}).where(~clear, None)
        window = pd.DataFrame([self._window(h, n) for _, _, h, n in got])
        sent = opens.where(~clear, None)
        out = out.assign(event=reason.map(EVENT_NAMES).where(~clear, CLEARED), reason=reason, accepted=sent, forwarded=sent, rule_id=key[0], key_hash=key[1], missing=None, active=opens.where(clear, None))
        return self._typed(pd.concat([out.drop(columns=["rank"]), window], axis=1))

    def close(self) -> None:
        pass


def relay_operations(events: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """What each event asks of the states: its clears, its alarm, or, without a key, just its outcome.

    ``events``: seq, received_at, fields, raw_varbind_map, and source_ip, source_port and trap_oid (as columns or
    in the map), of which the state keeps those of the first event. ``keep`` stays with the row of the outcome. Rows with an ``error`` (if
    there is such a column) are packets that could not be read.
    """
    snapshot = ["source_ip", "source_port", "trap_oid"]
    in_map = {c: F.try_element_at("fields", F.lit(c)).try_cast("int" if c == "source_port" else "string") for c in snapshot if c not in events.columns}
    events = events.withColumns(in_map)
    unread = F.col("error").isNotNull() if "error" in events.columns else F.lit(False)
    events = events.withColumn("unread", unread)
    decided = verdicts(events, rules, *dict.fromkeys([*snapshot, *keep, "unread"]))
    ttl, hold = held_for(rules)
    decided = decided.withColumns({"_ttl": ttl.cast("int"), "_hold": hold})
    has_key = F.col("key_hash").isNotNull() & F.col("us").isNotNull()
    text, none = F.lit(None).cast("string"), F.lit("")

    def op(rule: Any, key: Any, rank: int, reason: Any = text, plain_rule: Any = text, key_repr: Any = text, missing: Any = text, held: bool = False) -> Any:
        return F.struct(
            rule.alias("rule_id"), key.alias("key_hash"), F.lit(rank).alias("rank"), reason.alias("reason"), plain_rule.alias("plain_rule"), key_repr.alias("key_repr"), missing.alias("missing"),
            (F.col("_ttl") if held else F.lit(None).cast("int")).alias("ttl_seconds"), (F.col("_hold") if held else F.lit(None).cast("boolean")).alias("hold"),
        )

    bucket = F.pmod(F.xxhash64("seq"), F.lit(BUCKETS)).cast("string")
    rule = F.when(~plain_reason().isin("pass-through", "failed"), F.coalesce("filter_rule", "alarm_rule"))
    own = F.when(F.col("unread"), op(none, bucket, PLAIN, F.lit("parse_failed"))).when(has_key, op(F.col("alarm_rule"), F.col("key_hash"), ALARM, key_repr=F.col("key_repr"), held=True)).otherwise(
        op(none, bucket, PLAIN, plain_reason(), rule, missing=F.nullif(F.array_join("missing", ","), none))
    )
    cleared = F.transform("clears", lambda c: op(c["rule_id"], c["key_hash"], CLEAR, key_repr=c["key_repr"]))
    noted = F.transform("notes", lambda n: op(none, bucket, NOTE, n["event"], n["rule_id"], missing=n["missing"]))
    each = F.when(F.col("unread"), F.array(own)).otherwise(F.concat(cleared, noted, F.array(own)))
    ops = decided.select("seq", "us", *dict.fromkeys([*snapshot, *keep]), F.explode(each).alias("o"))
    outcome = F.col("o.rank").isin(ALARM, PLAIN)  # what is kept goes with the outcome, once
    extra = [F.when(outcome, F.col(c)).alias(f"kept_{c}") for c in keep]
    # A clear or alarm needs a time; a clear without one is before everything.
    return ops.select("seq", F.when(F.col("o.rank") == CLEAR, F.coalesce("us", F.lit(-(2**62)))).otherwise(F.col("us")).alias("us"), *snapshot, *extra, "o.*")


def relay_stream(events: DataFrame, rules: Rules, *keep: str, grace_seconds: float | None = 3600) -> DataFrame:
    """The log of the relay (see LOG) over a stream of events, in append mode, with ``keep`` beside outcomes.

    Each event has one row with a reason (filtered, failed, pass-through, dedup_disabled, alarm, duplicate),
    and rows without reason for each key that its clears name (``trap_cleared``, ``active`` if that held an open
    window, with its first event and count) and for clears that name none. ``dedup_cleanup`` is a state that was
    dropped by its timer: ``ttl + grace_seconds`` after it was opened, by the clock. Needs the RocksDB state store.
    """
    ops = relay_operations(events, rules, *keep)
    kinds = dict(ops.dtypes)
    kept = [f"kept_{c}" for c in keep]
    schema = LOG + "".join(f", `{c}` {kinds[c]}" for c in kept)
    log = ops.groupBy("rule_id", "key_hash").transformWithStateInPandas(Relay(kept, grace_seconds), schema, "append", "none" if grace_seconds is None else "ProcessingTime")
    return log.select(*_LOG, *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)))
