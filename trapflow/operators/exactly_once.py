"""At-least-once deliveries made exactly-once: a store of seen messages.

The store is a folder of segments that are only ever added. ``dictionary/`` has one row for each
message with its dense code in its shard, ``arrivals/`` the rows that were coded, ``kept/`` the arrival
chosen for a code, ``seen/`` bitmaps of 32,768 codes each (their union counts), ``dead/`` codes that a
late row has done away with. ``versions/N.json`` names the segments that count. A delivery writes its
segments first and then creates the next version, which only one of two writers can do; the other
starts again from the new state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapflow.functions.expr import micros
from trapflow.operators.sessions import merge_partials, partial_sessions
from trapflow.operators.skew import hot_split_join
from trapflow.operators.windows_from_first import assign_windows
from trapflow.sources.shared import materialize, newest_json, swap_json

KEYS = ["origin", "ident"]
#: Codes in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
#: New codes of a shard that are numbered in one task; a shard with more is numbered in pieces.
PIECE = 500_000
#: Times a delivery starts again because another came first.
ATTEMPTS = 20
#: Columns of the segments that are the same in every store.
SCHEMAS = {"seen": "shard int, bucket bigint, bits binary", "dead": "shard int, code bigint"}
#: A store with more segments of one kind is compacted by the next delivery.
MAX_SEGMENTS = 64


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1, F.lit(False))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class Delivery:
    """What one delivery found.

    ``kept``: the arrival chosen for each code whose bit was not set (shard, code, n, ord; us and what was
    carried, if anything was). ``extra``: (order_kept, order_extra) of surplus rows. ``changed``: (order, kept) of rows
    of earlier deliveries that a late row has made surplus, or no longer surplus.
    """

    kept: DataFrame
    extra: DataFrame
    changed: DataFrame


class SeenStore:
    """Messages seen so far, by origin and identifier.

    Rows of one origin with one identifier, received within ``window_s`` of the earliest of them, are
    one message; of its arrivals the one with the smallest order in the first delivery that brings any
    is kept. Rows with null origin, time, order or identifier, or an identifier in ``no_identifier``,
    are no deliveries and never surplus. Order must be unique; a row delivered again is surplus to
    itself only if its order is another. A row that arrives late and is earlier than its message's
    first moves the windows of that identifier: they are drawn anew over all its rows, so several
    deliveries give what one gives if order rises with them. An empty delivery changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, window_s: float = 900, shards: int = 64, no_identifier: tuple[int, ...] = (0,)) -> None:
        self.spark, self.folder, self.shards = spark, folder, shards
        self.window_us, self.no_identifier = int(window_s * 1_000_000), no_identifier

    # ---- state

    def _state(self) -> tuple[int, dict[str, Any]]:
        version, state = newest_json(self.spark, f"{self.folder}/versions")
        return version, {"dictionary": [], "arrivals": [], "kept": [], "seen": [], "dead": [], "next": [0] * self.shards} | (state or {})

    def _read(self, state: dict[str, Any], kind: str, shards: list[int] | None = None) -> DataFrame | None:
        """Segments of a kind. Files are sorted by shard, so a list of shards prunes what is read."""
        if not state[kind]:
            return None
        reader = self.spark.read.schema(SCHEMAS[kind]) if kind in SCHEMAS else self.spark.read
        rows = _union([reader.parquet(f"{self.folder}/{kind}/{s}") for s in state[kind]])
        return rows if shards is None or len(shards) == self.shards else rows.where(F.col("shard").isin(*shards))

    def _write(self, kind: str, df: DataFrame, *by: str) -> str:
        return self._written(kind, df, *by)[0]

    def _written(self, kind: str, df: DataFrame, *by: str) -> tuple[str, DataFrame]:
        """Write a segment: (its name, its rows as they were written)."""
        segment = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{kind}/{segment}")
        return segment, self.spark.read.schema(df.schema).parquet(f"{self.folder}/{kind}/{segment}")

    def _alive(self, state: dict[str, Any], kind: str, shards: list[int] | None = None) -> DataFrame | None:
        rows, dead = self._read(state, kind, shards), self._read(state, "dead", shards)
        return rows if rows is None or dead is None else rows.join(dead, ["shard", "code"], "left_anti")

    def dictionary(self) -> DataFrame | None:
        """shard, code, origin, ident and anchor of the messages that exist."""
        rows = self._alive(self._state()[1], "dictionary")
        return None if rows is None else rows.withColumn("fresh", F.lit(True))

    def seen(self, shards: list[int] | None = None) -> DataFrame | None:
        """shard, bucket and the union of its bitmaps."""
        return self._seen(self._state()[1], shards)

    def _seen(self, state: dict[str, Any], shards: list[int] | None = None) -> DataFrame | None:
        rows = self._read(state, "seen", shards)
        return None if rows is None else rows.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _commit(self, work: Callable[[dict[str, Any]], tuple[dict[str, Any], Any]]) -> Any:
        """Do ``work`` on the newest state and make what it adds the next version, or do it again."""
        for _ in range(ATTEMPTS):
            version, state = self._state()
            added, result = work(state)
            merged = {k: added.get(k, v) if k == "next" else [*v, *added.get(k, [])] for k, v in state.items()}
            if swap_json(self.spark, f"{self.folder}/versions", version + 1, merged):
                return result
        raise RuntimeError("too many writers at once")

    def compact(self) -> None:
        """Write dictionary, bitmaps and kept arrivals as one segment each, without the dead ones."""
        version, state = self._state()
        fresh = dict(state)
        for kind in ("dictionary", "arrivals", "kept"):
            rows = self._alive(state, kind)
            if rows is not None:
                fresh[kind] = [self._write(kind, rows.repartition("shard").sortWithinPartitions("shard", "code"))]
        bits = self._seen(state)
        if bits is not None:
            fresh["seen"] = [self._write("seen", bits.repartition("shard").sortWithinPartitions("shard", "bucket"))]
        fresh["dead"] = []
        swap_json(self.spark, f"{self.folder}/versions", version + 1, fresh)

    # ---- identifiers to codes

    def rows(self, df: DataFrame, origin: str, ident: str, time: str, order: str, carry: tuple[str, ...] = ()) -> DataFrame:
        """The rows that are deliveries, as (origin, ident, us, ord, carry)."""
        rows = df.select(F.col(origin).alias("origin"), F.col(ident).alias("ident"), micros(F.col(time)).alias("us"), F.col(order).alias("ord"), *carry)
        rows = rows.where("origin is not null and ident is not null and us is not null and ord is not null")
        return rows.where(~F.col("ident").isin(*self.no_identifier)) if self.no_identifier else rows

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.shards)).cast("int")

    def _messages(self, rows: DataFrame, carry: list[str]) -> DataFrame:
        """(keys, anchor, until, n, new, ord, carry) of each message; ``carry`` is that of a message of one row.

        Partial sessions by chunk find the stretches without a gap; a stretch no longer than the window
        is one message, of the others the windows are followed row by row.
        """
        own = [F.sum("new").alias("new"), *(F.min(c).alias(c) for c in carry)]
        merged = merge_partials(partial_sessions(rows, KEYS, "us", "ord", self.window_us, *own), KEYS, self.window_us)
        whole = Window.partitionBy(*KEYS, "session")
        merged = merged.select(
            *KEYS, "chunk", "session", F.col("n").alias("chunk_n"), F.min("min_us").over(whole).alias("anchor"), F.max("max_us").over(whole).alias("until"), F.min("chunk").over(whole).alias("head"),
            F.min("min_order").over(whole).alias("ord"), F.sum("n").over(whole).alias("n"), F.sum("new").over(whole).alias("new"), *carry,
        )
        long = F.col("until") - F.col("anchor") > self.window_us
        columns = [*KEYS, "anchor", "until", "n", "new", "ord", *carry]
        short = merged.where(~long & (F.col("chunk") == F.col("head"))).select(*columns)
        chained = rows.withColumn("chunk", F.floor(F.col("us") / F.lit(self.window_us)))
        chained = hot_split_join(chained, merged.where(long).drop("ord", "new", *carry), [*KEYS, "chunk"], "chunk_n", ["session", "n"], "ord")
        placed = assign_windows(materialize(chained.drop("chunk"), "chains"), [*KEYS, "session"], "us", self.window_us, F.col("n"))
        followed = placed.groupBy(*KEYS, "anchor").agg(F.max("us").alias("until"), F.count(F.lit(1)).alias("n"), F.sum("new").alias("new"), F.min("ord").alias("ord"), *(F.min(c).alias(c) for c in carry))
        return short.unionByName(followed.select(*columns)).withColumn("shard", self._shard())

    def _hit(self, state: dict[str, Any], rows: DataFrame) -> list[int] | None:
        """The shards that ``rows`` touch, at most as many numbers as there are shards; null for a new store."""
        return [r[0] for r in rows.select(self._shard()).distinct().collect()] if state["dictionary"] else None

    def _encode(self, state: dict[str, Any], rows: DataFrame, carry: list[str], groups: str | None, shards: list[int] | None) -> tuple[dict[str, Any], DataFrame]:
        """Code the messages of ``rows``: (what the state gets, arrivals with their codes)."""
        rows = rows.withColumn("new", F.lit(1).cast("bigint")).withColumn("old_code", F.lit(None).cast("bigint"))
        known = None
        if state["dictionary"]:
            touched = rows.select(*KEYS).distinct()
            known = materialize(self._alive(state, "dictionary", shards).join(touched, KEYS, "left_semi"), "known")
            past = self._alive(state, "arrivals", shards).join(known.select(*KEYS).distinct(), KEYS, "left_semi")
            rows = materialize(rows.unionByName(past.select(*KEYS, "us", "ord", *carry, F.lit(0).cast("bigint").alias("new"), F.col("code").alias("old_code"))), "rows")
        one = [*carry, "old_code"]
        messages = self._messages(rows, one)
        if known is not None:
            messages = messages.join(known.select(*KEYS, "anchor", "code"), [*KEYS, "anchor"], "left")
        messages = materialize(messages, "messages")
        added: dict[str, Any] = {}
        unknown = messages if known is None else messages.where("code is null").drop("code")
        numbered, added["next"], segment = self._number(unknown, state["next"])
        added["dictionary"] = [segment]
        coded = numbered.withColumn("fresh", F.lit(True))
        if known is not None:
            coded = coded.unionByName(messages.where("code is not null and new > 0").withColumn("fresh", F.lit(False)).select(*coded.columns))
            gone = known.join(messages.select(*KEYS, "anchor"), [*KEYS, "anchor"], "left_anti")
            added["dead"] = [self._write("dead", gone.select("shard", "code"))]
        segment, arrivals = self._written("arrivals", self._arrivals(rows, coded, one).sortWithinPartitions(*([groups] if groups else []), "shard"), *([groups] if groups else []))
        added["arrivals"] = [segment]
        return added, arrivals

    def _number(self, messages: DataFrame, free: list[int]) -> tuple[DataFrame, list[int], str]:
        """Give each message the next free code of its shard.

        A shard is numbered in pieces of about PIECE messages: what stands before a piece is known from
        the counts of the pieces, so no task sorts a whole shard.
        """
        pieces = max(1, -(-messages.count() // (self.shards * PIECE)))
        cut = messages.withColumn("piece", F.pmod(F.shiftrightunsigned(F.xxhash64(*KEYS), 24), F.lit(pieces)))
        sizes = cut.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("in_piece"))
        before = F.sum("in_piece").over(Window.partitionBy("shard").orderBy("piece")) - F.col("in_piece")
        inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*KEYS, "anchor")) - 1
        numbered = cut.withColumn("inside", inside).join(sizes.select("shard", "piece", before.alias("before")), ["shard", "piece"])
        code = F.get(F.array(*(F.lit(n).cast("bigint") for n in free)), F.col("shard")) + F.col("before") + F.col("inside")
        segment, written = self._written("dictionary", numbered.withColumn("code", code).drop("piece", "inside", "before"))
        ends = dict(written.groupBy("shard").agg((F.max("code") + 1).alias("end")).collect())  # a row a shard
        return written, [ends.get(s, n) for s, n in enumerate(free)], segment

    def _arrivals(self, rows: DataFrame, coded: DataFrame, one: list[str]) -> DataFrame:
        """Each row with the code of its message: of messages of one row from the message itself.

        A message touches at most two chunks as long as the window, and a chunk is touched by at most
        two messages of its key; so rows and messages meet in an equi-join on the chunk.
        """
        columns = ["shard", "code", *KEYS, "us", "ord", "new", "n", *one]
        width = F.lit(self.window_us)
        single = coded.where("n = 1").withColumn("us", F.col("anchor")).select(*columns)
        several = coded.where("n > 1").select(*KEYS, F.explode(F.sequence(F.floor(F.col("anchor") / width), F.floor(F.col("until") / width))).alias("chunk"), "anchor", "until", "shard", "code", "n", "fresh")
        spans = F.array_sort(F.collect_list(F.struct("anchor", "until", "shard", "code", "n", "fresh")))
        several = several.groupBy(*KEYS, "chunk").agg(spans.alias("spans"), F.sum("n").alias("weight"))
        hit = hot_split_join(rows.withColumn("chunk", F.floor(F.col("us") / width)), several, [*KEYS, "chunk"], "weight", ["spans"], "ord")
        span = F.get(F.filter("spans", lambda s: F.col("us").between(s.anchor, s.until)), F.lit(0))
        hit = hit.withColumn("span", span).where("span is not null and (new = 1 or span.fresh)")
        return single.unionByName(hit.select("span.shard", "span.code", *KEYS, "us", "ord", "new", "span.n", *one))

    # ---- codes to bits

    def _admit(self, state: dict[str, Any], arrivals: DataFrame, carry: list[str], shards: list[int] | None = None) -> tuple[dict[str, Any], DataFrame]:
        """One arrival for each code whose bit is not set, and the bits that are set by that."""
        columns = ["ord", "us", *carry] if carry else ["ord"]
        # The arrival that is first in order; without carried columns a hash aggregation of two numbers.
        first = F.min(F.struct(*columns)) if carry else F.min("ord")
        several = arrivals.where("n > 1").groupBy("shard", "code").agg(F.max("n").alias("n"), first.alias("first"))
        several = several.select("shard", "code", "n", *([F.col(f"first.{c}").alias(c) for c in columns] if carry else [F.col("first").alias("ord")]))
        chosen = arrivals.where("n = 1").select("shard", "code", "n", *columns).unionByName(several).withColumn("bucket", F.bitmap_bucket_number("code"))
        seen = self._seen(state, shards)
        if seen is not None:
            tested = chosen.join(seen, ["shard", "bucket"], "left")
            chosen = tested.where(F.col("bits").isNull() | ~_bit(F.col("bits"), F.bitmap_bit_position("code"))).drop("bits")
        segment, kept = self._written("kept", chosen.sortWithinPartitions("shard", "code"))
        bits = kept.groupBy("shard", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        return {"kept": [segment], "seen": [self._write("seen", bits)]}, kept

    # ---- deliveries

    def encode(self, rows: DataFrame, carry: tuple[str, ...] = (), groups: str | None = None) -> DataFrame:
        """Put the messages of ``rows`` (see ``rows``; read several times) into the dictionary and give back
        every arrival with its code. ``groups``: a carried column by which the arrivals are laid down, if they
        are admitted group by group."""
        return self._commit(lambda state: self._encode(state, rows, list(carry), groups, self._hit(state, rows)))

    def admit(self, arrivals: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """Take coded arrivals: the one of each code whose bit is not set is kept, and the bits are united."""
        return self._commit(lambda state: self._admit(state, arrivals, list(carry)))

    def pairs(self, arrivals: DataFrame | None = None) -> DataFrame:
        """(order_kept, order_extra) of the surplus rows of ``arrivals`` (default: all of the store)."""
        state = self._state()[1]
        rows, kept = self._alive(state, "arrivals") if arrivals is None else arrivals, self._read(state, "kept")
        if rows is None or kept is None:
            return self.spark.createDataFrame([], "order_kept bigint, order_extra bigint")
        return self._pairs(rows, kept)

    def _pairs(self, arrivals: DataFrame, kept: DataFrame) -> DataFrame:
        # A message of one row has no surplus; a later arrival of a stored message counts those before.
        several = arrivals.where("n > 1").select("shard", "code", "ord")
        chosen = kept.select("shard", "code", "n", F.col("ord").alias("order_kept"))
        hit = hot_split_join(several, chosen, ["shard", "code"], "n", ["order_kept"], "ord")
        return hit.select("order_kept", F.col("ord").alias("order_extra")).where("order_kept <> order_extra")

    def deliver(self, df: DataFrame, origin: str, ident: str, time: str, order: str, carry: tuple[str, ...] = ()) -> Delivery:
        """Take a batch, store its new messages and give back what is kept and what to drop."""
        rows = materialize(self.rows(df, origin, ident, time, order, carry), "deliveries")
        if max(len(v) for k, v in self._state()[1].items() if k != "next") > MAX_SEGMENTS:
            self.compact()

        def work(state: dict[str, Any]) -> tuple[dict[str, Any], Delivery]:
            shards = self._hit(state, rows)
            added, arrivals = self._encode(state, rows, list(carry), None, shards)
            bits, kept = self._admit(state, arrivals, list(carry), shards)
            earlier = self._read(state, "kept", shards)
            known = kept if earlier is None else earlier.unionByName(kept)
            return added | bits, Delivery(kept, self._pairs(arrivals.where("new = 1"), known), self._changed(arrivals, known))

        return self._commit(work)

    def _changed(self, arrivals: DataFrame, kept: DataFrame) -> DataFrame:
        """(order, kept) of rows of earlier deliveries that are kept now and were not, or the other way round."""
        moved = arrivals.where("new = 0").select("shard", "code", "old_code", "ord")
        now = kept.select("shard", "code", F.col("ord").alias("now"))
        was = kept.select("shard", F.col("code").alias("old_code"), F.col("ord").alias("was"))
        both = moved.join(now, ["shard", "code"]).join(was, ["shard", "old_code"])
        return both.where((F.col("now") == F.col("ord")) != (F.col("was") == F.col("ord"))).select(F.col("ord").alias("order"), (F.col("now") == F.col("ord")).alias("kept"))
