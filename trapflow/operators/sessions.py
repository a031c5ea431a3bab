"""Sessions: an entity's rows separated by gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapflow.functions.expr import micros


def partial_sessions(df: DataFrame, keys: list[str], us: str, order: str, gap_us: int, *more: Column) -> DataFrame:
    """One row for each key and time chunk as long as the gap: a local session.

    Two rows of one chunk are less than the gap apart, so a chunk never holds two sessions and a
    hash aggregation (combined before the shuffle) builds it. A key has as many chunks as fit into
    its span of time, however many rows it holds. ``more``: further aggregates of a local session.
    """
    return df.groupBy(*keys, F.floor(F.col(us) / F.lit(gap_us)).alias("chunk")).agg(
        F.min(us).alias("min_us"), F.max(us).alias("max_us"), F.min(order).alias("min_order"), F.max(order).alias("max_order"), F.count(F.lit(1)).alias("n"), *more
    )


def merge_partials(partials: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Number each key's partial sessions by the session they belong to (column ``session``)."""
    w = Window.partitionBy(*keys).orderBy("chunk")
    opens = F.coalesce(F.col("min_us") - F.lag("max_us").over(w) > gap_us, F.lit(True))
    return partials.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(w)).drop("opens")


def sessions(df: DataFrame, entity: str, time: str, order: str, gap_s: float = 1800) -> DataFrame:
    """Sessions of each entity: start, end, duration, number of rows, smallest and largest order.

    A session ends where the entity's next row is more than ``gap_s`` later. Rows with null entity
    or time are left out; rows with equal times, and repeated rows, count each; other columns are
    ignored; an empty table gives an empty result.
    """
    if gap_s <= 0:
        raise ValueError("gap_s must be positive")
    gap_us = int(gap_s * 1_000_000)
    rows = df.select(F.col(entity).alias("entity"), micros(F.col(time)).alias("us"), F.col(order).alias("ord")).where("entity is not null and us is not null")
    merged = merge_partials(partial_sessions(rows, ["entity"], "us", "ord", gap_us), ["entity"], gap_us)
    out = merged.groupBy("entity", "session").agg(
        F.min("min_us").alias("s"), F.max("max_us").alias("e"), F.sum("n").alias("n_events"), F.min("min_order").alias("order_min"), F.max("max_order").alias("order_max")
    )
    return out.select(
        "entity", F.timestamp_micros("s").alias("session_start"), F.timestamp_micros("e").alias("session_end"),
        ((F.col("e") - F.col("s")) / 1e6).alias("duration_s"), "n_events", "order_min", "order_max",
    )
