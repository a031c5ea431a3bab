"""Per-entity features from events: counts, totals and recency by event type, as of any day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapflow.functions.expr import micros


def daily_cumulative(df: DataFrame, entity: str, kind: str, time: str, order: str, amount: Column | None = None) -> DataFrame:
    """Cumulative table: entity, type, day -> count and total of all days so far, last row of the day.

    Hash-aggregated by day before the only wide shuffle; then an entity and type has at most one row
    a day. Rows with null entity, type or time are left out; repeated rows count; a null amount adds
    nothing; other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(
        F.col(entity).alias("entity"), F.col(kind).alias("kind"), micros(F.col(time)).alias("us"), F.col(order).alias("ord"),
        F.coalesce(amount if amount is not None else F.lit(1), F.lit(0)).cast("double").alias("amount"),
    ).where("entity is not null and kind is not null and us is not null")
    days = rows.groupBy("entity", "kind", F.to_date(F.timestamp_micros("us")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max(F.struct("us", "ord")).alias("last")
    )
    so_far = Window.partitionBy("entity", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("entity", "kind", "day", F.sum("n").over(so_far).alias("cum_n"), F.sum("total").over(so_far).alias("cum_total"), "last")


def calendar_features(cumulative: DataFrame, unit: str = "month") -> DataFrame:
    """Count, total and last row of every entity, type and calendar unit in which it has events.

    The count is the cumulative count as of the unit's last day less that as of the day before the
    unit: each is the newest cumulative row not after that day.
    """
    units = cumulative.groupBy("entity", "kind", F.trunc("day", unit).alias("unit")).agg(
        F.max_by(F.struct("cum_n", "cum_total"), "day").alias("at_end"), F.max("last").alias("last")
    )
    w = Window.partitionBy("entity", "kind").orderBy("unit")
    before = F.lag("at_end").over(w)
    return units.select(
        "entity", "kind", "unit",
        (F.col("at_end.cum_n") - F.coalesce(before.cum_n, F.lit(0))).alias("n"),
        (F.col("at_end.cum_total") - F.coalesce(before.cum_total, F.lit(0.0))).alias("total"),
        F.timestamp_micros("last.us").alias("last_at"), F.col("last.ord").alias("last_order"),
    )


def window_features(cumulative: DataFrame, as_of: str, windows: dict[str, int]) -> DataFrame:
    """Trailing windows as of the end of day ``as_of``: one row for each entity and type.

    ``windows``: name -> days. ``{name}_n`` and ``{name}_total`` are differences of two as-of
    endpoints; ``days_since`` is the recency. Types first seen after ``as_of`` are left out.
    """
    day = F.lit(as_of).cast("date")

    def at(end: Column) -> Column:
        return F.max_by(F.when(F.col("day") <= end, F.struct("cum_n", "cum_total")), F.when(F.col("day") <= end, F.col("day")))

    ends = cumulative.where(F.col("day") <= day).groupBy("entity", "kind").agg(at(day).alias("now"), *(at(F.date_sub(day, d)).alias(f"_{n}") for n, d in windows.items()), F.max("last").alias("last"))
    out = [F.col("entity"), F.col("kind"), F.date_diff(day, F.timestamp_micros("last.us")).alias("days_since"), F.col("last.ord").alias("last_order")]
    for n in windows:
        out += [(F.col("now.cum_n") - F.coalesce(F.col(f"_{n}.cum_n"), F.lit(0))).alias(f"{n}_n"), (F.col("now.cum_total") - F.coalesce(F.col(f"_{n}.cum_total"), F.lit(0.0))).alias(f"{n}_total")]
    return ends.select(*out)


def wide(features: DataFrame, keys: list[str], kinds: list[str] | None = None) -> DataFrame:
    """One row for each of ``keys``: a map from type to its features, or columns ``{type}__{feature}``.

    A row's map has an entry for each of the entity's types; ``kinds`` lists the types to spread into
    columns instead (any number; absent ones count 0).
    """
    values = [c for c in features.columns if c not in (*keys, "kind")]
    maps = features.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("kind"), F.struct(*values))))).alias("features"))
    if kinds is None:
        return maps
    got = {k: F.try_element_at("features", F.lit(k)) for k in kinds}
    zero = {c: F.lit(0).cast(t) for c, t in features.dtypes if c in ("n", "total") or c.endswith(("_n", "_total"))}
    return maps.select(*keys, *((F.coalesce(got[k][c], zero[c]) if c in zero else got[k][c]).alias(f"{k}__{c}") for k in kinds for c in values))
