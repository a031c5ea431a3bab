"""The trap tables: which columns mean what, and the queries p1 to p5 over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapflow.functions.address import source_address
from trapflow.functions.oid import trap_type
from trapflow.operators.exactly_once import SeenStore
from trapflow.operators.feature_table import calendar_features, daily_cumulative, wide, window_features
from trapflow.operators.runs import runs
from trapflow.operators.sessions import sessions
from trapflow.operators.wide_table import issues, listed_attributes, long_grid, nested_grid, to_columns
from trapflow.sources.shared import fresh_folder, materialize
from trapflow.sources.tables import table

SESSION_GAP_S = 1800
MESSAGE_WINDOW_S = 900
RUN_STEP_S = 600
RUN_ROWS = 3
FEATURE_ROWS = 3
#: Groups of landing batches that are delivered one after the other.
DELIVERIES = 4
#: Day of the trailing windows.
WINDOWS_AS_OF = "2018-01-22"


def traps(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """seq, received_at, source (canonical) and ``columns`` of the rows with source and time."""
    df = table(spark, root, "trap_event").select("seq", "received_at", source_address(F.col("source_ip")).alias("source"), *columns)
    return df.where("source is not null and received_at is not null")


def entries(df: DataFrame) -> Column:
    """A trap's attribute rows: its varbinds or, if null or empty, the entries of its raw map."""
    raw = F.transform(F.map_entries("raw_varbind_map"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    listed = F.transform("varbinds", lambda e: F.struct(e["oid"].alias("key"), e["value"].alias("value")))
    return F.when(F.size("varbinds") > 0, listed).otherwise(raw)


def deliveries(spark: SparkSession, root: str, *carry: str) -> tuple[SeenStore, DataFrame, list[DataFrame], DataFrame]:
    """The landing batches delivered one after the other, in DELIVERIES groups of neighbours.

    Gives the store, its coded arrivals, what each delivery kept, and all traps with source and time
    (written once: parsed once). Identifiers of all batches are put into the dictionary first, so rows that
    land late move no window; then each delivery keeps one arrival for each bit that no delivery before
    it has set. ``carry``: columns of the traps that kept rows have, after their source.
    """
    kind, amount = trap_type(F.col("trap_oid")).alias("kind"), F.coalesce(F.size("varbinds"), F.lit(0)).alias("amount")
    own = [c for c in (kind, amount) if carry]
    rows = materialize(traps(spark, root, "request_id", "batch_id", *own), "traps")
    first, last = rows.agg(F.min("batch_id"), F.max("batch_id")).first()
    group = F.floor((F.col("batch_id") - F.lit(first)) * F.lit(DELIVERIES) / F.lit((last or 0) - (first or 0) + 1)).cast("int") if first is not None else F.lit(0)
    store = SeenStore(spark, fresh_folder(spark, "seen"), MESSAGE_WINDOW_S)
    rows = rows.withColumn("delivery", F.coalesce(group, F.lit(0)))
    arrivals = store.encode(store.rows(rows, "source", "request_id", "received_at", "seq", ("delivery", *carry)), ("delivery", *carry), "delivery")
    kept = [store.admit(arrivals.where(F.col("delivery") == k), ("origin", *carry) if carry else ()) for k in range(DELIVERIES)]
    return store, arrivals, kept, rows


def cumulative(spark: SparkSession, root: str) -> DataFrame:
    """Counts, totals (of variable bindings) and last row of every source and trap type by day, cumulated;
    surplus copies are not counted. Stored in the shared folder: features of any window are read from it."""
    _, _, kept, rows = deliveries(spark, root, "kind", "amount")
    columns = ["source", "kind", "received_at", "seq", "amount"]
    counted = rows.where("request_id is null or request_id = 0").select(*columns)
    for part in kept:
        counted = counted.unionByName(part.select(F.col("origin").alias("source"), "kind", F.timestamp_micros("us").alias("received_at"), F.col("ord").alias("seq"), "amount"))
    return materialize(daily_cumulative(counted, "source", "kind", "received_at", "seq", F.col("amount")), "daily")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    got = calendar_features(cumulative(spark, root)).where(F.col("n") >= FEATURE_ROWS)
    return got.select(F.col("entity").alias("source_ip"), F.date_format("unit", "yyyy-MM").alias("month_key"), F.col("kind").alias("trap_oid"), F.col("last_order").alias("latest_seq"))


def p1_features(spark: SparkSession, root: str) -> DataFrame:
    """One row for each source and month: a map from trap type to count, total and recency."""
    rows = calendar_features(cumulative(spark, root)).withColumn("days_to_end", F.date_diff(F.last_day("unit"), "last_at"))
    rows = rows.select(F.col("entity").alias("source_ip"), F.date_format("unit", "yyyy-MM").alias("month_key"), "kind", "n", "total", "days_to_end")
    return wide(rows, ["source_ip", "month_key"]).select("source_ip", "month_key", F.to_json("features").alias("features"))


def p1_windows(spark: SparkSession, root: str) -> DataFrame:
    """Trailing windows as of one day: counts and totals of a day, a week and four weeks, and recency."""
    got = window_features(cumulative(spark, root), WINDOWS_AS_OF, {"d1": 1, "d7": 7, "d28": 28})
    return got.select(F.col("entity").alias("source_ip"), F.col("kind").alias("trap_oid"), "days_since", F.col("last_order").alias("latest_seq"), "d1_n", "d7_n", "d28_n", F.col("d28_total").cast("bigint").alias("d28_total"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    got = sessions(traps(spark, root), "source", "received_at", "seq", SESSION_GAP_S)
    return got.select(F.col("entity").alias("source_ip"), F.col("order_min").alias("seq_min"), F.col("order_max").alias("seq_max"))


def p2_sessions(spark: SparkSession, root: str) -> DataFrame:
    got = sessions(traps(spark, root), "source", "received_at", "seq", SESSION_GAP_S)
    return got.select(F.col("entity").alias("source_ip"), F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    store, arrivals, _, _ = deliveries(spark, root)
    return store.pairs(arrivals).select(F.col("order_kept").alias("seq_kept"), F.col("order_extra").alias("seq_extra"))


def attribute_rows(spark: SparkSession, root: str) -> DataFrame:
    """The traps' attribute-value rows: seq, place in the trap, key and value."""
    df = table(spark, root, "trap_event")
    return df.select("seq", F.posexplode(entries(df)).alias("place", "e")).select("seq", "place", "e.key", "e.value")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    attributes = listed_attributes(table(spark, root, "oid_alias"))
    every = table(spark, root, "trap_event").select(F.col("seq").alias("entity"))
    grid = long_grid(attribute_rows(spark, root), "seq", "key", "value", "place", attributes, every)
    return issues(grid, attributes).withColumnRenamed("entity", "seq")


def p4_wide(spark: SparkSession, root: str) -> DataFrame:
    """One row a trap with typed columns. A trap's attribute rows lie nested in it, so its grid is made in
    the row, without a shuffle."""
    attributes = listed_attributes(table(spark, root, "oid_alias"))
    df = table(spark, root, "trap_event")
    return to_columns(nested_grid(df, "seq", entries(df), attributes), attributes).withColumnRenamed("entity", "seq")


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    """The cells of the wide table in types that all engines print alike: doubles, and text for all else."""
    wide_rows = p4_wide(spark, root)
    kinds = {c: F.unix_micros(c).cast("string") if t == "timestamp" else F.col(c) if t == "double" else F.col(c).cast("string") for c, t in wide_rows.dtypes if c != "seq"}
    return wide_rows.select("seq", *(v.alias(c) for c, v in kinds.items()))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    got = p5_all(spark, root).where(F.col("n_events") >= RUN_ROWS)
    return got.select(F.col("order_min").alias("seq_min"), F.col("order_max").alias("seq_max"))


def p5_all(spark: SparkSession, root: str) -> DataFrame:
    rows = traps(spark, root, trap_type(F.col("trap_oid")).alias("kind"))
    return runs(rows, "source", "kind", "received_at", "seq", RUN_STEP_S)


def p5_runs(spark: SparkSession, root: str) -> DataFrame:
    return p5_all(spark, root).select(F.col("entity").alias("source_ip"), F.col("value").alias("trap_oid"), F.unix_micros("run_start").alias("start_us"), F.unix_micros("run_end").alias("end_us"), "n_events")


QUERIES = {
    "p1_found": p1_found, "p1_features": p1_features, "p1_windows": p1_windows, "p2_found": p2_found, "p2_sessions": p2_sessions, "p3_found": p3_found,
    "p4_found": p4_found, "p4_wide": p4_wide, "p4_values": p4_values, "p5_found": p5_found, "p5_runs": p5_runs,
}
