"""Runs of one value in each entity's sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapflow.functions.expr import micros


def runs(df: DataFrame, entity: str, value: str, time: str, order: str, max_step_s: float | None = None, chunk_s: int = 60) -> DataFrame:
    """Collapse each maximal run of equal ``value`` to one row with its count and duration.

    The sequence of an entity is its rows by ``time``, ties by ``order``. A run ends where the value
    changes or, with ``max_step_s``, where the step to the next row is longer. Within a time chunk,
    the row number in the entity less the row number in entity and value is constant over a run; the
    first and last run of a chunk are then joined to their neighbours: a task sorts the rows of one chunk,
    and of an entity at most two runs for each chunk, however many rows it has. Rows with null entity, value or time are left out of the sequence; repeated
    rows count; other columns are ignored; an empty table gives an empty result.
    """
    step_us = None if max_step_s is None else int(max_step_s * 1_000_000)
    rows = (
        df.select(F.col(entity).alias("entity"), F.col(value).alias("value"), micros(F.col(time)).alias("us"), F.col(order).alias("ord"))
        .where("entity is not null and value is not null and us is not null")
        .withColumn("chunk", F.floor(F.col("us") / F.lit(chunk_s * 1_000_000)))
    )
    seq = Window.partitionBy("entity", "chunk").orderBy("us", "ord")
    own = Window.partitionBy("entity", "chunk", "value").orderBy("us", "ord")
    broken = F.lit(0) if step_us is None else F.coalesce(F.col("us") - F.lag("us").over(seq) > step_us, F.lit(False)).cast("int")
    numbered = rows.select("*", F.row_number().over(seq).alias("rn"), broken.alias("broken"))
    numbered = numbered.withColumn("part", F.sum("broken").over(seq)).withColumn("diff", F.col("rn") - F.row_number().over(own))
    local = numbered.groupBy("entity", "chunk", "value", "diff", "part").agg(
        F.min("us").alias("s"), F.max("us").alias("e"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("rn").alias("rn")
    )
    # Only the outer runs of a chunk can go on in another chunk; those inside are whole.
    chunk = Window.partitionBy("entity", "chunk")
    local = local.withColumn("outer", (F.col("rn") == F.min("rn").over(chunk)) | (F.col("rn") == F.max("rn").over(chunk)))
    local = local.withColumn("cell", F.when(~F.col("outer"), F.col("chunk")))
    line = Window.partitionBy("entity", "cell").orderBy("chunk", "rn")
    same_chunk = F.col("chunk") == F.lag("chunk").over(line)
    too_late = F.lit(False) if step_us is None else F.col("s") - F.lag("e").over(line) > step_us
    # Neighbours in one chunk are different runs by construction; inner runs always stand alone.
    opens = F.coalesce(~F.col("outer") | same_chunk | (F.col("value") != F.lag("value").over(line)) | too_late, F.lit(True))
    merged = local.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(line))
    out = merged.groupBy("entity", "cell", "run").agg(
        F.first("value").alias("value"), F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n_events"), F.min("lo").alias("order_min"), F.max("hi").alias("order_max")
    )
    return out.select(
        "entity", "value", F.timestamp_micros("s").alias("run_start"), F.timestamp_micros("e").alias("run_end"),
        ((F.col("e") - F.col("s")) / 1e6).alias("duration_s"), "n_events", "order_min", "order_max",
    )
