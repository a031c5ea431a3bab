"""Running sums and maxima over long sequences of a key.

The sequence is cut into chunks of the order column. Chunks are aggregated first; what stands before
a chunk is known from the chunks before it, and only the rows of one chunk are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str, value: Column, how: str, inclusive: bool) -> DataFrame:
    """Add ``out``: sum or max (``how``) of ``value`` over the key's rows before, or up to, this one.

    ``chunk`` must not fall along ``order``. Null where no row comes before (a sum: 0).
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = rows.groupBy(*keys, "_chunk").agg(agg("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_chunk", agg("_total").over(earlier).alias("_before"))
    rows = rows.withColumn("_here", agg("_value").over(inside)).join(totals, [*keys, "_chunk"])
    if how == "sum":
        result = F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        result = F.greatest("_here", "_before")
    return rows.withColumn(out, result).drop("_chunk", "_value", "_here", "_before")
