"""Equi-joins in which a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot; a bound on what is broadcast. Any other key holds less
#: than one part in MAX_HOT of the rows.
MAX_HOT = 1000
#: A key with fewer rows fits into a task anyway.
HOT_ROWS = 200_000
SALTS = 1024


def hot_split_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, columns: list[str], spread: str, inner: bool = True) -> DataFrame:
    """Join ``big`` with ``small`` (one row for each key), adding ``columns`` of ``small``.

    ``weight``: column of ``small`` with the key's number of rows in ``big``. The heaviest keys (at
    most MAX_HOT, of HOT_ROWS rows or more) are joined on the map side; rows of these keys are then
    salted by ``spread`` so that the shuffled join of the rest meets no hot key.
    """
    part = small.select(*keys, weight, *columns)
    hot = part.where(F.col(weight) >= HOT_ROWS).orderBy(F.desc(weight), *keys).limit(MAX_HOT)
    hot = hot.select(*keys, F.struct(*columns).alias("_hot"))
    cold = part.select(*keys, F.lit(0).alias("_salt"), F.struct(*columns).alias("_cold"))
    spread_rows = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int") + 1))
    joined = spread_rows.join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    if inner:
        joined = joined.where(F.col("_got").isNotNull())
    return joined.select("*", *(F.col(f"_got.{c}").alias(c) for c in columns)).drop("_hot", "_cold", "_salt", "_got")
