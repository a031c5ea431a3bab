"""Windows of fixed length that open at the first row not in an earlier window.

``t0`` opens the first window of a key; the next opens at the first row later than ``t0 + width``,
and so on. Each window depends on the one before, so a long unbroken chain is cut into time chunks:
a chunk's table says, for each place at which a chain may enter it, which window is its last; the
tables of a key are then followed from chunk to chunk, and each chunk is resolved by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapflow.operators.skew import hot_split_join

#: A chunk in widths: longer chunks, fewer steps from chunk to chunk.
CHUNK_WIDTHS = 4
#: Rows of a chunk, about: one that holds more is cut into pieces of equal time, each of which is a chunk.
CHUNK_ROWS = 500_000
#: Rows of a key that are folded as one array; each step copies the array of the steps before.
SMALL = 256


def exit_table(us: np.ndarray, chunk_start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct times: entry times (upper ends of ranges) and the last window's start for each."""
    nxt = np.searchsorted(us, us + width, side="right")
    at = np.where(nxt < len(us), nxt, np.arange(len(us)))
    while not np.array_equal(at, hop := at[at]):
        at = hop
    entries = min(len(us), int(np.searchsorted(us, chunk_start + width, side="right")) + 1)
    last = us[at[:entries]]
    ends = np.append(np.flatnonzero(np.diff(last)), entries - 1)
    return us[:entries][ends], last[ends]


def leaders(us: np.ndarray, previous: int | None, width: int) -> np.ndarray:
    """Start of the window of each time (sorted), given the last window opened before the chunk."""
    out = np.empty(len(us), dtype=np.int64)
    i = 0
    if previous is not None:
        i = int(np.searchsorted(us, previous + width, side="right"))
        out[:i] = previous
    while i < len(us):
        j = int(np.searchsorted(us, us[i] + width, side="right"))
        out[i:j] = us[i]
        i = j
    return out


def assign_windows(rows: DataFrame, keys: list[str], us: str, width: Column | int, size: Column) -> DataFrame:
    """Add ``anchor``, the start of the row's window. No key may be null; ``width`` (in microseconds)
    and ``size`` (the key's number of rows, or more) must be the same for all rows of a key.

    A key of at most SMALL rows is one array, folded in the JVM; larger keys go chunk by chunk, if there are
    any. ``rows`` is read more than once: give what is cheap to read.
    """
    few = size <= SMALL
    folded, many = _folded(rows.where(few), keys, us, width), rows.where(~few)
    return folded if many.isEmpty() else folded.unionByName(_chunked(many, keys, us, width))


def _folded(rows: DataFrame, keys: list[str], us: str, width: Column | int) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    wide = rows.withColumn("_width", width if isinstance(width, Column) else F.lit(width).cast("bigint"))
    by_time = lambda a, b: F.when(a[us] < b[us], -1).when(a[us] > b[us], 1).otherwise(0)
    line = wide.groupBy(*keys, "_width").agg(F.array_sort(F.collect_list(F.struct(*others)), by_time).alias("_rows"))

    def step(state: Column, row: Column) -> Column:
        first = F.when(state["first"].isNull() | (row[us] > state["first"] + F.col("_width")), row[us]).otherwise(state["first"])
        return F.struct(first.alias("first"), F.array_append(state["anchors"], first).alias("anchors"))

    start = F.struct(F.lit(None).cast("bigint").alias("first"), F.array().cast("array<bigint>").alias("anchors"))
    anchors = F.aggregate("_rows", start, step, lambda state: state["anchors"])
    placed = line.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("row"), anchors.alias("anchor"))).alias("_at"))
    return placed.select(*keys, *(F.col(f"_at.row.{c}").alias(c) for c in others), F.col("_at.anchor").alias("anchor")).select(*rows.columns, "anchor")


def _chunked(rows: DataFrame, keys: list[str], us: str, width: Column | int) -> DataFrame:
    kinds = dict(rows.dtypes)
    columns = rows.columns
    rows = rows.withColumn("_width", width if isinstance(width, Column) else F.lit(width).cast("bigint"))
    by = [*keys, "_width"]
    whole = F.col("_width") * CHUNK_WIDTHS
    rows = rows.withColumn("_coarse", F.floor(F.col(us) / whole))
    counts = rows.groupBy(*by, "_coarse").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_pieces", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("_rows") / CHUNK_ROWS)), F.lit(0))).cast("bigint"))
    rows = hot_split_join(rows, counts, [*by, "_coarse"], "_rows", ["_pieces"], us)
    length, start = F.greatest(F.ceil(whole / F.col("_pieces")), F.lit(1)), F.col("_coarse") * whole
    # A chunk goes by the time it starts at.
    rows = rows.withColumn("_chunk", start + F.floor((F.col(us) - start) / length) * length).drop("_coarse", "_pieces", "_rows")
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _width bigint"
    times = rows.select(*by, "_chunk", F.col(us).alias("_us")).distinct()

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, width = int(pdf["_chunk"].iat[0]), int(pdf["_width"].iat[0])
        upto, last = exit_table(np.sort(pdf["_us"].to_numpy()), chunk, width)
        return pd.DataFrame({**{k: pdf[k].iat[0] for k in by}, "_chunk": chunk, "_upto": upto, "_last": last})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "_upto"])
        width = int(pdf["_width"].iat[0])
        previous, got = None, []
        for chunk, part in pdf.groupby("_chunk", sort=True):
            got.append((chunk, previous))
            upto = part["_upto"].to_numpy()
            i = 0 if previous is None else int(np.searchsorted(upto, previous + width, side="right"))
            if i < len(upto):
                previous = int(part["_last"].to_numpy()[i])
        out = pd.DataFrame({"_chunk": [c for c, _ in got], "_previous": pd.array([p for _, p in got], dtype="Int64")})
        return out.assign(**{k: pdf[k].iat[0] for k in by})[[*by, "_chunk", "_previous"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", anchor bigint"

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(us)
        previous = pdf["_previous"].iat[0]
        anchor = leaders(pdf[us].to_numpy(), None if pd.isna(previous) else int(previous), int(pdf["_width"].iat[0]))
        return pdf[columns].assign(anchor=anchor)

    steps = times.groupBy(*by, "_chunk").applyInPandas(tables, f"{head}, _chunk bigint, _upto bigint, _last bigint")
    entered = steps.groupBy(*by).applyInPandas(follow, f"{head}, _chunk bigint, _previous bigint")
    return rows.join(entered, [*by, "_chunk"]).groupBy(*by, "_chunk").applyInPandas(resolve, schema)
