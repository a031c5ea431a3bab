"""Mixing sources to target shares of a size in tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapflow.sources.shared import materialize

#: Ranks of a public byte-level BPE; any tokenizer of this form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A source's order is cut into 2**BLOCK_BITS blocks; a task holds at most one block of one source.
BLOCK_BITS = 12
MAX_TARGETS = 10_000
#: A longer text is encoded in cuts of this many characters (the tokenizer works on one whole piece).
CUT = 1_000_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield pd.Series([0 if not t else sum(len(encoding.encode_ordinary(t[i : i + CUT])) for i in range(0, len(t), CUT)) for t in texts], dtype="int64")

    return docs.withColumn(out, count(F.col(text)))


def source_name(value: Column) -> Column:
    """One notation of a source: lower case, no outer blanks, ``-`` as ``_``; blank gives null."""
    name = F.replace(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit("-"), F.lit("_"))
    return F.when(name != "", name)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and brought to sum 1; sources without tokens stay at 0."""
    logs = {s: exponent * math.log(p) for s, p in shares.items() if p > 0}
    top = max(logs.values(), default=0.0)
    total = sum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(logs[s] - top) / total if s in logs else 0.0 for s in shares}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect_exponent(tokens: dict[str, int], target_entropy: float, max_repeats: dict[str, int] | None = None, budget: int = 0) -> float:
    """Exponent in [0, 64] at which the tempered shares reach an entropy, raised until no source needs
    more repeats than allowed for ``budget`` tokens (if any exponent up to 1 allows that)."""
    return _exponent(tokens, target_entropy, {s: float(max_repeats.get(s, 1) * n) for s, n in tokens.items()} if max_repeats else None, budget)


def _exponent(tokens: dict[str, int], target_entropy: float, limits: dict[str, float] | None, budget: float) -> float:
    total = sum(tokens.values())
    if not total:
        return 1.0
    shares = {s: n / total for s, n in tokens.items()}

    def bisect(bad, lo: float, hi: float) -> float:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if bad(mid) else (lo, mid)
        return hi

    exponent = bisect(lambda a: entropy(tempered(shares, a)) > target_entropy, 0.0, 64.0)
    if limits:
        over = lambda a: any(p * budget > limits[s] * (1 + 1e-12) for s, p in tempered(shares, a).items())
        if over(exponent) and exponent < 1.0:
            exponent = bisect(over, exponent, 1.0)
    return exponent


@dataclass(frozen=True)
class SourcePlan:
    """What one target source gets. ``available``: its tokens times ``max_repeats``; ``given``: the
    smaller of that and ``budget``; ``actual_share``: that of the mix."""

    source: str
    tokens: int
    weight: float
    max_repeats: int
    budget: float
    available: int
    given: float
    actual_share: float
    short: bool


def measured(docs: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n): tokens of each document, written once to the shared folder.

    ``source`` in one notation; null where the document has none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    return materialize(token_counts(rows, "text", "n", vocabulary).drop("text"), "tokens")


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and cap of each source. Of targets that agree in one notation, shares are added and the
    smallest cap counts; null share counts 0, null cap 1; targets without a source are left out."""
    name = source_name(F.col("source"))
    rows = targets.where(name.isNotNull()).groupBy(name.alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    got = rows.limit(MAX_TARGETS + 1).collect()
    if len(got) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    return {r["source"]: (r["share"], r["cap"]) for r in got}


def plan(sizes: DataFrame, targets: dict[str, tuple[float, int]], budget: float | None = None, weights: dict[str, float] | None = None) -> list[SourcePlan]:
    """Plan of a mix of ``budget`` tokens (default: as many as all documents have, with or without
    source). ``weights`` (default: the target shares) are normalised as they stand."""
    listed = F.when(F.col("source").isin(*targets), F.col("source"))  # others are one group: few rows reach the driver
    counted = {r["source"]: r["n"] for r in sizes.groupBy(listed.alias("source")).agg(F.sum("n").alias("n")).collect()}
    size = float(sum(counted.values())) if budget is None else budget
    rows = []
    for s, (share, cap) in sorted(targets.items()):
        weight, have = share if weights is None else weights.get(s, 0.0), counted.get(s) or 0
        rows.append((s, have, weight, cap, weight * size, cap * have, min(weight * size, float(cap * have))))
    given = math.fsum(r[6] for r in rows)
    return [SourcePlan(*r, r[6] / given if given else 0.0, r[5] < r[4]) for r in rows]


def tempered_plan(sizes: DataFrame, targets: dict[str, tuple[float, int]], budget: float | None = None) -> tuple[float, list[SourcePlan]]:
    """First exponent and plan of a mix that tempers what the targets leave free.

    A source that can reach its target share has it; one that can't has all its repeats (``short``). What
    the short ones leave goes to sources with room: their token shares raised to the exponent at which
    they have the entropy of their targets, or at which none exceeds its room; a source that exceeds it at
    any exponent is filled, and the rest is tempered again. ``weight`` is the normalised weight of the mix.
    """
    plans = plan(sizes, targets, budget)
    given = {p.source: p.given for p in plans}
    room = {p.source: p.available - p.given for p in plans if p.tokens and p.weight > 0 and p.available > p.given}
    tokens, wanted = {p.source: p.tokens for p in plans}, {p.source: p.weight for p in plans}
    free, first = math.fsum(p.budget for p in plans) - math.fsum(given.values()), None
    while room and free > 0.5:
        mine, share = {s: tokens[s] for s in room}, math.fsum(wanted[s] for s in room)
        exponent = _exponent(mine, entropy({s: wanted[s] / share for s in room}), room, free)
        first = exponent if first is None else first
        parts = {s: free * w for s, w in tempered({s: n / sum(mine.values()) for s, n in mine.items()}, exponent).items()}
        full = [s for s in room if parts[s] >= room[s]]
        for s in full or list(room):
            part = min(parts[s], room[s])
            given[s] += part
            free -= part
            del room[s]
    total = math.fsum(given.values())
    made = [SourcePlan(p.source, p.tokens, given[p.source] / total if total else 0.0, p.max_repeats, p.budget, p.available, given[p.source], given[p.source] / total if total else 0.0, p.short) for p in plans]
    return 1.0 if first is None else first, made


def temperature_plan(sizes: DataFrame, targets: dict[str, tuple[float, int]], budget: float | None = None) -> tuple[float, list[SourcePlan]]:
    """Exponent and plan of a mix by temperature: natural token shares of the listed sources, raised to
    the exponent at which they have the entropy of the target shares, or repeat no source too often."""
    natural = plan(sizes, targets, budget)
    tokens = {p.source: p.tokens for p in natural}
    whole = sum(p.weight for p in natural) or 1.0
    size = natural[0].budget / natural[0].weight if budget is None and natural and natural[0].weight else budget or float(sum(tokens.values()))
    exponent = bisect_exponent(tokens, entropy({p.source: p.weight / whole for p in natural}), {p.source: p.max_repeats for p in natural}, int(size))
    total = sum(tokens.values()) or 1
    return exponent, plan(sizes, targets, size, tempered({s: n / total for s, n in tokens.items()}, exponent))


PLAN = "source string, tokens bigint, weight double, max_repeats int, budget double, available bigint, given double, actual_share double, short boolean"


def realised_shares(sizes: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """The plan of each source beside what the realised mix holds of it: ``real_tokens``, ``real_share``, and
    ``falls_short``: all repeats are used up and give less than the target."""
    real = realise(sizes, plans).join(sizes.select("doc_id", "n"), "doc_id").groupBy("source").agg(F.sum(F.col("repeats") * F.col("n")).alias("real_tokens"))
    rows = sizes.sparkSession.createDataFrame([tuple(vars(p).values()) for p in plans], PLAN).join(F.broadcast(real), "source", "left").withColumn("real_tokens", F.coalesce("real_tokens", F.lit(0)))
    total = F.broadcast(real.agg(F.sum("real_tokens").alias("_total")))
    rows = rows.join(total).withColumn("real_share", F.coalesce(F.col("real_tokens") / F.nullif(F.col("_total"), F.lit(0)), F.lit(0.0))).drop("_total")  # one row beside a row a source
    return rows.withColumn("falls_short", (F.col("real_tokens") >= F.col("available")) & (F.col("real_tokens") < F.col("budget")))


def realise(sizes: DataFrame, plans: list[SourcePlan], seed: int = 1) -> DataFrame:
    """(doc_id, source, repeats): how often each document is in the mix; those not in it are left out.

    A source's documents stand in a random order given by a hash of ``seed`` and id. Whole passes over
    them fill the budget as far as they fit, and a last pass stops at the document that brings it
    closest. The order is cut into blocks by the hash: tokens before a block are summed over blocks,
    those before a document inside its block, so no task holds a whole source.
    """
    spark = sizes.sparkSession
    kept = [p for p in plans if p.tokens and p.given > 0]
    passes = [(p.source, int(p.given // p.tokens), p.given - p.given // p.tokens * p.tokens, p.max_repeats) for p in kept]
    each = F.broadcast(spark.createDataFrame(passes, "source string, full bigint, rest double, cap int"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).join(each, "source")
    rows = rows.withColumn("place", place).withColumn("block", F.shiftrightunsigned("place", 64 - BLOCK_BITS))
    blocks = rows.groupBy("source", "block").agg(F.sum("n").alias("in_block"))
    blocks = blocks.select("source", "block", (F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block")).alias("before_block"))
    inside = F.sum("n").over(Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = rows.join(blocks, ["source", "block"]).withColumn("before", F.col("before_block") + inside)
    last = (F.col("before") + F.col("n") / 2 <= F.col("rest")) & (F.col("full") < F.col("cap")) & (F.col("rest") > 0)
    out = rows.select("doc_id", "source", (F.col("full") + last.cast("int")).cast("int").alias("repeats"))
    return out.where("repeats > 0")
