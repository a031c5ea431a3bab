"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapflow.llm import contamination, mixing, pii_tables
from trapflow.sources.tables import table


#: Words that may differ in each window of eight.
CHANGED_WORDS = 1


def _leaks(spark: SparkSession, root: str, exact: bool) -> DataFrame:
    docs, items = table(spark, root, "documents"), table(spark, root, "eval_item")
    return contamination.find_leaks(docs, "doc_id", "text", items, "item_id", "text", changed=CHANGED_WORDS, exact=exact)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps that tolerate changed words, then the exact rule of passages of equal words."""
    return _leaks(spark, root, exact=True)


def p6_changed(spark: SparkSession, root: str) -> DataFrame:
    """Leaks of items whose passages may have a changed word in each window."""
    return _leaks(spark, root, exact=False)


def p6_items(spark: SparkSession, root: str) -> DataFrame:
    """Leaked items and the number of documents that hold each."""
    return p6_found(spark, root).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


def _sizes(spark: SparkSession, root: str):
    return mixing.measured(table(spark, root, "documents"), "doc_id", "text", "source"), mixing.read_targets(table(spark, root, "mix_target"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources that the realised mix holds less of than their target, though all their repeats are in it."""
    sizes, targets = _sizes(spark, root)
    return mixing.realised_shares(sizes, mixing.tempered_plan(sizes, targets)[1]).where("falls_short").select("source")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Plan of each target source, the exponent of what was free, and the tokens and share the realised mix holds."""
    sizes, targets = _sizes(spark, root)
    exponent, plans = mixing.tempered_plan(sizes, targets)
    return mixing.realised_shares(sizes, plans).withColumn("exponent", F.lit(exponent))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """Each document of the mix and how often it is repeated."""
    sizes, targets = _sizes(spark, root)
    return mixing.realise(sizes, mixing.tempered_plan(sizes, targets)[1])


def p7_temperature(spark: SparkSession, root: str) -> DataFrame:
    """The mix by temperature alone, at the entropy of the target shares within the repetition limits, realised."""
    sizes, targets = _sizes(spark, root)
    exponent, plans = mixing.temperature_plan(sizes, targets)
    return mixing.realised_shares(sizes, plans).withColumn("exponent", F.lit(exponent))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    found = pii_tables.personal_information(table(spark, root, "documents"), "doc_id", "text")
    return found.select("doc_id", F.explode("finds").alias("find")).select("doc_id", "find.pii_type", "find.pii_key")


def p8_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Each mail's text with typed placeholders, and how many distinct finds it had."""
    found = pii_tables.personal_information(table(spark, root, "documents"), "doc_id", "text", with_text=True)
    return found.select("doc_id", "redacted", F.size("finds").alias("n_finds"))


QUERIES = {"p6_found": p6_found, "p6_changed": p6_changed, "p6_items": p6_items, "p7_found": p7_found, "p7_shares": p7_shares, "p7_mix": p7_mix, "p7_temperature": p7_temperature, "p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLES: dict[str, str] = {}
