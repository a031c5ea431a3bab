"""Attribute-value rows into one row for each entity with typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapflow.functions.expr import let
from trapflow.functions.oid import longest_prefix, plain
from trapflow.functions.values import KINDS, read_value, typed

#: The listed attributes are literals of the plan; a longer list is refused.
MAX_ATTRIBUTES = 5000


@dataclass(frozen=True)
class Attribute:
    key: str
    name: str
    kind: str
    unit: str | None = None


def listed_attributes(alias: DataFrame) -> list[Attribute]:
    """Attributes of a table (oid, attr_name, kind, unit) in the order of their OIDs' text.

    Rows without oid, name or known kind are left out; of equal OIDs the first name counts.
    """
    rows = alias.select(plain(F.col("oid")).alias("oid"), "attr_name", "kind", "unit").where(F.col("attr_name").isNotNull() & F.col("kind").isin(*KINDS) & (F.col("oid") != ""))
    got = rows.orderBy("oid", "attr_name").limit(MAX_ATTRIBUTES + 1).collect()
    if len(got) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    first: dict[str, Attribute] = {}
    for r in got:
        first.setdefault(r.oid, Attribute(r.oid, r.attr_name, r.kind, r.unit))
    return list(first.values())


def _constants(attributes: list[Attribute], position: Column) -> tuple[Column, Column]:
    kinds, units = F.array(*(F.lit(a.kind) for a in attributes)), F.array(*(F.lit(a.unit).cast("string") for a in attributes))
    return F.get(kinds, position), F.get(units, position)


def _read(attributes: list[Attribute], position: Column, value: Column) -> Column:
    kind, unit = _constants(attributes, position)
    return read_value(value, kind, unit)


def _cell(values: Column) -> Column:
    """A cell of the grid from its values' canonical texts, in order; null: not readable."""

    def cell(good: Column) -> Column:
        issue = F.when((F.size(values) > 0) & (F.size(good) == 0), "unreadable").when(F.size(F.array_distinct(good)) > 1, "conflict")
        return F.struct(F.get(good, F.size(good) - 1).alias("text"), issue.alias("issue"))

    return let(F.filter(values, lambda v: v.isNotNull()), cell)


def nested_grid(df: DataFrame, entity: str, entries: Column, attributes: list[Attribute]) -> DataFrame:
    """(entity, grid) where an entity's attribute rows lie nested in its row: ``entries`` is
    ARRAY<STRUCT<key, value>>. The grid is complete, one cell for each attribute, sorted by position;
    it is built inside the row, without a shuffle.
    """
    listed = {a.key: i for i, a in enumerate(attributes)}
    placed = F.filter(F.transform(entries, lambda e: F.struct(longest_prefix(plain(e["key"]), listed).alias("at"), e["value"].alias("value"))), lambda e: e.at.isNotNull())
    read = F.transform(placed, lambda e: F.struct(e["at"].alias("at"), _read(attributes, e["at"], e["value"]).alias("text")))
    read = F.coalesce(read, F.array().cast("array<struct<at:int,text:string>>"))

    def cells(r: Column) -> Column:
        places = F.array_distinct(F.transform(r, lambda e: e["at"]))
        return F.map_from_arrays(places, F.transform(places, lambda i: let(F.transform(F.filter(r, lambda e: e["at"] == i), lambda e: e["text"]), _cell)))

    # Bound once each: the values are read once, not once for each cell.
    places = F.sequence(F.lit(0), F.lit(len(attributes) - 1))
    grid = let(let(read, cells), lambda got: F.transform(places, lambda i: F.try_element_at(got, i)))
    return df.select(F.col(entity).alias("entity"), (grid if attributes else F.array().cast("array<struct<text:string,issue:string>>")).alias("grid"))


def long_grid(df: DataFrame, entity: str, attribute: str, value: str, order: str, attributes: list[Attribute], entities: DataFrame | None = None) -> DataFrame:
    """(entity, grid) from rows entity, attribute, value. ``order`` says which of several values is last.

    Values are read and each cell is hash-aggregated to a last, smallest and largest value before the
    shuffle, so an entity with very many rows is no larger than its grid. The grid of all entities and
    attributes is completed (positions are exploded from a constant list), the cells are joined to it from
    the left, and each entity's cells are collected in the order of their positions. ``entities``: a table
    with one row for each entity (column ``entity``); without it, the entities of ``df`` count. Entities
    with no listed attribute have an empty cell everywhere; null entities are left out.
    """
    listed = {a.key: i for i, a in enumerate(attributes)}
    rows = df.select(F.col(entity).alias("entity"), longest_prefix(plain(F.col(attribute)), listed).alias("at"), F.col(value).alias("value"), F.col(order).alias("ord")).where("entity is not null")
    if entities is None:
        entities = rows.select("entity").distinct()
    if not attributes:
        return entities.where("entity is not null").select("entity", F.array().cast("array<struct<text:string,issue:string>>").alias("grid"))
    read = rows.where("at is not null").select("entity", "at", "ord", _read(attributes, F.col("at"), F.col("value")).alias("text"))
    cells = read.groupBy("entity", "at").agg(
        F.max_by("text", F.when(F.col("text").isNotNull(), F.struct("ord", "text"))).alias("text"), F.min("text").alias("lo"), F.max("text").alias("hi")
    )
    issue = F.when(F.col("text").isNull(), "unreadable").when(F.col("lo") != F.col("hi"), "conflict")
    cells = cells.select("entity", "at", "text", issue.alias("issue"))
    grid = entities.where("entity is not null").select("entity", F.explode(F.sequence(F.lit(0), F.lit(len(attributes) - 1))).alias("at"))
    line = grid.join(cells, ["entity", "at"], "left").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "text", "issue"))).alias("line"))
    return line.select("entity", F.transform("line", lambda c: F.struct(c["text"].alias("text"), c["issue"].alias("issue"))).alias("grid"))


def to_columns(grid: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One typed column for each attribute, by its fixed index in the grid; null where nothing is readable."""
    return grid.select("entity", *(typed(F.get("grid", F.lit(i)).text, a.kind).alias(a.name) for i, a in enumerate(attributes)))


def issues(grid: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(entity, attr_name, issue) of the cells with a problem: ``unreadable`` (no value that the cast to the
    attribute's type takes) or ``conflict``."""
    cells = [F.get("grid", F.lit(i)) for i in range(len(attributes))]
    said = [F.when(c.issue.isNotNull(), F.struct(F.lit(a.name).alias("attr_name"), F.when(typed(c.text, a.kind).isNull(), "unreadable").otherwise(c.issue).alias("issue"))) for c, a in zip(cells, attributes, strict=True)]
    bad = F.array(*said) if said else F.array().cast("array<struct<attr_name:string,issue:string>>")
    return grid.select("entity", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("bad")).select("entity", "bad.attr_name", "bad.issue")
