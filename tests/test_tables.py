"""Feature table and wide table."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from trapflow.operators.feature_table import calendar_features, daily_cumulative, wide, window_features
from trapflow.operators.wide_table import Attribute, issues, listed_attributes, long_grid, nested_grid, to_columns

T0 = dt.datetime(2024, 1, 20)


def events(spark, rows):
    return spark.createDataFrame([(w, k, None if s is None else T0 + dt.timedelta(hours=s), q, a, "c", 1) for w, k, s, q, a in rows], "who string, kind2 string, at timestamp, seq long, amount double, kind string, day int")


def some():
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice("xyz"), r.randint(0, 1500), q, r.choice([None, 1.0, 2.5])) for q in range(300)]
    return rows + [(None, "x", 1, 1000, 1.0), ("a", None, 1, 1001, 1.0), ("a", "x", None, 1002, 1.0)] + [("a", "x", 700, 1003, 1.0)] * 2


def good(rows):
    return [r for r in rows if None not in r[:3]]


def test_monthly_features(spark):
    rows = some()
    got = {(r.entity, r.kind, r.unit.month): (r.n, r.total, r.last_order) for r in calendar_features(daily_cumulative(events(spark, rows), "who", "kind2", "at", "seq", F.col("amount"))).collect()}
    want = {}
    for w, k, s, q, a in good(rows):
        want.setdefault((w, k, (T0 + dt.timedelta(hours=s)).month), []).append((s, q, a or 0.0))
    assert got == {key: (len(v), sum(x[2] for x in v), max(v)[1]) for key, v in want.items()}


def test_trailing_windows(spark):
    rows = some()
    cumulative = daily_cumulative(events(spark, rows), "who", "kind2", "at", "seq")
    end = dt.date(2024, 2, 20)
    got = {(r.entity, r.kind): (r.days_since, r.d7_n, r.d30_n) for r in window_features(cumulative, "2024-02-20", {"d7": 7, "d30": 30}).collect()}
    want = {}
    for w, k, s, *_ in good(rows):
        day = (T0 + dt.timedelta(hours=s)).date()
        if day <= end:
            want.setdefault((w, k), []).append((end - day).days)
    assert got == {key: (min(v), sum(x < 7 for x in v), sum(x < 30 for x in v)) for key, v in want.items()}


def test_wide_features(spark):
    features = calendar_features(daily_cumulative(events(spark, [("a", "x", 1, 1, None), ("a", "y", 2, 2, None)]), "who", "kind2", "at", "seq"))
    row = wide(features, ["entity", "unit"], ["x", "y", "z"]).first()
    assert (row["x__n"], row["y__last_order"], row["z__n"], row["z__last_order"]) == (1, 2, 0, None)
    assert set(wide(features, ["entity", "unit"]).first().features) == {"x", "y"}
    assert daily_cumulative(events(spark, []), "who", "kind2", "at", "seq").count() == 0


ATTRIBUTES = [Attribute("1.5", "n", "long"), Attribute("1.5.2", "t", "double", "C"), Attribute("1.7", "s", "string")]
TRAPS = [
    (1, [("1.5", "7"), ("1.5.2.9", "3,5 C"), (".1.7", " a ")]), (2, [("1.5.1", "x"), ("1.5", "8")]), (3, [("1.5", "x"), ("1.5", None)]), (4, [("1.5", "1"), ("1.5", "01"), ("1.5", "2"), ("1.5", "?")]),
    (5, []), (6, None), (7, [("9.9", "1"), (None, "1"), ("1.55", "4")]), (8, [("1.7", "long " * 5000)]),
]
WANT = {1: (Decimal(7), 3.5, "a"), 2: (Decimal(8), None, None), 3: (None, None, None), 4: (Decimal(2), None, None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, ("long " * 5000).strip())}
ISSUES = {(3, "n", "unreadable"), (4, "n", "conflict")}


def test_nested_attribute_rows(spark):
    df = spark.createDataFrame([(i, e, "clash") for i, e in TRAPS], "id long, e array<struct<key:string,value:string>>, grid string")
    grid = nested_grid(df, "id", F.col("e"), ATTRIBUTES)
    assert {r[0]: tuple(r)[1:] for r in to_columns(grid, ATTRIBUTES).collect()} == WANT
    assert {tuple(r) for r in issues(grid, ATTRIBUTES).collect()} == ISSUES
    assert to_columns(nested_grid(df.where("false"), "id", F.col("e"), ATTRIBUTES), ATTRIBUTES).count() == 0


def test_long_attribute_rows(spark):
    rows = [(i, k, v, q) for i, e in TRAPS for q, (k, v) in enumerate(e or [(None, None)])]
    df = spark.createDataFrame([*rows, *rows[:3], (None, "1.5", "1", 0)], "id long, a string, v string, q long")
    grid = long_grid(df, "id", "a", "v", "q", ATTRIBUTES)
    assert {r[0]: tuple(r)[1:] for r in to_columns(grid, ATTRIBUTES).collect()} == WANT
    assert {tuple(r) for r in issues(grid, ATTRIBUTES).collect()} == ISSUES


def test_listed_attributes(spark):
    alias = spark.createDataFrame([(".1.2", "a", "long", None), ("1.2", "b", "long", None), ("1.3", None, "long", None), ("1.4", "c", "odd", None), (None, "d", "long", None)], "oid string, attr_name string, kind string, unit string")
    assert listed_attributes(alias) == [Attribute("1.2", "a", "long", None)]
