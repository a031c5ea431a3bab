"""Mixing: tokens, plans, temperature, the realised mix."""

import math

import pytest
from pyspark.sql import functions as F

from trapflow.llm.mixing import bisect_exponent, entropy, measured, plan, read_targets, realise, realised_shares, source_name, tempered, tempered_plan, temperature_plan, token_counts


def test_tokens(spark):
    texts = ["", None, "hello world", "hello" * 3, "<|endoftext|>", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in token_counts(df, "t", "n").collect()}
    assert (got[0], got[1], got[2]) == (0, 0, 2) and got[4] > 1 and got[5] > 1000


def test_source_names(spark):
    df = spark.createDataFrame([(x,) for x in (" Ops-Lists ", "ops_lists", "", "  ", None)], "s string")
    assert [r.o for r in df.select(source_name(F.col("s")).alias("o")).collect()] == ["ops_lists", "ops_lists", None, None, None]


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n long")


ROWS = [(i, "big", 10) for i in range(300)] + [(1000 + i, "small", 7) for i in range(20)] + [(2000 + i, None, 10) for i in range(100)] + [(3000, "empty", 0)]


def test_plan_and_mix(spark):
    df = sizes(spark, ROWS)
    targets = {"big": (0.5, 2), "small": (0.3, 3), "none": (0.1, 5), "empty": (0.1, 9)}
    plans = {p.source: p for p in plan(df, targets)}
    everything = sum(n for *_, n in ROWS)
    assert plans["big"].budget == 0.5 * everything and not plans["big"].short
    assert plans["small"].short and plans["small"].given == 3 * 140 and plans["none"].short and plans["empty"].short
    assert math.isclose(sum(p.actual_share for p in plans.values()), 1)
    mix = {r.doc_id: (r.source, r.repeats) for r in realise(df, list(plans.values())).collect()}
    assert {d: r for d, (s, r) in mix.items() if s == "small"} == {1000 + i: 3 for i in range(20)}
    assert abs(sum(10 * r for s, r in mix.values() if s == "big") - plans["big"].given) <= 5
    assert max(r for _, r in mix.values()) <= 3 and None not in {s for s, _ in mix.values()}
    again = {r.doc_id: (r.source, r.repeats) for r in realise(df, list(plans.values())).collect()}
    assert again == mix
    other = {r.doc_id for r in realise(df, list(plans.values()), seed=2).where("source = 'big'").collect()}
    assert other != {d for d, (s, _) in mix.items() if s == "big"}


def test_a_small_budget_takes_part_of_a_pass(spark):
    df = sizes(spark, ROWS)
    mix = realise(df, plan(df, {"big": (1.0, 1)}, budget=1234.0)).collect()
    assert {r.repeats for r in mix} == {1} and abs(10 * len(mix) - 1234) <= 5


def test_targets(spark):
    df = spark.createDataFrame([("A-b", 0.2, 3), (" a_B ", 0.1, 2), (None, 0.5, 1), ("c", None, None)], "source string, target_share double, max_repeats int")
    got = read_targets(df)
    assert got["a_b"][1] == 2 and math.isclose(got["a_b"][0], 0.3) and got["c"] == (0.0, 1) and len(got) == 2


def test_temperature(spark):
    tokens = {"a": 9000, "b": 900, "c": 100}
    flat = bisect_exponent(tokens, math.log(3))
    assert flat < 1e-6
    half = bisect_exponent(tokens, 0.8)
    assert math.isclose(entropy(tempered({s: n / 10000 for s, n in tokens.items()}, half)), 0.8, rel_tol=1e-6)
    limited = bisect_exponent(tokens, math.log(3), {"a": 1, "b": 2, "c": 3}, 10000)
    shares = tempered({s: n / 10000 for s, n in tokens.items()}, limited)
    assert all(shares[s] * 10000 <= {"a": 1, "b": 2, "c": 3}[s] * tokens[s] * (1 + 1e-6) for s in tokens) and limited > flat
    df = sizes(spark, ROWS)
    exponent, plans = temperature_plan(df, {"big": (0.6, 2), "small": (0.4, 2)})
    assert 0 <= exponent <= 1 and math.isclose(sum(p.weight for p in plans), 1)


def test_empty(spark):
    df = sizes(spark, [])
    plans = plan(df, {"a": (1.0, 2)})
    assert (plans[0].given, plans[0].short, plans[0].actual_share) == (0.0, False, 0.0)
    assert realise(df, plans).count() == 0


def test_measured(spark):
    df = spark.createDataFrame([(1, "a b", " X-y", "clash"), (2, None, None, "clash")], "id long, body string, origin string, n string")
    assert sorted(tuple(r) for r in measured(df, "id", "body", "origin").collect()) == [(1, "x_y", 2), (2, None, 0)]


@pytest.mark.parametrize("exponent", [0.0, 1.0])
def test_tempered(exponent):
    assert math.isclose(sum(tempered({"a": 0.9, "b": 0.1, "c": 0.0}, exponent).values()), 1)


def test_what_short_sources_leave_is_tempered_and_realised(spark):
    df = sizes(spark, ROWS + [(4000 + i, "mid", 5) for i in range(100)])
    targets = {"big": (0.5, 2), "small": (0.3, 3), "none": (0.1, 5), "mid": (0.1, 4)}
    exponent, plans = tempered_plan(df, targets)
    by = {p.source: p for p in plans}
    everything = sum(n for *_, n in ROWS) + 500
    assert by["small"].short and by["none"].short and by["small"].given == 420 and by["none"].given == 0
    assert math.isclose(sum(p.given for p in plans), everything, abs_tol=1) and exponent >= 0
    assert by["big"].given >= by["big"].budget and by["mid"].given >= by["mid"].budget and all(p.given <= p.available for p in plans)
    real = {r.source: r for r in realised_shares(df, plans).collect()}
    assert all(abs(real[s].real_share - by[s].weight) < 0.01 for s in by) and math.isclose(sum(r.real_share for r in real.values()), 1)
    assert {s for s, r in real.items() if r.falls_short} == {"small", "none"} == {p.source for p in plans if p.short}


def test_no_room_at_all(spark):
    df = sizes(spark, [(1, "a", 10), (2, "b", 10), (3, None, 80)])
    exponent, plans = tempered_plan(df, {"a": (0.5, 1), "b": (0.5, 2)})
    assert [p.given for p in plans] == [10, 20] and {r.source for r in realised_shares(df, plans).where("falls_short").collect()} == {"a", "b"}
    assert realised_shares(sizes(spark, []), tempered_plan(sizes(spark, []), {"a": (1.0, 2)})[1]).where("falls_short").count() == 0
