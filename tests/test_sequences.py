"""Sessions, runs, windows from the first row and running aggregates, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapflow.operators import skew, windows_from_first
from trapflow.operators.prefix import running
from trapflow.operators.runs import runs
from trapflow.operators.sessions import sessions
from trapflow.operators.skew import hot_split_join
from trapflow.operators.windows_from_first import assign_windows, exit_table, leaders

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "who string, what string, at timestamp, seq long, entity string, n int, chunk string, run string"


def frame(spark, rows):
    """Rows (who, what, seconds, seq), with more columns whose names clash with inner ones."""
    return spark.createDataFrame([(w, k, None if s is None else T0 + dt.timedelta(seconds=s), q, "x", 1, "y", "z") for w, k, s, q in rows], SCHEMA)


def some(seed=1, n=400):
    r = random.Random(seed)
    rows, t = [], 0.0
    for q in range(n):
        t += r.choice([0, 0, 1, 5, 30, 400, 700, 601, 600, 1800, 1801, 5000])
        rows.append((r.choice(["a", "a", "a", "b"]), r.choice("xxy"), t, q))
    rows += [(None, "x", 5, 9001), ("a", None, 7, 9002), ("a", "x", None, 9003), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def brute(rows, step, by_value):
    out = []
    for who in sorted({r[0] for r in rows if r[0]}):
        line = sorted((s, q, k) for w, k, s, q in rows if w == who and s is not None and (k or not by_value))
        group = []
        for x in line:
            if group and (x[0] - group[-1][0] > step or by_value and x[2] != group[-1][2]):
                out.append((who, group))
                group = []
            group.append(x)
        if group:
            out.append((who, group))
    return sorted((w, g[0][0], g[-1][0], len(g), min(x[1] for x in g), max(x[1] for x in g)) for w, g in out)


def listed(df, start, end):
    return sorted((r["entity"], (r[start] - T0).total_seconds(), (r[end] - T0).total_seconds(), r.n_events, r.order_min, r.order_max) for r in df.collect())


def test_sessions(spark):
    rows = some()
    assert listed(sessions(frame(spark, rows), "who", "at", "seq", 1800), "session_start", "session_end") == brute(rows, 1800, False)


def test_sessions_at_the_gap_and_repeated_rows(spark):
    rows = [("a", "x", 0, 1), ("a", "x", 1800, 2), ("a", "x", 1800, 2), ("a", "x", 3600.000001, 3)]
    got = listed(sessions(frame(spark, rows), "who", "at", "seq", 1800), "session_start", "session_end")
    assert [(g[3], g[4], g[5]) for g in got] == [(3, 1, 2), (1, 3, 3)]


def test_sessions_empty_and_wrong_gap(spark):
    assert sessions(frame(spark, []), "who", "at", "seq").count() == 0
    with pytest.raises(ValueError, match="positive"):
        sessions(frame(spark, []), "who", "at", "seq", 0)


@pytest.mark.parametrize("chunk", [1, 900, 10**7])
def test_runs(spark, chunk):
    rows = some(2)
    assert listed(runs(frame(spark, rows), "who", "what", "at", "seq", 600, chunk), "run_start", "run_end") == brute(rows, 600, True)


def test_runs_without_a_step_limit_and_empty(spark):
    rows = some(3)
    assert listed(runs(frame(spark, rows), "who", "what", "at", "seq", None, 600), "run_start", "run_end") == brute(rows, 1e12, True)
    assert runs(frame(spark, []), "who", "what", "at", "seq").count() == 0


def simple_windows(us, width):
    out, first = {}, None
    for u in sorted(set(us)):
        if first is None or u > first + width:
            first = u
        out[u] = first
    return out


@pytest.mark.parametrize(("size", "dense"), [(1, 500_000), (10**6, 500_000), (10**6, 2)])
def test_windows_from_first(spark, size, dense, monkeypatch):
    monkeypatch.setattr(windows_from_first, "CHUNK_ROWS", dense)
    r = random.Random(4)
    rows = [(k, u) for k in ("a", "b", "c") for u in np.cumsum([r.choice([1, 3, 9, 10, 11, 95]) for _ in range(300)]).tolist()] + [("d", 5), ("d", 5)]
    df = spark.createDataFrame([(k, u, i) for i, (k, u) in enumerate(rows)], "k string, us long, i long")
    got = {(x.k, x.us): x.anchor for x in assign_windows(df, ["k"], "us", 10, F.lit(size)).collect()}
    want = {(k, u): a for k in "abcd" for u, a in simple_windows([u for q, u in rows if q == k], 10).items()}
    assert got == want


def test_exit_tables_follow_every_entry():
    r = random.Random(5)
    us = np.cumsum([r.randint(1, 8) for _ in range(60)])
    upto, last = exit_table(us, 0, 10)
    for previous in range(-9, 0):
        i = int(np.searchsorted(upto, previous + 10, side="right"))
        assert leaders(us, previous, 10)[-1] == last[i]


def test_running_sums_and_maxima(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), q, r.randint(-5, 5)) for q in range(200)]
    df = spark.createDataFrame(rows, "k string, q long, v int")
    got = {x.q: (x.s, x.m) for x in running(running(df, ["k"], ["q"], F.floor(F.col("q") / 7), "s", F.col("v"), "sum", True), ["k"], ["q"], F.floor(F.col("q") / 7), "m", F.col("v"), "max", False).collect()}
    for k, q, _ in rows:
        before = [v for kk, qq, v in rows if kk == k and qq < q]
        own = [v for kk, qq, v in rows if kk == k and qq <= q]
        assert got[q] == (sum(own), max(before, default=None))


def test_hot_keys_are_joined_on_the_map_side(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    big = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(200)] + [(None, 999)], "k string, i long")
    small = spark.createDataFrame([("hot", 100, "H"), ("k2", 1, "C"), ("gone", 70, "G")], "k string, n long, v string")
    got = {r.i: r.v for r in hot_split_join(big, small, ["k"], "n", ["v"], "i").collect()}
    assert got == {**{i: "H" for i in range(1, 200, 2)}, 2: "C"}
    assert hot_split_join(big, small, ["k"], "n", ["v"], "i", inner=False).count() == 201


def test_intermediate_folders_are_released(spark):
    from trapflow.sources.shared import fresh_folder, materialize, newest_json, release, swap_json

    folder = fresh_folder(spark, "t")
    df = materialize(spark.range(5), "t")
    assert swap_json(spark, folder, 1, {"a": 1}) and not swap_json(spark, folder, 1, {"a": 2}) and newest_json(spark, folder) == (1, {"a": 1})
    assert df.count() == 5
    release(spark)
    assert newest_json(spark, folder) == (0, None)
