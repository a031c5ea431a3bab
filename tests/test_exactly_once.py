"""Messages delivered more than once: whole tables, several deliveries, long chains, hot keys."""

import datetime as dt
import random

import pytest

from conftest import DATA
from trapflow.operators import exactly_once, skew, windows_from_first
from trapflow.operators.exactly_once import SeenStore
from trapflow.plans import traps
from trapflow.sources.shared import fresh_folder

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(o, i, None if s is None else T0 + dt.timedelta(seconds=s), q, 1, "b") for o, i, s, q in rows], "src string, rid long, at timestamp, seq long, code int, kept string")


def brute(rows, window=900):
    groups = {}
    for o, i, s, q in rows:
        if o is not None and i and s is not None and q is not None:
            groups.setdefault((o, i), []).append((s, q))
    out = set()
    for g in groups.values():
        g.sort()
        while g:
            own = [x for x in g if x[0] <= g[0][0] + window]
            kept = min(q for _, q in own)
            out |= {(kept, q) for _, q in own if q != kept}
            g = g[len(own) :]
    return out


def some(seed, n=500):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b"]), r.choice([1, 1, 2, 3, 40 + q]), r.choice([r.uniform(0, 30000), q * 60]), q) for q in range(n)]
    return rows + [(None, 1, 1, 9001), ("a", None, 1, 9002), ("a", 0, 1, 9003), ("a", 1, None, 9004), ("a", 1, 1, None), ("", 1, 1, 9005)]


def found(store, df):
    return {tuple(r) for r in store.deliver(df, "src", "rid", "at", "seq").extra.collect()}


@pytest.mark.parametrize(("seed", "small"), [(1, 2000), (2, 5)])
def test_one_delivery(spark, seed, small, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(windows_from_first, "SMALL", small)
    rows = some(seed)
    assert found(SeenStore(spark, fresh_folder(spark, "t")), frame(spark, rows)) == brute(rows)


def test_edges_of_the_window(spark):
    rows = [("a", 1, 0, 5), ("a", 1, 900, 4), ("a", 1, 900.000001, 9), ("a", 1, 1800, 7), ("a", 1, 1801, 8)]
    assert found(SeenStore(spark, fresh_folder(spark, "t")), frame(spark, rows)) == {(4, 5), (7, 9)}


def test_several_deliveries_agree_with_one(spark):
    rows = [("a", i % 7 + 1, 3000.0 * (i // 14) + 10 * (i % 14), i) for i in range(120)]
    store = SeenStore(spark, fresh_folder(spark, "t"), shards=3)
    got = set()
    for k in range(0, 120, 30):
        got |= found(store, frame(spark, rows[k : k + 30]))
    assert got == brute(rows)
    codes = [(r.shard, r.code) for r in store.dictionary().where("fresh").collect()]
    assert len(codes) == len(set(codes)) and {c for _, c in codes} <= set(range(max(c for _, c in codes) + 1))
    bits = sum(bin(b).count("1") for r in store.seen().collect() for b in r.bits)
    assert bits == len(codes)


def test_a_repeated_batch_adds_nothing(spark):
    rows = [("a", 5, 0, 1), ("b", 5, 0, 2)]
    store = SeenStore(spark, fresh_folder(spark, "t"))
    assert found(store, frame(spark, rows)) == set()
    assert found(store, frame(spark, [("a", 5, 10, 3), ("b", 6, 10, 4)])) == {(1, 3)}


def test_an_interrupted_delivery_leaves_no_trace(spark, monkeypatch):
    store = SeenStore(spark, fresh_folder(spark, "t"))
    found(store, frame(spark, [("a", 5, 0, 1)]))
    monkeypatch.setattr("trapflow.operators.exactly_once.swap_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        found(store, frame(spark, [("a", 6, 0, 2)]))
    monkeypatch.undo()
    assert store.dictionary().count() == 1
    assert found(store, frame(spark, [("a", 6, 5, 3)])) == set()


def test_empty(spark):
    assert found(SeenStore(spark, fresh_folder(spark, "t")), frame(spark, [])) == set()


@pytest.mark.parametrize("seed", [5, 6])
def test_late_rows_move_windows_as_in_one_delivery(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.choice([1, 2]), r.uniform(0, 9000), q) for q in range(60)]
    store, now = SeenStore(spark, fresh_folder(spark, "t"), shards=2), {}
    for k in range(0, 60, 20):
        d = store.deliver(frame(spark, rows[k : k + 20]), "src", "rid", "at", "seq")
        now |= {q: False for q in range(k, k + 20)} | {r.order_extra: True for r in d.extra.collect()}
        now |= {r.order: not r.kept for r in d.changed.collect()}
    want = brute(rows)
    assert {tuple(r) for r in store.pairs().collect()} == want
    assert {q for q, extra in now.items() if extra} == {q for _, q in want}
    store.compact()
    assert {tuple(r) for r in store.pairs().collect()} == want


def test_two_writers_give_what_one_gives(spark, monkeypatch):
    folder, rows = fresh_folder(spark, "t"), [("a", i % 5 + 1, 3000.0 * i, i) for i in range(20)]
    one, other = SeenStore(spark, folder, shards=2), SeenStore(spark, folder, shards=2)
    swap, raced = exactly_once.swap_json, []

    def late(*args):
        if not raced:
            raced.append(None)
            raced[0] = other.deliver(frame(spark, rows[5:]), "src", "rid", "at", "seq").kept.count()
        return swap(*args)

    monkeypatch.setattr(exactly_once, "swap_json", late)
    kept = one.deliver(frame(spark, [(o, i, s + 1, q + 100) for o, i, s, q in rows]), "src", "rid", "at", "seq").kept.count()
    assert raced == [15] and kept == 5
    codes = [(r.shard, r.code) for r in one.dictionary().collect()]
    assert len(codes) == len(set(codes)) == sum(bin(b).count("1") for r in one.seen().collect() for b in r.bits) == 20


def test_the_query_tests_bits(spark, monkeypatch):
    tested, bit = [], exactly_once._bit
    monkeypatch.setattr(exactly_once, "_bit", lambda *a: tested.append(1) or bit(*a))
    store, arrivals, kept, _ = traps.deliveries(spark, DATA)
    assert len(tested) == traps.DELIVERIES - 1
    chosen = [(r.shard, r.code) for part in kept for r in part.collect()]
    assert len(chosen) == len(set(chosen)) == store.dictionary().count() and len(chosen) < arrivals.count()
    assert all(part.count() for part in kept)


def test_codes_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exactly_once, "PIECE", 7)
    store = SeenStore(spark, fresh_folder(spark, "t"), shards=2)
    found(store, frame(spark, [("a", q + 1, 0, q) for q in range(100)]))
    codes = sorted((r.shard, r.code) for r in store.dictionary().collect())
    assert codes == [(s, c) for s in (0, 1) for c in range(sum(x == s for x, _ in codes))]
