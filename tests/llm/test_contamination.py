"""Leaked items, against brute force."""

import random
import time

import pytest

from trapflow.llm import contamination
from trapflow.llm.contamination import MASKS, PASSAGE, build_index, covered, find_leaks, leaked
from trapflow.llm.words import words

VOCABULARY = [f"w{k}" for k in range(60)]


def brute(doc, item, share):
    best = {}
    for i in range(len(doc) - PASSAGE + 1):
        for j in range(len(item) - PASSAGE + 1):
            if doc[i : i + PASSAGE] == item[j : j + PASSAGE]:
                fresh = max((v for (a, b), v in best.items() if a + PASSAGE <= i and b + PASSAGE <= j), default=0) + PASSAGE
                best[i, j] = max(fresh, best[i - 1, j - 1] + 1 if (i - 1, j - 1) in best else 0)
    return max(best.values(), default=0) >= share * len(item)


def brute_changed(doc, item, share, changed):
    """The same with windows in which ``changed`` words may differ, if a hit of a mask is near on their diagonal."""
    near = contamination.radius(changed)
    hits = {(i + k, j + k) for k in range(-near, near + 1) for i in range(len(doc) - PASSAGE + 1) for j in range(len(item) - PASSAGE + 1) for m in MASKS if all(doc[i + a] == item[j + a] for a in m)}
    best = {}
    for i in range(len(doc) - PASSAGE + 1):
        for j in range(len(item) - PASSAGE + 1):
            if (i, j) in hits and sum(a != b for a, b in zip(doc[i : i + PASSAGE], item[j : j + PASSAGE], strict=True)) <= changed:
                fresh = max((v for (a, b), v in best.items() if a + PASSAGE <= i and b + PASSAGE <= j), default=0) + PASSAGE
                best[i, j] = max(fresh, best[i - 1, j - 1] + 1 if (i - 1, j - 1) in best else 0)
    return max(best.values(), default=0) >= share * len(item)


def some(seed):
    r = random.Random(seed)
    opening = r.choices(VOCABULARY, k=9)
    items = [(k, " ".join((opening if k % 2 else []) + r.choices(VOCABULARY, k=r.randint(5, 40)))) for k in range(20)]
    docs = []
    for d in range(120):
        text = r.choices(VOCABULARY, k=r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].split()
            s = r.randrange(len(w))
            piece = w[s : s + r.randint(4, 30)]
            if r.random() < 0.3:
                piece[r.randrange(len(piece))] = "changed"
            text += piece + r.choices(VOCABULARY, k=r.randint(0, 3))
        docs.append((d, " ".join(text)))
    return docs, items


@pytest.mark.parametrize("seed", range(5))
def test_against_brute_force(seed):
    docs, items = some(seed)
    got = {(docs[d][0], i) for d, i in leaked(build_index(items), [contamination.Hasher()(words(t)) for _, t in docs], 0.5)}
    assert got == {(d, i) for d, t in docs for i, x in items if brute(words(t), words(x), 0.5)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("changed", [1, 2])
@pytest.mark.parametrize("common", [16, 1])
def test_changed_words_against_brute_force(seed, changed, common, monkeypatch):
    monkeypatch.setattr(contamination, "COMMON", common)
    monkeypatch.setattr(contamination, "PAIRS_AT_ONCE", 50)
    docs, items = some(seed)
    docs = docs[:40]
    hashed, index = [contamination.Hasher()(words(t)) for _, t in docs], build_index(items)
    got = {(docs[d][0], i) for d, i in leaked(index, hashed, 0.5, changed)}
    want = {(d, i) for d, t in docs for i, x in items if brute_changed(words(t), words(x), 0.5, changed)}
    assert got == want
    exact = {(docs[d][0], i) for d, i in leaked(index, hashed, 0.5, changed, exact=True)}
    assert exact == {(docs[d][0], i) for d, i in leaked(index, hashed, 0.5)} and exact < got


def test_a_changed_word_in_each_stretch_is_found():
    r = random.Random(8)
    items = [(k, " ".join(f"v{r.randrange(5000)}" for _ in range(40))) for k in range(50)]
    docs = []
    for _, t in items:
        w = t.split()
        for at in range(r.randrange(7), len(w), 7):
            w[at] = "changed"
        docs.append(contamination.Hasher()([f"x{r.randrange(5000)}" for _ in range(50)] + w))
    index = build_index(items)
    assert leaked(index, docs, 0.5) == []
    assert len({(d, i) for d, i in leaked(index, docs, 0.5, changed=2) if d == i}) >= 45  # recall of 0.9


def test_a_shared_opening_costs_no_pairs():
    r = random.Random(9)
    opening = [f"o{k}" for k in range(11)]
    items = [(k, " ".join(opening + [f"u{k}x{i}" for i in range(r.randint(12, 40))])) for k in range(800)]
    document = contamination.Hasher()(opening * 790 + words(items[17][1]) + opening)
    index, began = build_index(items), time.monotonic()
    assert leaked(index, [document], 0.5, 1, exact=True) == [(0, 17)]
    assert time.monotonic() - began < 2


def test_no_mask_is_longer_than_a_passage():
    assert all(m[0] == 0 and m[-1] < PASSAGE and list(m) == sorted(set(m)) for m in MASKS)


def test_masks_see_over_a_changed_word():
    item = [f"a{k}" for k in range(PASSAGE)]
    index = build_index([(1, " ".join(item))])
    import numpy as np

    for at in (1, 2, 5):
        changed = [*item[:at], "zzz", *item[at + 1 :]]
        hits = contamination.candidates(index, np.array(contamination.Hasher()(changed), dtype=np.uint64))
        assert bool(len(hits)) == any(at not in m for m in MASKS)


def test_order_and_overlap():
    assert covered([(0, 0), (1, 1), (20, 9)], 100) == 17
    assert covered([(0, 9), (20, 0)], 100) == 8
    assert covered([(0, 0), (4, 4)], 100) == 8
    assert covered([], 1) == 0


def test_table(spark, monkeypatch):
    item = " ".join(f"Word{k}" for k in range(20))
    docs = [(1, f"intro “{item.upper()}” outro".replace(" ", " ,\n")), (2, item[:50]), (3, None), (4, ""), (5, "x " * 100_000 + item), (6, item), (6, item), (7, " ".join(reversed(item.split())))]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, body string, item_id string")
    items = spark.createDataFrame([(10, item), (11, "too short to leak"), (12, None), (None, item), (13, "")], "item_id long, body string")
    want = sorted([(1, 10), (5, 10), (6, 10), (6, 10)])
    assert sorted(tuple(r) for r in find_leaks(df, "doc_id", "body", items, "item_id", "body", reader=lambda t: t).collect()) == want
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 5)
    assert sorted(tuple(r) for r in find_leaks(df, "doc_id", "body", items, "item_id", "body", reader=lambda t: t).collect()) == want
    assert find_leaks(df, "doc_id", "body", items.where("false"), "item_id", "body").count() == 0
    assert find_leaks(df.where("false"), "doc_id", "body", items, "item_id", "body").count() == 0
