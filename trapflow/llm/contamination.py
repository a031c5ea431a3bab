"""Evaluation texts inside training texts, found by spaced seeds.

A seed is a window of ``PASSAGE`` words hashed at the positions a fixed mask keeps; the words it
skips may differ. Hashes of the items and of the documents are joined on the map side (the items of
a block are few and counted before they are sent). Around the hits the words themselves are laid side
by side, and passages are the stretches in which no window has more than a given number of changed
words.

Seeds that many items share (an opening, a phrase) are not expanded to all these items: where they
could not make up the asked share of an item by themselves, a leak of it has a rarer seed as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapflow.llm.mail import mail_text
from trapflow.llm.words import words
from trapflow.sources.shared import materialize

#: Words of the shortest passage that counts.
PASSAGE = 8
#: Positions that each mask keeps. No mask is longer than a passage, so each passage gives hits.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 7), (0, 1, 2, 4, 5, 7))
#: Words of items that are sent to the executors at once (8 bytes and three seeds each). More items
#: are searched block by block.
BLOCK_WORDS = 2_000_000
#: Words of documents searched in one go.
BATCH_WORDS = 400_000
_CACHE_WORDS = 500_000
#: A seed at more places of a block's items than this is a common one.
COMMON = 16
#: Pairs of positions that are held at once.
PAIRS_AT_ONCE = 4_000_000


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text_words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in text_words]
        except KeyError:
            if len(known) > _CACHE_WORDS:
                known.clear()
            for w in text_words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return [known[w] for w in text_words]


def seeds(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Seed of the window at each position of ``hashes`` (uint64), for windows that fit."""
    n = max(0, len(hashes) - PASSAGE + 1)
    total = np.full(n, number + 1, dtype=np.uint64)
    for at in mask:
        total = (total * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[at : at + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        total ^= total >> np.uint64(29)
    return total


@dataclass
class Index:
    """Items of a block: their word hashes, end to end, their seeds by place, and the seeds sorted with their places."""

    ids: list[int]
    starts: np.ndarray
    hashes: np.ndarray
    seeds: list[np.ndarray]
    keys: list[np.ndarray]
    places: list[np.ndarray]


def build_index(items: list[tuple[int, str]]) -> Index:
    hasher = Hasher()
    each = [np.array(hasher(words(t)), dtype=np.uint64) for _, t in items]
    starts = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    hashes = np.concatenate([*each, np.zeros(0, dtype=np.uint64)])
    inside = np.zeros(max(0, len(hashes) - PASSAGE + 1), dtype=bool)
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        inside[s : max(s, e - PASSAGE + 1)] = True
    at = np.flatnonzero(inside)
    every = [seeds(hashes, mask, k) for k, mask in enumerate(MASKS)]
    orders = [np.argsort(got[at], kind="stable") for got in every]
    return Index([i for i, _ in items], starts, hashes, every, [got[at][o] for got, o in zip(every, orders, strict=True)], [at[o] for o in orders])


@dataclass
class Rare:
    """What of an index is looked up first, for one share: all seeds of the items that common seeds could
    leak by themselves, and of the others the rare seeds, with the words that common ones may add."""

    need: np.ndarray
    added: np.ndarray
    keys: list[np.ndarray]
    places: list[np.ndarray]


def radius(changed: int) -> int:
    """How far from a hit, in words along its diagonal, a window may lie. With one changed word no more than
    two windows in a row are seen by no mask, so that is as far as a passage can go on beyond its hits."""
    return (0, 2)[changed] if changed < 2 else PASSAGE - 1


def _spread(owners: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, changed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted (owner, place): each owner's first row, and the words that windows around its hits cover
    at most. ``starts`` and ``ends`` are those of the place's item."""
    if not len(owners):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, np.diff(owners) != 0))
    lo, hi = np.maximum(places - radius(changed), starts), np.minimum(places + PASSAGE + radius(changed), ends)
    before = np.append(0, hi[:-1])
    before[first] = 0
    return first, np.add.reduceat(hi - np.maximum(lo, before), first)


def rare_seeds(index: Index, share: float, changed: int) -> Rare:
    sizes = np.diff(index.starts)
    need = np.ceil(share * sizes).astype(np.int64)
    common = []
    for keys in index.keys:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(first, len(keys)))
        common.append(np.repeat(counts > COMMON, counts))
    hot = np.unique(np.concatenate([p[c] for p, c in zip(index.places, common, strict=True)]))
    owner = np.searchsorted(index.starts, hot, side="right") - 1
    first, reach = _spread(owner, hot, index.starts[owner], index.starts[owner + 1], changed)
    added = np.zeros(len(sizes), dtype=np.int64)
    added[owner[first]] = reach
    alone = added >= need
    take = [~c | alone[np.searchsorted(index.starts, p, side="right") - 1] for p, c in zip(index.places, common, strict=True)]
    return Rare(need, np.where(alone, 0, added), [k[t] for k, t in zip(index.keys, take, strict=True)], [p[t] for p, t in zip(index.places, take, strict=True)])


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of n each, end to end."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _hits(keys: list[np.ndarray], places: list[np.ndarray], got: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """(position, place) where a seed of ``got`` (those of the positions ``at``) is one of ``keys``; unique and sorted."""
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for k, mine in enumerate(got):
        lo = np.searchsorted(keys[k], mine, side="left")
        n = np.searchsorted(keys[k], mine, side="right") - lo
        pairs.append(np.stack([np.repeat(at, n), places[k][_expand(lo, n)]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


def candidates(index: Index, document: np.ndarray) -> np.ndarray:
    """(document position, item place) of windows that hit under any mask; rows unique and sorted."""
    got = [seeds(document, mask, k) for k, mask in enumerate(MASKS)]
    return _hits(index.keys, index.places, got, np.arange(len(got[0])))


def covered(windows: list[tuple[int, int]], enough: int) -> int:
    """Most words of an item in passages that follow its order; counting ends at ``enough``.

    ``windows``: (document, item) positions, sorted, where PASSAGE words are equal. A passage is a
    chain of windows one word apart; passages overlap neither in the document nor in the item.
    """
    best: list[tuple[int, int]] = []  # (item end, words), both rising: passages that end early enough
    waiting: list[tuple[int, int, int]] = []  # (document end, item end, words)
    done, most = 0, 0
    open_runs: dict[int, int] = {}
    row: dict[int, int] = {}
    now = -1

    def before(end: int) -> int:
        lo, hi = 0, len(best)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if best[mid][0] <= end else (lo, mid)
        return best[lo - 1][1] if lo else 0

    def settle(end: int, n: int) -> None:
        if before(end) >= n:
            return
        keep = [x for x in best if x[0] < end or x[1] > n]
        best[:] = sorted([*keep, (end, n)])

    for i, j in windows:
        if i != now:
            open_runs, row = (row if now == i - 1 else {}), {}
            now = i
            while done < len(waiting) and waiting[done][0] <= i:
                settle(*waiting[done][1:])
                done += 1
        n = max(before(j) + PASSAGE, open_runs.get(j - 1, -1) + 1)
        row[j] = n
        waiting.append((i + PASSAGE, j + PASSAGE, n))
        most = max(most, n)
        if most >= enough:
            return most
    return most


def _suspects(index: Index, rare: Rare, got: list[np.ndarray], at: np.ndarray, doc: np.ndarray, changed: int) -> np.ndarray:
    """(document, item) whose hits could reach the item's share, whatever their order.

    A seed that a document repeats counts once, so a document has at most as many hits as the index.
    """
    once = []
    for k, mine in enumerate(got):
        lo = np.searchsorted(rare.keys[k], mine, side="left")
        n = np.searchsorted(rare.keys[k], mine, side="right") - lo
        once.append(np.unique(np.stack([doc, lo, n], axis=1)[n > 0], axis=0))
    pairs = np.zeros(int(doc.max(initial=-1)) + 1, dtype=np.int64)
    for rows in once:
        np.add.at(pairs, rows[:, 0], rows[:, 2])
    # Documents in turns of so many pairs; one document alone has no more than the index.
    turns = (np.cumsum(pairs) - pairs) // PAIRS_AT_ONCE
    out = [np.zeros((0, 2), dtype=np.int64)]
    for turn in np.unique(turns[pairs > 0]):
        first, last = np.searchsorted(turns, turn), np.searchsorted(turns, turn, side="right")
        found = []
        for k, rows in enumerate(once):
            d, lo, n = rows[np.searchsorted(rows[:, 0], first) : np.searchsorted(rows[:, 0], last)].T
            found.append(np.stack([np.repeat(d, n), rare.places[k][_expand(lo, n)]], axis=1))
        out.append(_likely(index, rare, np.unique(np.concatenate(found), axis=0), changed))
    return np.concatenate(out)


def _likely(index: Index, rare: Rare, pairs: np.ndarray, changed: int) -> np.ndarray:
    item = np.searchsorted(index.starts, pairs[:, 1], side="right") - 1
    first, reach = _spread(pairs[:, 0] * len(index.ids) + item, pairs[:, 1], index.starts[item], index.starts[item + 1], changed)
    enough = reach + rare.added[item[first]] >= rare.need[item[first]]
    return np.stack([pairs[first, 0], item[first]], axis=1)[enough]


def _windows(text: np.ndarray, end: int, item: np.ndarray, hits: np.ndarray, changed: int) -> np.ndarray:
    """(document position, item position) of windows with at most ``changed`` changed words that lie no more
    than ``radius`` words from a hit of their diagonal, sorted. ``text`` up to ``end`` is the document's."""
    if not changed:
        return _exact(hits, text, item)
    out = [np.zeros((0, 2), dtype=np.int64)]
    last, near = len(item) - PASSAGE + 1, radius(changed)
    diagonals, which = np.unique(hits[:, 0] - hits[:, 1], return_inverse=True)
    step = max(1, PAIRS_AT_ONCE // len(item))
    for cut in range(0, len(diagonals), step):
        mine = diagonals[cut : cut + step]
        at = mine[:, None] + np.arange(len(item))[None, :]
        inside = (at >= 0) & (at < end)
        equal = inside & (text[np.where(inside, at, 0)] == item[None, :])
        same = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
        around = np.zeros((len(mine), last + 1 + near), dtype=np.int32)
        own = (which >= cut) & (which < cut + step)
        np.add.at(around, (which[own] - cut, np.maximum(hits[own, 1] - near, 0)), 1)
        np.add.at(around, (which[own] - cut, hits[own, 1] + near + 1), -1)
        fits = (np.cumsum(around, axis=1)[:, :last] > 0) & inside[:, :last] & inside[:, PASSAGE - 1 :]
        d, j = np.nonzero(fits & (same[:, PASSAGE:] - same[:, :-PASSAGE] >= PASSAGE - changed))
        out.append(np.stack([mine[d] + j, j], axis=1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _exact(windows: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
    for k in range(PASSAGE):
        windows = windows[text[windows[:, 0] + k] == item[windows[:, 1] + k]]
    return windows


def leaked(index: Index, documents: list[list[int]], share: float, changed: int = 0, exact: bool = False, rare: Rare | None = None) -> list[tuple[int, int]]:
    """(number of the document, item) where the document holds at least ``share`` of the item's words
    in passages with at most ``changed`` changed words in each window; ``exact``: and also in passages
    without any."""
    rare = rare or rare_seeds(index, share, changed)
    gap = [0] * PASSAGE
    flat: list[int] = []
    starts = []
    for d in documents:
        starts.append(len(flat))
        flat += d
        flat += gap
    text, begins = np.array(flat, dtype=np.uint64), np.array(starts, dtype=np.int64)
    got = [seeds(text, mask, k) for k, mask in enumerate(MASKS)]
    known = np.zeros(len(got[0]), dtype=bool)
    for k, mine in enumerate(got):
        if len(index.keys[k]):
            known |= index.keys[k][np.minimum(np.searchsorted(index.keys[k], mine), len(index.keys[k]) - 1)] == mine
    at = np.flatnonzero(known)
    got = [mine[at] for mine in got]
    doc = np.searchsorted(begins, at, side="right") - 1
    out = []
    for d, x in _suspects(index, rare, got, at, doc, changed).tolist():
        lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
        a, b = index.starts[x], index.starts[x + 1]
        own = [s[a : b - PASSAGE + 1] for s in index.seeds]
        orders = [np.argsort(s, kind="stable") for s in own]
        hits = _hits([s[o] for s, o in zip(own, orders, strict=True)], orders, [g[lo:hi] for g in got], at[lo:hi] - begins[d])
        words_of, item, need = text[begins[d] : begins[d] + len(documents[d]) + PASSAGE], index.hashes[a:b], int(rare.need[x])
        windows = _windows(words_of, len(documents[d]), item, hits, changed)
        if _holds(windows, need) and (not exact or not changed or _holds(_exact(windows, words_of, item), need)):
            out.append((d, index.ids[x]))
    return out


def _holds(windows: np.ndarray, need: int) -> bool:
    """Whether passages of these windows cover ``need`` words, in order; too few windows can't."""
    return len(windows) * PASSAGE >= need and covered(list(map(tuple, windows.tolist())), need) >= need


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_WORDS words by their counted length (one longer item alone)."""
    sized = items.select(F.col(item_id).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").withColumn("n", F.size(F.split("t", r"\s+")))
    block, n = [], 0
    for r in sized.orderBy("id", "t").toLocalIterator():
        if block and n + r.n > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r.id, r.t))
        n += r.n
    if block:
        yield block


def find_leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, share: float = 0.5, reader: Callable[[str | None], str] = mail_text,
    changed: int = 0, exact: bool = False,
) -> DataFrame:
    """(doc_id, item_id) of documents that hold ``share`` of an item's words in passages.

    Passages are PASSAGE or more words side by side in the document and the item, in the item's order;
    of each PASSAGE of them at most ``changed`` may differ (``exact``: the share must then also be held
    by passages without a changed word). Case, punctuation and layout don't matter. ``reader`` gives a
    document's text. Items under PASSAGE words cannot leak; null and empty texts give no rows; of rows
    with one doc_id each is searched, and pairs are given once for each such row; other columns are
    ignored. If the items need more than one block, the documents are read and hashed once, and each
    block is searched over the hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null and text <> ''")
    blocks = _blocks(items, item_id, item_text)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    if following is None:
        return _search(texts, block, share, changed, exact, reader)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hashes": [np.array(hasher(words(reader(t))), dtype=np.uint64).view(np.int64) for t in pdf["text"]]})

    rows = materialize(texts.mapInPandas(hashed, "doc_id bigint, hashes array<bigint>"), "words")
    found = None
    while block is not None:
        part = materialize(_search(rows, block, share, changed, exact, None), "leaks")
        found = part if found is None else found.unionByName(part)
        block, following = following, next(blocks, None)
    return found


def _search(rows: DataFrame, block: list[tuple[int, str]], share: float, changed: int, exact: bool, reader: Callable[[str | None], str] | None) -> DataFrame:
    """Leaks of one block's items in documents (doc_id, text or hashes of words)."""
    built = build_index(block)
    index = rows.sparkSession.sparkContext.broadcast((built, rare_seeds(built, share, changed)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        items, rare = index.value
        for pdf in batches:
            out, ids, held, n = [], [], [], 0
            for d, t in zip(pdf["doc_id"], pdf["text"] if reader else pdf["hashes"], strict=True):
                ids.append(d)
                held.append(hasher(words(reader(t))) if reader else np.asarray(t, dtype=np.int64).view(np.uint64).tolist())
                n += len(held[-1])
                if n > BATCH_WORDS:
                    out += [(ids[k], x) for k, x in leaked(items, held, share, changed, exact, rare)]
                    ids, held, n = [], [], 0
            if held:
                out += [(ids[k], x) for k, x in leaked(items, held, share, changed, exact, rare)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return rows.mapInPandas(search, "doc_id bigint, item_id bigint")
