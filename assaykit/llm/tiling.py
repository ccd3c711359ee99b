"""Benchmark decontamination by greedy string tiling.

Texts are read as lower-case words. Seeds are runs of ``min_match`` words, hashed by a Karp-Rabin rolling
hash; a document and a benchmark item that share a seed are compared. A seed shared at two places that differ in the word before
begins a maximal match, whose length is found by prefix hashes; the longest match is marked, what it covers is taken from the others, and
so on until no unmarked match of min_match words is left. Only places where a match begins are ever listed, so a word repeated a
million times costs a million rows of numbers, not their product with an item's repeats.
Tiles don't overlap and may come in any order, so passages that were cut up and reordered are still
covered. An item is leaked where its tiles cover at least ``min_coverage`` of its words.

The benchmark is a stated query set: it is taken in blocks of at most ``block_bytes`` of text, and each block's seeds go
to the tasks that read the documents. So nothing that is broadcast grows past a block, the documents aren't shuffled, and
a benchmark of any size takes one pass for each block. Where there are several, each one's result is written before the next is
taken, so the driver never holds more than two.

Odd input: a null text has no word and leaks nothing; null or empty items, and items of fewer words than min_match, match
only as a whole run of all their words (an item without words never). Repeated items are reported each; repeated documents as well.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import written

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
LEAK = "item_id long, coverage double, n_tiles int, longest int, item_words int"


@dataclass(frozen=True)
class TilingParams:
    min_match: int = 5
    min_coverage: float = 0.5
    block_bytes: int = 8 << 20


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of every run of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return out


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 ... of n numbers each, in turn."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Prefixes:
    """Hashes, modulo 2^64, by which runs of ids at any places are compared."""

    _INVERSE = pow(int(_BASE), -1, 1 << 64)

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((ids + 1).astype(np.uint64) * _powers(len(ids), self._INVERSE), dtype=np.uint64)])
            self.powers = _powers(len(ids) + 1, int(_BASE))

    def runs(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.powers[at]


class Index:
    """The seeds of one block of items. Words that no item has are -1 and part of no seed."""

    _made: dict[int, "Index"] = {}
    #: Places where a match begins that are taken at once.
    _STEP = 1 << 18

    def __init__(self, items: list[tuple[int, str]], p: TilingParams):
        self.p, self.vocabulary, self.items = p, {}, []
        hashes, owners, places, befores = [], [], [], []
        for item_id, text in items:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
            k = min(p.min_match, len(ids))
            h = rolling(ids, k) ^ np.uint64(k)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            befores.append(np.concatenate([[-2], ids[: len(h) - 1]]))
            self.items.append((item_id, ids, k))
        none = np.empty(0, dtype=np.int64)
        joined = lambda x: np.concatenate(x) if x else none
        self.lengths = sorted({k for *_, k in self.items}, reverse=True)
        self.least = np.array([k for *_, k in self.items], dtype=np.int64)
        self.n_words = np.array([len(ids) for _, ids, _ in self.items], dtype=np.int64)
        self.begins = np.cumsum(self.n_words) - self.n_words
        self.prefixes = Prefixes(joined([ids for _, ids, _ in self.items]))
        # seeds by hash, then by the word before them (2 more than its id; 0: none, 1: a word that no item has)
        self.hashes, group = np.unique(joined(hashes).astype(np.uint64), return_inverse=True)
        self.span = len(self.vocabulary) + 2
        key = group * self.span + joined(befores) + 2
        order = np.argsort(key, kind="stable")
        self.keys, self.owner, self.place = key[order], joined(owners)[order], joined(places)[order]
        self.bounds = np.searchsorted(self.keys, np.arange(len(self.hashes) + 1) * self.span)
        # one bit for each value of a seed's low 20 bits: most runs of a document end here
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    @classmethod
    def of(cls, items: list[tuple[int, str]], p: TilingParams) -> "Index":
        key = hash((tuple(items), p))
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(items, p)
        return cls._made[key]

    def _matches(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (item, place in it, place in the text, words) of maximal matches."""
        prefixes = None
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        before = np.concatenate([[-1], ids[:-1]])
        for k in self.lengths:
            if len(ids) < k:
                continue
            at = np.flatnonzero(unknown[k:] == unknown[:-k])
            if not len(at):
                continue
            h = rolling(ids, k)[at] ^ np.uint64(k)
            ok = self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)]
            at, h = at[ok], h[ok]
            group = np.searchsorted(self.hashes, h)
            ok = self.hashes[np.minimum(group, len(self.hashes) - 1)] == h
            at, group = at[ok], group[ok]
            if not len(at):
                continue
            prefixes = prefixes or Prefixes(ids)
            # of the places of a seed, those with the same word before go on with a match that began earlier
            same = group * self.span + before[at] + 2
            lo, hi = self.bounds[group], self.bounds[group + 1]
            left, right = np.searchsorted(self.keys, same, "left"), np.searchsorted(self.keys, same, "right")
            n = (left - lo) + (hi - right)
            upto = np.cumsum(n)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + self._STEP, "right")))
                part = slice(begin, end)
                row = np.concatenate([_ranges(lo[part], (left - lo)[part]), _ranges(right[part], (hi - right)[part])])
                t = np.concatenate([np.repeat(at[part], (left - lo)[part]), np.repeat(at[part], (hi - right)[part])])
                own = self.least[self.owner[row]] == k
                row, t = row[own], t[own]
                owner, place = self.owner[row], self.place[row]
                words = self._common(owner, place, t, prefixes, len(ids))
                found = words >= k
                if found.any():
                    yield np.stack([owner[found], place[found], t[found], words[found]])
                begin = end

    def _common(self, owner: np.ndarray, place: np.ndarray, t: np.ndarray, text: Prefixes, n_text: int) -> np.ndarray:
        """How many words agree from each place of an item and of the text on, by halving."""
        at = self.begins[owner] + place
        low, high = np.zeros(len(t), dtype=np.int64), np.minimum(self.n_words[owner] - place, n_text - t)
        while (low < high).any():
            mid = (low + high + 1) // 2
            agree = self.prefixes.runs(at, mid) == text.runs(t, mid)
            low, high = np.where(agree, mid, low), np.where(agree, high, mid - 1)
        return low

    def leaks(self, text: str) -> list[tuple[int, float, int, int, int]]:
        get = self.vocabulary.get
        words = _WORD.findall(text.lower())
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        found = list(self._matches(ids))
        if not found:
            return []
        owner, p, t, n = np.concatenate(found, axis=1)
        found.clear()
        order = np.argsort(owner, kind="stable")
        owner, p, t, n = owner[order], p[order], t[order], n[order]
        out = []
        for own in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            item_id, item, k = self.items[int(owner[own[0]])]
            # a cheap bound first: what all matches together cover
            reach = np.zeros(len(item) + 1, dtype=np.int64)
            np.add.at(reach, p[own], 1)
            np.add.at(reach, p[own] + n[own], -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < self.p.min_coverage * len(item):
                continue
            tiles = tile(item, ids, p[own], t[own], n[own], k)
            covered = sum(n_words for *_, n_words in tiles)
            if covered >= self.p.min_coverage * len(item):
                out.append((item_id, round(covered / len(item), 6), len(tiles), max(n_words for *_, n_words in tiles), len(item)))
        return out


def tile(item: np.ndarray, text: np.ndarray, p: np.ndarray, t: np.ndarray, n: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal matches (p, t, n): (place in item, place in text, words) of each tile of k words or more. Of matches of
    one length the first in the item, then in the text, is marked first."""
    order = np.lexsort((t, p, -n))
    p, t, n = p[order], t[order], n[order]
    rest: list[tuple[int, int, int]] = []  # what is left of matches that others took a part of
    in_item, in_text = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    tiles, i = [], 0
    while i < len(n) or rest:
        if i < len(n) and (not rest or (-int(n[i]), int(p[i]), int(t[i])) <= rest[0]):
            size, a, b = int(n[i]), int(p[i]), int(t[i])
            i += 1
        else:
            size, a, b = heapq.heappop(rest)
            size = -size
        free = ~(in_item[a : a + size] | in_text[b : b + size]) & (item[a : a + size] == text[b : b + size])
        if free.all():
            in_item[a : a + size] = in_text[b : b + size] = True
            tiles.append((a, b, size))
            # matches for which the item has less than k words left are of no use
            left = np.concatenate([[0], np.cumsum(~in_item)])
            of_use = np.flatnonzero(left[p[i:] + n[i:]] - left[p[i:]] >= k) + i
            p, t, n, i = p[of_use], t[of_use], n[of_use], 0
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo >= k:
                heapq.heappush(rest, (lo - hi, a + lo, b + lo))
    return tiles


def blocks(benchmark: DataFrame, p: TilingParams) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), a block of bounded size at a time; the driver holds two blocks at most."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        size = len((r["text"] or "").encode("utf-8", "replace")) + 16
        if block and held + size > p.block_bytes:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"] or ""))
        held += size
    if block:
        yield block


def _scan(items: list[tuple[int, str]], p: TilingParams):
    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in LEAK.split(', '))}>>")
    def run(texts: pd.Series) -> pd.Series:
        index = Index.of(items, p)
        names = [x.split()[0] for x in LEAK.split(", ")]
        return pd.Series([[dict(zip(names, x)) for x in index.leaks(t)] if isinstance(t, str) else [] for t in texts], dtype=object)

    return run


def _with_more(parts: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each part, and whether another one follows."""
    part = next(parts, None)
    while part is not None:
        follows = next(parts, None)
        yield part, follows is not None
        part = follows


def leaks(docs: DataFrame, benchmark: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, item_words of every document (doc_id, text) and item it leaks."""
    rows, out = docs.select("doc_id", "text"), None
    for items, more in _with_more(blocks(benchmark, params)):
        found = rows.select("doc_id", F.explode(_scan(items, params)(F.col("text"))).alias("x")).select("doc_id", "x.*")
        if more or out is not None:
            found = written(found, "leaks")
        out = found if out is None else out.union(found)
    return rows.sparkSession.createDataFrame([], f"doc_id long, {LEAK}") if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item."""
    for items, more in _with_more(blocks(benchmark, params)):
        docs = docs.filter(F.size(_scan(items, params)(docs["text"])) == 0)
        docs = written(docs, "clean") if more else docs
    return docs
