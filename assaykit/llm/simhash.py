"""SimHash near-duplicates found by covering the fingerprints with anchor points.

A 64-bit fingerprint is split into two halves. Of two fingerprints that differ in at most 4 bits, one half
differs in at most 2. The anchors of a half are the codewords of the [31, 26] Hamming code over its
first 31 bits, a perfect covering code: every word is within radius R = 1 of exactly one anchor.

Two halves x, y with at most t = 2 differing bits have a midpoint within t/2 = 1 of both, and the anchor that
covers the midpoint is within R + t/2 = 2 of both. So each half is replicated to every anchor within 2:
its own and 15 others, 32 copies of a fingerprint in all, dealt over 2 * 2^26 anchors. Replication to
R + t = 3 (``radius``) finds the same pairs with about ten times the copies.

Only distinct fingerprints are replicated, so copies cost nothing. Fingerprints that meet at an anchor are
compared there, each with those not yet linked only: a linked fingerprint leaves the rest, so a dense group of near copies
costs about one pass for each link, not all its pairs. What leaves an anchor is a tree over each linked set, whose nodes
have at most 33 neighbours; no pair is lost to the components, and none is emitted twice over.

Odd input: a null text has no word, as an empty one; texts without words have fingerprint zero and link like any other.
A text of fewer words than a shingle is one shingle. Equal rows are linked. A null doc_id comes after all others,
and is returned as component_id (null) only where no row of the component has an id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from operator import xor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import fresh, lookup, written
from assaykit.llm.components import components

BITS = 64
THRESHOLD = 4
WORDS = 4
SEED = 42
_BLOCK = 1 << 15
_FAN = 32
RADIUS = 2


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    set_in = np.zeros(BITS, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, _BLOCK):
        h = np.fromiter(hashes, dtype="<u8", count=min(_BLOCK, n - start))
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column, as a signed long of the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t if isinstance(t, str) else None, words) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(out.view(np.int64))

    return run(text)


def _syndromes(x: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the bits set in each word's first 31 bits; 0 for codewords."""
    s = np.zeros(len(x), dtype=np.uint32)
    for k in range(5):
        check = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        s |= (np.bitwise_count(x & check).astype(np.uint32) & np.uint32(1)) << np.uint32(k)
    return s


def _masks(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, what a word is XORed with to reach its anchors within ``radius``, and which columns hold one: flipping positions
    whose numbers XOR to the syndrome gives a codeword."""
    own: list[list[int]] = [[] for _ in range(32)]
    for n in range(radius + 1):
        for positions in combinations(range(1, 32), n):
            own[reduce(xor, positions, 0)].append(sum(1 << (p - 1) for p in positions))
    masks, used = np.zeros((32, max(map(len, own))), dtype=np.uint32), np.zeros((32, max(map(len, own))), dtype=bool)
    for s, row in enumerate(own):
        masks[s, : len(row)], used[s, : len(row)] = row, True
    return masks, used


def anchors(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fps) of every copy: the anchor is the codeword, with the half's number in bit 32."""
    masks, used = _masks(radius)
    keys, who = [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        s = _syndromes(x)
        ok = used[s]
        keys.append((x[:, None] ^ masks[s])[ok].astype(np.int64) | (half << 32))
        who.append(np.repeat(np.arange(len(fps)), ok.sum(axis=1)))
    return np.concatenate(keys), np.concatenate(who)


def linked_sets(fps: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """The sets of two or more of the distinct fingerprints that are connected by links of at most ``threshold`` bits."""
    rest, out = fps, []
    while len(rest) > 1:
        members, frontier, rest = [rest[:1]], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= threshold
            if near.any():
                members.append(rest[near])
                frontier.extend(rest[near])
                rest = rest[~near]
        found = np.concatenate(members)
        if len(found) > 1:
            out.append(found)
    return out


def tree(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members, each joined to at most _FAN + 1 others."""
    m = np.sort(members)
    child = np.arange(1, len(m))
    return m[child], m[(child - 1) // _FAN]


def _replicate(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, who = anchors(fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[who].view(np.int64))], names=["anchor", "fp"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; one anchor's fingerprints (8 bytes each) are held at a time."""
    held_key, held = None, []

    def edges(run: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        fps = np.concatenate(run).view(np.uint64)
        return [tree(s.view(np.int64)) for s in linked_sets(fps)] if len(fps) > 1 else []

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, dtype=np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if held_key is not None and key[0] != held_key:
            found += edges(held)
            held = []
        if len(starts) == 1:
            held.append(fp)
        else:
            found += edges([*held, fp[: ends[0]]])
            # runs of one row hold no pair
            for i in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                found += edges([fp[starts[i] : ends[i]]])
            held = [fp[starts[-1] :]]
        held_key = key[-1]
        if found:
            yield batch_of(found)
    if held:
        yield batch_of(edges(held))


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) whose components are those of all links."""
    copies = distinct.select("fp").mapInArrow(_replicate(radius), "anchor long, fp long")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long").distinct()


def _identity(docs: DataFrame) -> Column:
    """What tells the rows of ``docs`` apart, in their order: whether the id is null, the id, a hash of the text. No part is null."""
    return F.struct(docs["doc_id"].isNull().alias("no_id"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, own, keep of every row of ``docs`` (doc_id, text).
    own is the row's identity, keep that of the one row of the component that stays."""
    rows = docs.select("doc_id", _identity(docs).alias("own"), fingerprints(docs["text"], words).alias("fp"))
    rows = written(rows, "fingerprints")
    by_fp = written(rows.groupBy("fp").agg(F.min("own").alias("first"), F.count("*").alias("n_copies")), "distinct")
    n, n_fps = rows.count(), by_fp.count()
    links = written(link_fingerprints(by_fp, radius), "links")
    roots = components(links)
    rooted = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "first", "n_copies", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("n_fps"))
    classes = lookup(rooted, "root", firsts, "keep", "n_fps", n_fps, F.col("fp")).select("fp", "keep", "n_copies")
    out = lookup(rows, "fp", classes, "keep", "n_copies", n, F.col("own"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(~F.col("keep.no_id"), F.col("keep.id")).alias("component_id"), "own", "keep")


def keep_one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with all its columns, one row of each component: the one with the smallest doc_id."""
    keep, own, n, row = fresh(docs, "keep", "own", "n", "row")
    stays = near_duplicates(docs, words).filter("own = keep").groupBy(F.col("keep").alias(keep)).agg(F.count("*").alias(n))
    keepers = written(stays, "keepers")
    every = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.withColumn(own, _identity(docs)).join(keepers, F.col(own) == F.col(keep))
    if (keepers.agg(F.max(n)).first()[0] or 0) < 2:
        return both.select(*every)
    # repeated rows share id and text: one of them stays. Each task merges its own before they move; the others don't move again
    order = F.xxhash64(*[c for c, (_, kind) in zip(every, docs.dtypes) if "map<" not in kind and kind != "variant"])
    merged = both.filter(F.col(n) > 1).groupBy(own).agg(F.min_by(F.struct(*every), order).alias(row)).select(f"{row}.*")
    return both.filter(F.col(n) == 1).select(*every).union(merged)
