"""Hierarchical packing of documents into sequences of several context sizes.

A document's ids (with the end id) are cut into full windows; what is left, its remainder, stays whole if it can. A
remainder is routed to the shortest tier that holds it, each tier is packed, and the gaps of long windows are filled
with remainders from shorter tiers, the longest that fits first. A window of a shorter tier stays at its tier
only if it is exactly full. Where gaps are left when the short remainders have run out, remainders of the
windows with the largest gaps are cut at half a window: the head is a full sequence of the next tier, the tail fills gaps.

How many remainders there are of each length is all that the plan needs: at most one count for each length
below the window, on the driver, however large the corpus. The plan names, for each length, ranges of ranks and the
sequences they go to; rows get their rank within their length without meeting in one task (``common.ranked``) and
look their sequence up. Texts and ids are never shuffled.

Sequences are dealt to step groups tier by tier in turn, so groups differ by at most one sequence of a tier.

Odd input: a null or empty text is the end id alone. Repeated rows and null ids are packed like others. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import buckets_for, ranked, unit_hash, written
from assaykit.llm.tokens import Encoder

WHOLE, HEAD, TAIL = 0, 1, 2


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str
    window: int = 1024
    tiers: tuple[int, ...] = (1024, 512, 256, 128)
    end_id: int = 0
    step_tokens: int = 1 << 19


@dataclass
class Lot:
    """``count`` remainders of ``length`` ids with ranks from ``rank`` on, or their heads or tails."""

    length: int
    rank: int
    count: int
    part: int = WHOLE
    half: int = 0

    @property
    def size(self) -> int:
        return {WHOLE: self.length, HEAD: self.half, TAIL: self.length - self.half}[self.part]

    def split(self, n: int) -> tuple["Lot", "Lot"]:
        return Lot(self.length, self.rank, n, self.part, self.half), Lot(self.length, self.rank + n, self.count - n, self.part, self.half)


@dataclass
class Group:
    """``count`` windows of one tier, each with the next row of every lot."""

    tier: int
    count: int
    lots: list[Lot] = field(default_factory=list)

    @property
    def gap(self) -> int:
        return self.tier - sum(x.size for x in self.lots)

    def split(self, n: int) -> tuple["Group", "Group"]:
        pairs = [x.split(n) for x in self.lots]
        return Group(self.tier, n, [a for a, _ in pairs]), Group(self.tier, self.count - n, [b for _, b in pairs])


class Pool:
    """Lots by size."""

    def __init__(self) -> None:
        self.lots: dict[int, list[Lot]] = defaultdict(list)

    def add(self, lot: Lot) -> None:
        self.lots[lot.size].append(lot)

    def best(self, most: int) -> int:
        """The largest size up to ``most`` that is there; 0 if there is none."""
        return max((k for k, v in self.lots.items() if v and k <= most), default=0)

    def take(self, size: int, most: int) -> Lot:
        lot = self.lots[size].pop()
        if lot.count > most:
            lot, rest = lot.split(most)
            self.lots[size].append(rest)
        return lot

    def fill(self, group: Group) -> list[Group]:
        """Fills the gaps of a group's windows, which may split it; those that stay open have a gap that nothing fits."""
        done, work = [], [group]
        while work:
            g = work.pop()
            size = self.best(g.gap) if g.gap else 0
            if not size:
                done.append(g)
                continue
            lot = self.take(size, g.count)
            if lot.count < g.count:
                g, rest = g.split(lot.count)
                work.append(rest)
            g.lots.append(lot)
            work.append(g)
        return done

    def windows(self, tier: int, least: int) -> Iterator[Group]:
        """Windows opened with each size from the tier's down to ``least``, filled one after the other."""
        for size in range(tier, least - 1, -1):
            while self.lots.get(size):
                lot = self.lots[size].pop()
                yield from self.fill(Group(tier, lot.count, [lot]))


def plan(counts: dict[int, int], window: int, tiers: tuple[int, ...]) -> list[Group]:
    """Groups of windows that hold ``counts`` remainders of each length up to ``window``."""
    pool, out = Pool(), []
    for length, n in sorted(counts.items()):
        if n:
            pool.add(Lot(length, 0, n))
    opened: list[Group] = []
    for tier in sorted(tiers, reverse=True):
        packed = list(pool.windows(tier, tier // 2 + 1))
        for g in packed:
            if not g.gap:
                out.append(g)
            elif tier == window:
                opened.append(g)
            else:  # a short window that isn't full is of no use at its tier
                for lot in g.lots:
                    pool.add(lot)
    opened += pool.windows(window, 1)
    # What is open now lacks short pieces: cut some of the longest remainders to get them.
    half = window // 2
    while opened:
        opened = [h for g in opened for h in pool.fill(g)]
        out += [g for g in opened if not g.gap]
        opened = sorted((g for g in opened if g.gap), key=lambda g: -g.gap)
        at = next((i for i, g in enumerate(opened) if any(x.part == WHOLE and x.size > half for x in g.lots)), None)
        if at is None or sum(g.count for g in opened) < 2:
            break
        g = opened.pop(at)
        if g.count > 1:
            g, rest = g.split((g.count + 1) // 2)
            opened.append(rest)
        for lot in g.lots:
            if lot.part == WHOLE and lot.size > half:
                out.append(Group(half, lot.count, [Lot(lot.length, lot.rank, lot.count, HEAD, half)]))
                pool.add(Lot(lot.length, lot.rank, lot.count, TAIL, half))
            else:
                pool.add(lot)
    out += opened
    out += pool.windows(window, 1)
    return out


def _pieces(docs: DataFrame, p: PackingParams) -> DataFrame:
    """A row for each full window and remainder of each document: where it starts, its length, the checksum of its ids, and
    of head and tail should it be cut."""
    names = ["doc_id", "start", "length", "ids_crc32", "head_crc32", "tail_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, w, half = Encoder.of(p.tokenizer), np.array([p.end_id], "<u4").tobytes(), p.window, p.window // 2
        for batch in batches:
            names_left = iter(batch.column(0).to_pylist())
            for lengths, ids in encoder.encode_many(batch.column(1)):
                rows: list[tuple] = []
                data, at = memoryview(ids.tobytes()), 0
                for length in lengths.tolist():
                    doc_id, own, n = next(names_left), data[4 * at : 4 * (at + length)], length + 1
                    at += length
                    for start in range(0, n, w):
                        part = own[4 * start : 4 * (start + w)]
                        if start + w >= n:
                            part = bytes(part) + end
                        head = tail = 0
                        if half < len(part) // 4 < w:
                            head, tail = zlib.crc32(part[: 4 * half]), zlib.crc32(part[4 * half :])
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), head, tail, n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, params: PackingParams) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group of each piece of ``docs`` (doc_id, text)."""
    pieces = written(_pieces(docs, params), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to the window
    groups = sorted(plan(counts, params.window, params.tiers), key=lambda g: -g.tier)
    n_steps = max(1, -(-sum(g.tier * g.count for g in groups) // params.step_tokens))
    # (part, length, first rank) -> first sequence, offset, tier, place of the first sequence in its tier
    entries, first, in_tier = [], 0, defaultdict(int)
    for g in groups:
        offset = 0
        for lot in g.lots:
            entries.append((lot.part, lot.length, lot.rank, first, offset, g.tier, in_tier[g.tier]))
            offset += lot.size
        first += g.count
        in_tier[g.tier] += g.count
    # ranks of cut rows are covered twice, by their heads and by their tails
    tables = {}
    for part in (WHOLE, HEAD, TAIL):
        own = sorted(x[1:] for x in entries if x[0] == part)
        tables[part] = np.array(own, dtype=np.int64).reshape(-1, 6)
    if not counts:
        counts = {params.window: 0}
    dealt = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k).cast("long"), F.lit(buckets_for(n)))])
    rows = pieces.withColumn("u", unit_hash("doc_id", "start", "ids_crc32"))
    rows = rows.withColumn("bucket", F.floor(F.col("u") * dealt[F.col("length")]))
    rows = ranked(rows, "length", "bucket", ["u", "doc_id", "start", "ids_crc32"], "rank", "n_length")

    half = params.window // 2
    fields = ("part", "sequence_id", "offset", "tier", "step_group")
    kinds = pa.struct([pa.field(k, pa.int64()) for k in fields])

    def at(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last entry of each length that begins at or before the rank, and where it begins; -1 if there is none."""
        if not len(table):
            return np.zeros(len(rank), dtype=np.int64), np.full(len(rank), -1)
        i = np.searchsorted(table[:, 0] << 45 | table[:, 1], length << 45 | rank, "right") - 1
        i = np.maximum(i, 0)
        return i, np.where((table[i, 0] == length) & (table[i, 1] <= rank), table[i, 1], -1)

    @F.arrow_udf(f"array<struct<{', '.join(f'{k}: long' for k in fields)}>>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = (x.to_numpy(zero_copy_only=False) for x in (length, rank))
        spots = [at(tables[part], n, r) for part in (WHOLE, HEAD, TAIL)]
        # the entry that begins last, of uncut and cut ones, is the one that holds this rank
        whole = spots[WHOLE][1] > np.maximum(spots[HEAD][1], spots[TAIL][1])
        ends = np.cumsum(np.where(whole, 1, 2))
        out = np.empty((int(ends[-1]) if len(ends) else 0, len(fields)), dtype=np.int64)
        for part, (i, begins) in enumerate(spots):
            own = np.flatnonzero(whole == (part == WHOLE))
            to = ends[own] - (2 if part == HEAD else 1)
            _, _, seq0, offset, tier, place0 = tables[part][i[own]].T if len(own) else np.empty((6, 0), dtype=np.int64)
            move = r[own] - begins[own]
            out[to] = np.stack([np.full(len(own), part), seq0 + move, offset, tier, (place0 + move) % n_steps], axis=1)
        flat = pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(fields))], fields=list(kinds))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)

    placed = rows.select("*", F.explode(place("length", "rank")).alias("p"))
    part = F.col("p.part")
    return placed.select(
        "doc_id",
        (F.col("start") + F.when(part == TAIL, half).otherwise(0)).alias("start"),
        F.when(part == HEAD, half).when(part == TAIL, F.col("length") - half).otherwise(F.col("length")).cast("long").alias("length"),
        F.when(part == HEAD, F.col("head_crc32")).when(part == TAIL, F.col("tail_crc32")).otherwise(F.col("ids_crc32")).alias("ids_crc32"),
        "doc_tokens",
        "p.sequence_id",
        "p.offset",
        F.col("p.tier").cast("int").alias("tier"),
        F.col("p.step_group").cast("long").alias("step_group"),
    )
