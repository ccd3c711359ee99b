"""Token files compressed by a Re-Pair grammar.

Documents are dealt into shards by ranges of doc_id, as many as ``shard_bytes`` of text ask for, and written in ascending order. A shard is a run of blocks, each with its own
grammar: again and again, the most frequent pairs of neighbouring symbols are replaced by nonterminals, until no pair
occurs ``min_count`` times or symbols run out (``rounds``, where given, ends it sooner). One round replaces many pairs at once, chosen by
falling frequency so that no symbol stands first in one and second in another: then no two occurrences overlap (but for those of
a symbol twice, which are taken from the left), and the result is the same as replacing them one after the other. Pairs don't reach over the end of a document.

A block stores its rules, the length each nonterminal expands to, and where each document's symbols begin, so a document, or a
stretch of one, is decoded without the rest (``decode``). Blocks are rows of Spark's text writer, which ends each by a
newline byte, part of the format; so any file system works, and a task that is run again replaces its file.

Block (little-endian): ``RPG2``, then unsigned 32-bit: checksum of all that follows to before the newline, its
length, documents, how many of them have a null id (they come first), rules, symbols, ids, first nonterminal, bytes of a symbol; signed
64-bit: shard, ids of the shard before the block; arrays: doc_id (i64), first symbol (u32) and ids (u32) of each document; left and right (u32) and
expansion length (u32) of each rule; symbols (u16 or u32); newline.

Odd input: a null or empty text is the end id alone. Rows with a null id come first, before any id. Rows that share an id are ordered by a hash of the
text; equal rows are stored each. A very long text is one document of a block of its own. An empty table writes no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import running_total, scratch, written
from assaykit.llm.tokens import Encoder

_MAGIC = b"RPG2"
_HEAD = "<7I2q"


@dataclass(frozen=True)
class RePairParams:
    tokenizer: str
    end_id: int = 2
    block_ids: int = 1 << 20
    shard_bytes: int = 24 << 20
    rounds: int | None = None
    rules_a_round: int = 4096  # at most 32767
    min_count: int = 8


@dataclass
class Grammar:
    """symbols of all documents in turn; nonterminal base + i stands for left[i], right[i], and for length[i] ids."""

    base: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    symbols: np.ndarray
    first: np.ndarray


def _choose(pairs: np.ndarray, counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Of pairs by falling count, those whose first symbol isn't a chosen second one, and the other way round; a pair of
    one symbol twice has that symbol to itself."""
    order = np.lexsort((pairs, -counts))[: 4 * most]
    ranked = pairs[order]
    firsts, seconds, out = set(), set(), []
    for k, (a, b) in enumerate(zip((ranked >> width).tolist(), (ranked & ((1 << width) - 1)).tolist())):
        if a not in seconds and b not in firsts and (a != b or (a not in firsts and b not in seconds)):
            firsts.add(a)
            seconds.add(b)
            out.append(k)
            if len(out) == most:
                break
    return np.sort(ranked[out])


_SLOT_BITS = 18


def _slot(key: np.ndarray) -> np.ndarray:
    """Where a pair stands in the table of chosen pairs: the high bits of a product."""
    if key.dtype == np.uint32:
        return key * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS)
    return key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)


def _slots(chosen: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen pairs that have a slot to themselves, and what pair and which of them each slot holds. A pair without a slot isn't
    replaced in this round."""
    _, first = np.unique(_slot(chosen), return_index=True)
    kept = chosen[np.sort(first)]
    held, which = np.full(1 << _SLOT_BITS, none, dtype=chosen.dtype), np.zeros(1 << _SLOT_BITS, dtype=np.int32)
    held[_slot(kept)], which[_slot(kept)] = kept, np.arange(len(kept))
    return kept, held, which


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, p: RePairParams) -> Grammar:
    """The grammar of documents of the given lengths, whose ids (all below ``base``) follow one another."""
    narrow = base < (1 << 16) - 1
    width, kind = (16, np.uint32) if narrow else (32, np.uint64)
    none = kind((1 << 2 * width) - 1)  # no pair: the last symbol of this width isn't used
    limit = (1 << width) - 1 - base
    s = ids.astype(kind)
    ends = np.cumsum(lengths)  # past the last symbol of each document
    lefts, rights, sizes = [], [], [np.ones(base, dtype=np.int64)]
    made = 0
    while len(s) > 1 and made < limit and (p.rounds is None or len(lefts) < p.rounds):
        key = s[:-1] << kind(width)
        key |= s[1:]
        key[ends[:-1] - 1] = none
        ranked = np.sort(key)
        cut = np.flatnonzero(ranked[1:] != ranked[:-1])
        first, n = ranked[np.concatenate([[0], cut + 1])], np.diff(np.concatenate([[-1], cut, [len(ranked) - 1]]))
        often = (n >= p.min_count) & (first != none)
        chosen = _choose(first[often], n[often], width, min(p.rules_a_round, limit - made))
        if not len(chosen):
            break
        chosen, held, which = _slots(chosen, none)
        a, b = (chosen >> kind(width)).astype(np.int64), (chosen & kind((1 << width) - 1)).astype(np.int64)
        slot = _slot(key)
        at = np.flatnonzero((held[slot] == key) & (key != none))
        rule = which[slot[at]]
        if (a == b).any():
            # only pairs of one symbol twice can overlap: in a run of them, every other one is replaced
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            odd = (at - np.repeat(at[begins], np.diff(np.append(begins, len(at))))) & 1 == 1
            at, rule = at[~odd], rule[~odd]
        s[at] = (base + made + rule).astype(kind)
        keep = np.ones(len(s), dtype=bool)
        keep[at + 1] = False
        s = s[keep]
        ends = ends - np.searchsorted(at + 1, ends, "left")
        known = np.concatenate(sizes)
        lefts.append(a)
        rights.append(b)
        sizes.append(known[a] + known[b])
        made += len(chosen)
    empty = np.empty(0, dtype=np.int64)
    return Grammar(base, *(np.concatenate(x) if x else empty for x in (lefts, rights, sizes[1:])), s, np.concatenate([[0], ends[:-1]]) if len(ends) else empty)


def expansions(g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What every symbol stands for in one array, ids first; where each symbol's part begins in it, and how long it is. Rules that only
    use symbols known before are expanded at once."""
    begins = np.concatenate([np.arange(g.base), g.base + np.cumsum(g.length) - g.length]).astype(np.int32)
    sizes = np.concatenate([np.ones(g.base, dtype=np.int32), g.length.astype(np.int32)])
    out = np.empty(g.base + int(g.length.sum()), dtype=np.uint32)
    out[: g.base] = np.arange(g.base)
    needs = np.maximum.accumulate(np.maximum(g.left, g.right)) if len(g.left) else g.left
    done = 0
    while done < len(g.left):
        upto = int(np.searchsorted(needs, g.base + done, "left"))
        both = np.stack([g.left[done:upto], g.right[done:upto]], axis=1).ravel()
        begin = int(begins[g.base + done])
        part = expand(both, g, (out, begins, sizes))
        out[begin : begin + len(part)] = part
        done = upto
    return out, begins, sizes


def expand(symbols: np.ndarray, g: Grammar, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids that symbols stand for: one run of the table for each, all gathered at once."""
    if not len(symbols):
        return np.empty(0, dtype=np.uint32)
    flat, begins, sizes = table
    n, run = sizes[symbols], begins[symbols]
    ends = np.cumsum(n)
    # steps from each id's place in the table to the next one's: 1 within a run
    step = np.ones(int(ends[-1]), dtype=np.int32)
    step[0] = run[0]
    step[ends[:-1]] = run[1:] - (run[:-1] + n[:-1] - 1)
    return flat[np.cumsum(step, dtype=np.int32)]


def to_block(g: Grammar, doc_ids: np.ndarray, n_null: int, lengths: np.ndarray, shard: int, before: int) -> bytes:
    small = g.base + len(g.left) <= 1 << 16
    body = b"".join(
        [doc_ids.astype("<i8").tobytes(), g.first.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), g.left.astype("<u4").tobytes(), g.right.astype("<u4").tobytes(), g.length.astype("<u4").tobytes(), g.symbols.astype("<u2" if small else "<u4").tobytes()]
    )
    rest = struct.pack(_HEAD, len(doc_ids), n_null, len(g.left), len(g.symbols), int(lengths.sum()), g.base, 2 if small else 4, shard, before) + body
    return _MAGIC + struct.pack("<2I", zlib.crc32(rest), len(rest)) + rest


@dataclass
class Block:
    shard: int
    before: int
    doc_ids: np.ndarray
    n_null: int
    lengths: np.ndarray
    grammar: Grammar

    def __post_init__(self) -> None:
        self.table = expansions(self.grammar)

    def _symbols(self, k: int) -> np.ndarray:
        first = self.grammar.first
        return self.grammar.symbols[first[k] : first[k + 1] if k + 1 < len(first) else len(self.grammar.symbols)]

    def decode(self, k: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids of document k, or ``length`` of them from ``start``: only the symbols that hold them are expanded."""
        s, g = self._symbols(k), self.grammar
        rule = s.astype(np.int64) - g.base
        n = np.ones(len(s), dtype=np.int64)
        n[rule >= 0] = g.length[rule[rule >= 0]]
        ends = np.cumsum(n)
        stop = int(ends[-1]) if length is None else min(int(ends[-1]), start + length)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[lo - 1]) if lo else 0)
        return expand(s[lo:hi], g, self.table)[skip : skip + max(0, stop - start)]

    def ids(self) -> np.ndarray:
        return expand(self.grammar.symbols, self.grammar, self.table)


def read_blocks(data: bytes) -> Iterator[Block]:
    """The blocks of a file; a wrong checksum or length raises ValueError."""
    at = 0
    while at < len(data):
        if len(data) < at + 12 or data[at : at + 4] != _MAGIC:
            raise ValueError(f"no block at byte {at}")
        crc, n = struct.unpack_from("<2I", data, at + 4)
        body = memoryview(data)[at + 12 : at + 12 + n]
        if len(body) != n or zlib.crc32(body) != crc or data[at + 12 + n : at + 13 + n] != b"\n":
            raise ValueError(f"block at byte {at} is damaged")
        docs, n_null, rules, symbols, total, base, width, shard, before = struct.unpack_from(_HEAD, body)
        pos = struct.calcsize(_HEAD)

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(body, dtype=kind, count=count, offset=pos)
            pos += out.nbytes
            return out

        doc_ids, first, lengths = take(docs, "<i8"), take(docs, "<u4").astype(np.int64), take(docs, "<u4").astype(np.int64)
        left, right, length = (take(rules, "<u4").astype(np.int64) for _ in range(3))
        yield Block(shard, before, doc_ids, n_null, lengths, Grammar(base, left, right, length, take(symbols, f"<u{width}"), first))
        at += 13 + n


def write(docs: DataFrame, path: str, p: RePairParams) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to files under ``path``, in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(p.tokenizer)
        base = encoder.whole.get_vocab_size()
        shard, before = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal held, before
            lengths = np.concatenate(sizes)
            doc_ids = np.array([0 if x is None else x for x in names], dtype=np.int64)
            out = to_block(compress(np.concatenate(parts), lengths, base, p), doc_ids, names.count(None), lengths, shard, before)
            before += held
            held = 0
            parts.clear()
            sizes.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["block"])

        for batch in batches:
            left = batch.column(0).to_pylist()
            for lengths, ids in encoder.encode_many(batch.column(1), p.end_id):
                done = 0
                ends = np.cumsum(lengths)
                while done < len(lengths):
                    # as many documents as the block still takes, one at least if it is empty
                    room = p.block_ids - held + (int(ends[done - 1]) if done else 0)
                    upto = int(np.searchsorted(ends, room, "right"))
                    if upto <= done:
                        if held:
                            yield block()
                            continue
                        upto = done + 1
                    a, b = int(ends[done - 1]) if done else 0, int(ends[upto - 1])
                    parts.append(ids[a:b])
                    sizes.append(lengths[done:upto])
                    names += left[:upto - done]
                    del left[:upto - done]
                    held += b - a
                    done = upto
        if held:
            yield block()

    slim = docs.select("doc_id", "text")
    total = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = slim.repartitionByRange(max(1, -(-total // p.shard_bytes)), *order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, in_shard (ids of the shard before it), n_tokens, ids_crc32 of each document in the files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for block in read_blocks(content.as_py()):
                    ids, ends = block.ids().astype("<u4").tobytes(), np.cumsum(block.lengths)
                    starts = ends - block.lengths
                    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(block.doc_ids)
                    names = pa.array(block.doc_ids, mask=np.arange(n) < block.n_null)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.shard)), names, pa.array(block.before + starts), pa.array(block.lengths), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, p: RePairParams) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of each of ``docs``, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    write(docs, path, p)
    rows = written(read(spark, path), "token-rows")
    shards = rows.groupBy("shard").agg(F.max(F.col("in_shard") + F.col("n_tokens")).alias("n"))
    before = running_total(shards, "shard", "n", "before").drop("n")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard")
