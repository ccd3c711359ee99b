"""Token ids of whole texts by a tokenizers file, fast enough for a corpus.

A byte-level BPE encodes each pre-token by itself. Texts are cut at spaces, Arrow numbers the distinct words of a
batch, and only those that weren't met before go to the library; ids are then gathered for all words at once. A text
for which cutting at spaces, or Python's character classes, might differ from the library's rules goes to it whole; so does
every text where the file's rules are of another kind.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
import struct
from collections.abc import Iterator
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
# Characters for which Python's \w, \d and \s say the same as \p{L}, \p{N} and \s of the library.
_OTHER = r"[^\n !-~¡-©«-¬®-±´¶-¸»¿-ÖØ-öø-ȳ‐–—‘-”…€]"
# White space on both sides of a space, or two spaces at the end, are one pre-token; cut at spaces they'd be two.
# Texts that hold none of _OTHER have no white space but spaces and newlines.
_WIDE = r"[\n ] [\n ]|  \z"
_LETTERS = re.compile(r"[^\W\d_]+")
_PRE_TOKENS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Bytes that the words and the pre-tokens kept in a worker may take, by a rough count of what Python objects need.
WORD_BYTES, PRE_TOKEN_BYTES = 40 << 20, 8 << 20
#: Bytes that an entry needs besides its key's characters and its ids: two objects' headers and a place in a dict.
_ENTRY_BYTES = 180
_id_of = attrgetter("id")


def _byte_table() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Store(dict):
    """Ids by word. Once they take ``most`` bytes all are forgotten, and those that are met again are encoded anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def put(self, key: str, ids: bytes) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = ids
        self.held += _ENTRY_BYTES + len(key) + len(ids)


class Encoder:
    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = rules.get("pre_tokenizer") or {}
        model = rules.get("model") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and rules.get("normalizer") is None
            and rules.get("post_processor") is None and rules.get("truncation") is None and rules.get("padding") is None
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        added = [x["content"] for x in rules.get("added_tokens", [])]
        self.odd = "|".join([_OTHER, _WIDE, *map(re.escape, added)])
        self.table = str.maketrans(_byte_table())
        self.space = " ".translate(self.table)
        self.tokenize = self.whole.model.tokenize
        self.pre_tokens, self.words = _Store(PRE_TOKEN_BYTES), _Store(WORD_BYTES)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _tokens(self, piece: str) -> list:
        return self.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.table))  # bytes as the model writes them

    def _pieces(self, runs: list[list[str]]) -> list[bytes]:
        """The ids of each run of pre-tokens."""
        every = list({piece for run in runs for piece in run})
        known = dict(zip(every, map(self.pre_tokens.get, every)))
        for piece, ids in known.items():
            if ids is None:
                known[piece] = ids = np.fromiter(map(_id_of, self._tokens(piece)), dtype="<u4").tobytes()
                self.pre_tokens.put(piece, ids)
        return [b"".join(map(known.__getitem__, run)) for run in runs]

    def encode(self, text: str) -> bytes:
        """The ids, without special tokens added, as little-endian unsigned 32-bit integers."""
        (_, ids), = self.encode_many(pa.array([text]))
        return ids.tobytes()

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(how many ids each text has, all ids) of a string array, a slice after the other; nulls are empty texts, and end_id
        ends each text if it is given."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            # lists of many small objects, none of which is in a cycle: the collector would go through them again and again
            collects = gc.isenabled()
            gc.disable()
            try:
                out = self._encode_slice(pc.fill_null(texts.slice(at, upto - at), ""), [] if end_id is None else [end_id])
            finally:
                if collects:
                    gc.enable()
            yield out
            at = upto
        pa.default_memory_pool().release_unused()

    def _encode_slice(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if self.by_word:
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), dtype=bool)
        if not odd.any():
            return self._by_word(texts, end)
        lengths, ids = self._by_word(texts.filter(pa.array(~odd)), end)
        parts = np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []
        out, own = [], iter(parts)
        for is_odd, text in zip(odd.tolist(), texts):
            out.append(np.array(self.whole.encode(text.as_py(), add_special_tokens=False).ids + end, dtype="<u4") if is_odd else next(own))
        return np.array([len(x) for x in out], dtype=np.int64), np.concatenate(out)

    def _ids_of_letters(self, words: list[str]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """For words of letters, each with a space before it, the ids that are kept; for the others all ids in turn, and how many each has."""
        known = list(map(self.words.get, words))
        flat: list[int] = []
        ends = []
        for word in [w for w, ids in zip(words, known) if ids is None]:
            flat.extend(map(_id_of, self.tokenize(self.space + word) if word.isascii() else self._tokens(" " + word)))
            ends.append(len(flat))
        return known, np.array(flat, dtype="<u4"), np.diff(np.array([0, *ends], dtype=np.int32))

    def _ids_of_words(self, words: pa.Array, counts: np.ndarray) -> "_Table":
        """The ids of distinct words, each with a space before it. Words that occur once in their slice aren't kept: most of
        them won't be met again soon."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, names))
        missing = np.array([k is None for k in known], dtype=bool)
        new = words.filter(pa.array(missing))
        lead, tail = (x.dictionary_encode() for x in _cut(new))
        leads, rest, n = self._ids_of_letters(lead.dictionary.to_numpy(zero_copy_only=False).tolist())
        tails = self._pieces([_PRE_TOKENS.findall(x) for x in tail.dictionary.to_pylist()])
        # a word is its lead, if it has one, and its tail; the last entry of parts has no ids
        parts = _table(leads, rest, n).joined(_table(tails)).joined(_table([b""]))
        at = np.empty(2 * len(new), dtype=np.int64)
        at[::2] = pc.fill_null(lead.indices, len(parts.n) - 1).to_numpy(zero_copy_only=False)
        at[1::2] = tail.indices.to_numpy(zero_copy_only=False) + len(leads)
        sizes, ids = gather(parts, at, np.arange(0, 2 * len(new) + 1, 2))
        ends, at_new = np.cumsum(sizes), np.cumsum(missing) - 1
        for i in np.flatnonzero(missing & (counts > 1)).tolist():
            k = at_new[i]
            self.words.put(names[i], ids[ends[k] - sizes[k] : ends[k]].tobytes())
        return _table(known, ids, sizes)

    def _by_word(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4")
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()
        words = split.flatten()
        # what stands before the first space has no space before it, so each text has a first word of its own
        firsts = self._pieces([_PRE_TOKENS.findall(w) for w in words.take(pa.array(bounds[:-1])).to_pylist()])
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).copy()
        table = self._ids_of_words(coded.dictionary, np.bincount(at, minlength=len(coded.dictionary)))
        at[bounds[:-1]] = len(table.n) + np.arange(len(firsts))
        if end:  # a last word for each text
            at = np.insert(at, bounds[1:], len(table.n) + len(firsts))
            bounds = bounds + np.arange(len(bounds))
            firsts.append(struct.pack("<I", *end))
        return gather(table.joined(_table(firsts)), at, bounds)


def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The letters that each word begins with (null: none) and what follows them; where there are none, the word with the space before it.
    Letters at a word's beginning are a pre-token, whatever follows."""
    lead = pc.utf8_rtrim(words, string.punctuation)
    simple = pc.utf8_is_alpha(lead).to_numpy(zero_copy_only=False)
    names, leads = (x.to_numpy(zero_copy_only=False).tolist() for x in (words, lead))
    tails = [name[len(x) :] for name, x in zip(names, leads)]
    for i in np.flatnonzero(~simple).tolist():
        m = _LETTERS.match(names[i])
        leads[i], tails[i] = (m[0], names[i][m.end() :]) if m else (None, " " + names[i])
    return pa.array(leads, pa.string()), pa.array(tails, pa.string())


class _Table(NamedTuple):
    """The ids of some words: word k has the n[k] ids from begin[k] on."""

    ids: np.ndarray
    begin: np.ndarray
    n: np.ndarray

    def joined(self, more: "_Table") -> "_Table":
        return _Table(np.concatenate([self.ids, more.ids]), np.concatenate([self.begin, len(self.ids) + more.begin]), np.concatenate([self.n, more.n]))


def _table(known: list[bytes | None], ids: np.ndarray = np.empty(0, dtype="<u4"), sizes: np.ndarray = np.empty(0, dtype=np.int32)) -> _Table:
    """Words with the ids given, or, for those that are null, with the next ``sizes`` of ``ids``."""
    parts = [k for k in known if k is not None]
    held = np.array([k is not None for k in known], dtype=bool)
    n = np.empty(len(known), dtype=np.int32)
    n[held] = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)) >> 2
    n[~held] = sizes
    begin = np.empty(len(known), dtype=np.int32)
    begin[~held] = np.cumsum(sizes) - sizes
    begin[held] = len(ids) + np.cumsum(n[held]) - n[held]
    return _Table(np.concatenate([ids, np.frombuffer(b"".join(parts), dtype="<u4")]), begin, n)


def gather(table: _Table, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each run of words between bounds has, and all ids in turn."""
    held = table.n[at]
    ends = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
    lengths = ends[bounds[1:]] - ends[bounds[:-1]]
    full = np.flatnonzero(held)  # words without ids, as an empty first one, take no step
    if not len(full):
        return lengths, np.empty(0, dtype="<u4")
    run, size, start = table.begin[at[full]], held[full], ends[full]
    # steps from each id's place in the table to the next one's: 1 within a word
    step = np.ones(int(ends[-1]), dtype=np.int32)
    step[0] = run[0]
    step[start[1:]] = run[1:] - (run[:-1] + size[:-1] - 1)
    np.cumsum(step, out=step)
    return lengths, table.ids[step]
