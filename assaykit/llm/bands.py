"""Quality rules by compression bands.

A text's zstandard ratio (bytes / encoded bytes) is taken over the whole document and over chunks
of fixed size. Text that encodes far better than prose of its length is repetitive, text that hardly
encodes at all is noise; both limits depend on the length, as the ratio of prose grows with it, and come from texts that are known to be good.
Chunks find what the whole hides: a long document half of which lies in chunks out of their band. What is left after the last full
chunk is a chunk as well, with the limits of its own length.

Beside the verdict stand plain counts of words, symbols, repeated lines and repeated word windows.

Odd input: a null or empty text has no word, so all counts are 0 and the base rule fails it; its
ratios are null. Texts under ``Limits`` lengths have no compression verdict against them. Equal rows have equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYMBOLS = re.compile(r"[#*$%&|<>]")
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share_out double, reason string"


# Bytes from, lowest and highest ratio, of the texts of sf0.1 that are labelled good and that the base rule leaves (3243), by half octaves of
# their length; from 32 KB on, where such texts are too few, the highest goes on rising by 0.1 an octave, as it does below.
GOOD_TEXTS = (
    (256, 1.38, 1.67),
    (362, 1.42, 1.85),
    (512, 1.47, 1.87),
    (724, 1.59, 1.98),
    (1_024, 1.73, 2.04),
    (1_448, 1.84, 2.15),
    (2_048, 1.92, 2.16),
    (2_896, 2.00, 2.22),
    (4_096, 2.12, 2.29),
    (5_792, 2.15, 2.34),
    (8_192, 2.22, 2.38),
    (11_585, 2.26, 2.41),
    (16_384, 2.34, 2.44),
    (23_170, 2.37, 2.48),
    (32_768, 2.37, 2.55),
    (65_536, 2.37, 2.65),
    (131_072, 2.37, 2.75),
    (262_144, 2.37, 2.85),
    (524_288, 2.37, 2.95),
    (1_048_576, 2.37, 3.05),
)
# The same for their full chunks of 4 KB (808).
GOOD_CHUNKS = (2.07, 2.26)


def limits_of(length: int, lowest: float, highest: float) -> tuple[float, float]:
    """The lowest ratio of good texts divided by 1.2, but 1.4 at most, as scripts of three bytes a letter encode less well and noise stays below
    (random base64 in words of 60 has 1.27 to 1.33 from 1.5 KB on); the highest times 1.05, or 1.1 below 1 KB, where ratios scatter more."""
    return min(1.4, lowest / 1.2), highest * (1.1 if length < 1_024 else 1.05)


@dataclass(frozen=True)
class BandLimits:
    """whole: (bytes from, least ratio, greatest ratio), the last row whose length is reached counts.
    chunk: the same for one full chunk; a shorter last one has the limits of a whole text of its length. max_share_out: share of
    a text's bytes that may lie in chunks out of their band."""

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 1e9), *((n, *limits_of(n, lo, hi)) for n, lo, hi in GOOD_TEXTS))
    chunk_bytes: int = 4_096
    chunk: tuple[float, float] = limits_of(4_096, *GOOD_CHUNKS)
    max_share_out: float = 0.5
    level: int = 3


def _ratio(encoder: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(data) / max(1, len(encoder.compress(data)))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    # code points of the words: all bytes but UTF-8's continuation bytes, without the white space
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = len(_SYMBOLS.findall(text))
    seen: set[bytes] = set()
    n_dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            n_dup += line in seen
            seen.add(line)
    n = len(words)
    n_repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        again = {w for w, k in Counter(windows).items() if k > 1} if len(set(windows)) < len(windows) else ()
        if again:
            reach = 0
            for i, w in enumerate(windows):
                if w in again:
                    n_repeat += i + 3 - max(i, reach)
                    reach = i + 3
    return n, word_chars, n_symbols, n_dup, n_repeat


def band(length: int, limits: BandLimits) -> tuple[float, float]:
    return [(lo, hi) for start, lo, hi in limits.whole if length >= start][-1]


def verdict(text: str, encoder: zstandard.ZstdCompressor, limits: BandLimits) -> tuple[float | None, float | None, str | None]:
    """ratio, share of the bytes in chunks out of band (null: the text is one chunk), and why the text is rejected (null: it isn't)."""
    data = text.encode("utf-8", "replace")
    if not data:
        return None, None, None
    whole = _ratio(encoder, data)
    step = limits.chunk_bytes
    high = low = 0
    for i in range(0, len(data), step) if len(data) > step else ():
        part = data[i : i + step]
        lo, hi = limits.chunk if len(part) == step else band(len(part), limits)
        ratio = _ratio(encoder, part)
        high += len(part) * (ratio > hi)
        low += len(part) * (ratio < lo)
    share = (high + low) / len(data) if len(data) > step else None
    least, most = band(len(data), limits)
    if whole > most:
        return whole, share, "whole repetitive"
    if whole < least:
        return whole, share, "whole incompressible"
    if share is not None and share > limits.max_share_out:
        return whole, share, "chunks repetitive" if high >= low else "chunks incompressible"
    return whole, share, None


def judge(text: Column, limits: BandLimits = BandLimits()) -> Column:
    """struct with the counts, base_failed, kept, ratios and reason of a text column."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        encoder = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
        rows = []
        for t in texts:
            t = t if isinstance(t, str) else ""
            n, chars, symbols, dup, repeat = counts(t)
            failed = n < 50 or 100 * repeat > 50 * n
            ratio, share, reason = verdict(t, encoder, limits)
            rows.append((n, chars, symbols, dup, repeat, failed, not failed and reason is None, ratio, share, reason))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return run(text)


def quality(docs: DataFrame, limits: BandLimits = BandLimits()) -> DataFrame:
    """doc_id and what ``judge`` says of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", judge(F.col("text"), limits).alias("q")).select("doc_id", "q.*")
