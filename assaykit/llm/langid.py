"""Language identification by compression.

One zstandard raw-content dictionary is kept for each language. A text is normalised,
cut into chunks, and each chunk is encoded with every language's dictionary; the language
whose encodings are smallest in sum is the answer. Chunks keep the dictionary at work along a
long text, which else would soon be encoded from its own beginning. Where the best and the second
language are within ``reject_margin`` of one another, the answer is marked as rejected.

Results for odd input: a null text, or one without a letter (a numeral like a half isn't one), is ``und`` with score 0 and is rejected.
Equal sizes go to the language that comes first by name, with score 0 (rejected). An empty table
gives an empty result. With no labelled row to learn from, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDETERMINED = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")
RESULT = "lang_pred string, score double, rejected boolean, margin_bytes long"


@dataclass(frozen=True)
class LangIdParams:
    """dictionary_bytes and sample_rows bound what is learned from: the dictionary of a language is
    the first dictionary_bytes of the normalised texts of at most sample_rows distinct texts, those with
    the smallest hashes, of which each adds at most document_bytes. Of more than max_languages values of lang, those with the most
    distinct texts are learned; so all dictionaries together stay below max_languages * dictionary_bytes."""

    dictionary_bytes: int = 262_144
    sample_rows: int = 400
    document_bytes: int = 8_192
    max_languages: int = 256
    level: int = 5
    chunk_bytes: int = 1_024
    reject_margin: float = 0.004
    seed: int = 7


def normalised(text: str) -> bytes:
    """Lower-case letters, one space for each run of anything else."""
    return (" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, params: LangIdParams = LangIdParams()) -> dict[str, bytes]:
    """Dictionary content of each language from rows (text, lang) of ``docs``.

    The sample is bounded before any row moves: the number of distinct texts of a language, estimated from their hashes, gives a hash
    threshold that leaves about four times sample_rows of each, and a per-language limit keeps the rest exact. Copies count once
    throughout, so a language of many copies of few texts is learned as well."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(params.seed), "text").alias("h"))
    distinct = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    counts = {r["lang"]: max(1, r["n"]) for r in distinct.orderBy(F.desc("n"), "lang").limit(params.max_languages).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * params.sample_rows / n)))])
    small = rows.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.try_element_at(share, F.col("lang")))
    # Copies are merged before they move: a text of many copies doesn't fill a task.
    small = small.groupBy("lang", "h").agg(F.min(F.substring("text", 1, params.document_bytes)).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = small.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= params.sample_rows).drop("k").collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        parts = [normalised(r["text"])[: params.document_bytes] for r in sorted(sample, key=lambda r: (r["h"], r["text"])) if r["lang"] == lang]
        content = b"".join(dict.fromkeys(parts))[: params.dictionary_bytes]
        if len(content) >= 8:
            out[lang] = content
    return out


class Classifier:
    """Compressors with prepared dictionaries; made once in each Python worker."""

    _made: dict[tuple, "Classifier"] = {}

    def __init__(self, contents: dict[str, bytes], params: LangIdParams):
        self.params = params
        settings = zstandard.ZstdCompressionParameters.from_level(params.level, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.by_lang = []
        for lang in sorted(contents):
            shared = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=settings)
            self.by_lang.append((lang, zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)))

    @classmethod
    def of(cls, contents: dict[str, bytes], params: LangIdParams) -> "Classifier":
        key = (params, tuple((k, hash(v)) for k, v in sorted(contents.items())))
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(contents, params)
        return cls._made[key]

    def classify(self, text: str | None) -> tuple[str, float, bool, int]:
        if not text or not self.by_lang:
            return UNDETERMINED, 0.0, True, 0
        data = normalised(text)
        if len(data) <= 2:
            return UNDETERMINED, 0.0, True, 0
        step = self.params.chunk_bytes
        chunks = [data[i : i + step] for i in range(0, len(data), step)]
        sizes = sorted((sum(len(x) for x in map(c.compress, chunks)), lang) for lang, c in self.by_lang)
        best, lang = sizes[0]
        second = sizes[1][0] if len(sizes) > 1 else best
        score = 1.0 - best / second if second else 0.0
        return lang, score, len(sizes) > 1 and score < self.params.reject_margin, second - best


def classify(text: Column, contents: dict[str, bytes], params: LangIdParams = LangIdParams()) -> Column:
    """struct(lang_pred, score, rejected, margin_bytes) of a text column. The dictionaries are
    dictionary_bytes for each language at most, and travel in the function's closure."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        model = Classifier.of(contents, params)
        return pd.DataFrame([model.classify(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score", "rejected", "margin_bytes"])

    return run(text)


def identify(docs: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, margin_bytes of every row of ``docs``
    (doc_id, text, lang). Only rows that aren't held out are learned from."""
    rows = docs.select("doc_id", "text", "lang")
    contents = learn(rows.filter(~held_out(F.col("doc_id"))), params)
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), classify(F.col("text"), contents, params).alias("c"))
    return out.select("doc_id", "held_out", "c.*")


def keep_identified(docs: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language isn't rejected."""
    contents = learn(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))), params)
    return docs.filter(~classify(docs["text"], contents, params)["rejected"])
