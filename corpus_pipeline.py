"""The corpus pipeline: documents in, packed sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet and reads again as the next stage's documents. All stages but the last return the columns they were
given. A stage works on all rows that the one before kept; nothing is sampled or capped.

An empty table of documents gives an empty result at every stage. Columns beside those of documents, whatever their names, are kept by all
stages but the last. Very long texts are taken whole. What each stage does with nulls, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import langid, packing, pii, simhash, tiling
from assaykit.llm.common import read_table, written
from assaykit.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter (so null and empty texts as well), or two languages encode them alike (a tie
    too). Repeated rows have the same answer each; a null id or source changes nothing. With no labelled row all go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, a null id last; of equal ids the one with the smaller hash of
    its text, of repeated rows one. Null and empty texts are copies of one another."""
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more go, half itself included, and so does each repeated row. Null and
    empty texts leak nothing, null and empty items are leaked by nobody, an empty benchmark leaves all documents."""
    return tiling.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars is counted anew. No document goes; a null text stays null, with a
    null n_chars. Of spans that overlap the first is replaced whole and the rest of the other as well."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in the packed sequences. A null or empty text is the end id alone; repeated rows and null ids
    are packed like others; documents of one length are placed in the order of a hash."""
    return packing.pack(docs, packing.PackingParams(tokenizer_path()))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: Sizes of encodings, fingerprints, tiles and checksums over token ids: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
