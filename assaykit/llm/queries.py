"""The queries of these operators: each applies one operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import bands, langid, licenses, packing, pii, repair, sharding, simhash, tiling, warc
from assaykit.llm.common import read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's file is. Imported here, as only these queries need the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, margin_bytes of every document: compression with a dictionary of each language, learned from the
    labelled rows that aren't held out. Null texts and texts without a letter are ``und``; an empty table gives an empty result."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null), source of every document, in 40 shards of counts at most one apart. Null
    texts have size 16 and checksum 0; repeated rows get a slot each."""
    return sharding.interleave(read_table(spark, sf_dir, "documents"))


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; fingerprints within 4 bits are linked. Texts without words, null ones too, have
    fingerprint zero; a null id comes last."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, dice, n_units of every document and licence found in it. Null texts hold none; rows that share an id are one document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, item_words of every document and benchmark item it leaks. Null texts and items leak
    nothing; repeated rows are reported each."""
    return tiling.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed, kept, ratio, chunk_share_out, reason of every document. A null text has no word and fails the base rule."""
    return bands.quality(read_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and the scores of the further ones, of every document. A null text has no span."""
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every page, from archives that were written and read back. A null
    html is an empty payload; repeated rows get a record each; a lost record is an error."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group of every piece of every document. A null text is the end
    id alone; repeated rows are packed each."""
    return packing.pack(read_table(spark, sf_dir, "documents"), packing.PackingParams(tokenizer_path()))


def op10_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document, from files of grammars that were written and read back. A null text is
    the end id alone; null ids come first; repeated rows are stored each."""
    return repair.round_trip(read_table(spark, sf_dir, "documents"), repair.RePairParams(tokenizer_path()))


OP8_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first_id THEN first_id END AS refers_to,
       url
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id,
        op2_interleaved_shards,
        op3_simhash_anchors,
        op4_license_scan,
        op5_string_tiling,
        op6_compression_bands,
        op7_personal_data,
        op8_warc_salvage,
        op9_hierarchical_packing,
        op10_repair_files,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle_sql(), "op8_warc_salvage": OP8_SQL}
