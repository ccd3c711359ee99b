"""Proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Row k of a source with n
rows gets the fractional rank (k + phase) / n, the phase being a hash of the source, so that
sources of one row don't all fall on one point. Sorted by fractional rank, every stretch of the order holds
each source in proportion; cut into shards of equal count, every shard matches the mixture, to
within two rows of each source. The law that holds is ``rows``: counts of shards are at most one apart.

Nothing is ranked or sorted in one task: see ``common.ranked``.

Odd input: a null text has size 16 and checksum 0; rows with a null source are a source of their own;
rows with a null doc_id and repeated rows each get a slot of their own; where there are fewer rows than shards,
some shards stay empty. Copies of a text are dealt like any other row, as whole groups couldn't be kept
together under this law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import buckets_for, ranked, unit_hash, written

LAW = "rows"


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row of ``docs``
    (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "text", "source").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    slim = written(slim, "interleave")
    n = slim.count()
    if n == 0:
        return _shape(slim.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    b = buckets_for(n)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rows = slim.withColumns({"stratum": key, "u": unit_hash(F.lit(seed), "doc_id", "text_crc32", "size")})
    rows = rows.withColumn("bucket", F.floor(F.col("u") * b))
    rows = ranked(rows, "stratum", "bucket", ["u", "doc_id", "text_crc32", "size"], "k", "n_stratum")
    phase = unit_hash(F.lit(seed + 1), "stratum")
    rows = rows.withColumn("at", (F.col("k") + phase) / F.col("n_stratum"))
    rows = rows.withColumns({"all": F.lit(0), "bucket": F.floor(F.col("at") * b)})
    rows = ranked(rows, "all", "bucket", ["at", "stratum", "u", "doc_id", "text_crc32", "size"], "pos", "n_all")
    shard = F.expr(f"(pos * {n_shards}) div {n}")
    rows = rows.withColumn("shard", shard.cast("int"))
    return _shape(rows.withColumn("slot", F.expr(f"pos - (shard * {n}L + {n_shards - 1}) div {n_shards}")))


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "source")
