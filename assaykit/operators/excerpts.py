"""The parts of a text that a question needs: sections by the role of their heading first, then passages, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import rates, retrieval

FRONT = 3_000


def section_chunks(docs: DataFrame, sections: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id, rank, role, start, stop of the sections (doc_id, name, start, stop) with a wanted role, in the order of ``wanted``, and of the
    front matter of ``docs`` (doc_id, text, body_start) where that is wanted as ``abstract``."""
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col("role"))
    own = sections.withColumn("role", tx.role_of(F.col("name"))).withColumn("rank", order).filter("rank > 0").select("doc_id", "rank", "role", "start", "stop")
    if "abstract" not in wanted:
        return own
    first = sections.join(docs.select("doc_id", "body_start"), "doc_id").filter("start > body_start").groupBy("doc_id").agg(F.min("start").alias("first_"))
    end = F.coalesce("first_", F.least(F.length("text"), F.col("body_start") + FRONT))
    front = docs.join(first, "doc_id", "left").select("doc_id", F.lit(wanted.index("abstract") + 1).cast("long").alias("rank"), F.lit("abstract").alias("role"), F.col("body_start").alias("start"), end.alias("stop"))
    return own.unionByName(front)


def excerpt(docs: DataFrame, sections: DataFrame, blocks: DataFrame, wanted: list[str], budget: int, terms: list[str], k: int = 12) -> DataFrame:
    """doc_id, role, start, stop, taken of the chunks that are taken: wanted sections, then, while the budget lasts, the passages of ``blocks``
    (doc_id, start, stop, terms) that bear most on ``terms`` and overlap no section that was wanted. A text that gives neither gives its beginning.
    Starts are places in the whole text, so nothing depends on what was left out; ``taken`` counts characters from the start."""
    chosen = section_chunks(docs, sections, wanted).filter("stop > start")
    covered = chosen.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("covered_"))  # a document's sections
    best = retrieval.passages_top_k(blocks, terms, k).select("doc_id", "start", F.col("k").alias("at_")).join(blocks.select("doc_id", "start", "stop"), ["doc_id", "start"])
    apart = ~F.exists(F.coalesce("covered_", F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda c: (F.col("start") < c["stop"]) & (F.col("stop") > c["start"]))
    more = best.join(covered.select("doc_id", F.transform("covered_", lambda c: F.struct(c["start"].cast("long").alias("start"), c["stop"].cast("long").alias("stop"))).alias("covered_")), "doc_id", "left").filter(apart)
    cast = lambda df, rank, role: df.select("doc_id", rank.cast("long").alias("rank"), role.alias("role"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    every = cast(chosen, F.col("rank"), F.col("role")).unionByName(cast(more, F.lit(len(wanted)) + F.col("at_"), F.lit("passage")))
    bare = docs.filter(F.length("text") > 0).join(every.select("doc_id").distinct(), "doc_id", "left_anti")
    every = every.unionByName(bare.select("doc_id", F.lit(0).cast("long").alias("rank"), F.lit("leading").alias("role"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop")))
    sized = every.withColumn("n", F.col("stop") - F.col("start"))
    return rates.budget_prefix(sized, "doc_id", ["rank", "start"], "n", budget).select("doc_id", "role", "start", "stop", F.col("taken").cast("long").alias("taken"))
