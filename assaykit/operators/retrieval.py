"""Similarity joins, passages, quotes, absence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_token_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str) -> DataFrame:
    """left_id, right_id, n_shared, n_left, n_right of pairs that share a token, through an inverted index. Rows have distinct tokens.
    ``right`` is the stated query set; its index holds a row for each token, so Spark broadcasts it while it is small, and splits a frequent
    token's rows of ``left`` where it isn't. A pair's shared tokens are counted before they move."""
    a = left.select(left_id, F.size(tokens).alias("n_left"), F.explode(tokens).alias("t_"))
    b = right.select(right_id, F.size(tokens).alias("n_right"), F.explode(tokens).alias("t_"))
    return a.join(b, "t_").groupBy(left_id, right_id).agg(F.count("*").alias("n_shared"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"))


def best_match(pairs: DataFrame, by: str, score: str, candidate: str, floor: float) -> DataFrame:
    """The best candidate at or over the floor for each ``by``; ties go to the smaller candidate."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), candidate)
    return pairs.filter(F.col(score) >= floor).withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")


def identified(pairs: DataFrame, by: str, score: str, candidate: str, agrees: Column, floor: float = 0.75, alone: float = 0.9) -> DataFrame:
    """The best candidate for each ``by`` among those at or over ``floor`` that are known for sure: at ``alone`` or more the score speaks for itself, below
    it something else has to agree as well, as an author or the year. Ties go to the smaller candidate."""
    return best_match(pairs.filter((F.col(score) >= alone) | F.coalesce(agrees, F.lit(False))), by, score, candidate, floor)


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote occurs in a text without overlap."""
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")


def quote_verdict(text: Column, quote: Column, least: int = 12) -> Column:
    """Exactly once, or not at all: too-short, absent, ambiguous, located."""
    n = occurrences(text, quote)
    return F.when(F.length(quote) < least, "too-short").when(n == 0, "absent").when(n > 1, "ambiguous").otherwise("located")


_AUTOMATA: dict[int, object] = {}


def _automaton(quotes: list[str]):
    """One automaton for all quotes, made once in each worker; the last one is kept."""
    import ahocorasick

    key = hash(tuple(quotes))
    if key not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for k, quote in enumerate(quotes):
            made.add_word(quote, (k, len(quote)))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _blocks(quotes: DataFrame, most: int) -> Iterator[list[str]]:
    """Distinct quotes, in blocks of ``most`` characters or one quote."""
    block, held = [], 0
    for r in quotes.select("quote").distinct().orderBy("quote").toLocalIterator():
        if block and held + len(r["quote"]) > most:
            yield block
            block, held = [], 0
        block.append(r["quote"])
        held += len(r["quote"])
    if block:
        yield block


def _searched(block: list[str]):
    """A function of texts: how often each quote of the block occurs, and where first."""

    @F.pandas_udf("array<struct<quote: string, n: long, at: int>>")
    def run(texts: pd.Series) -> pd.Series:
        found = []
        made = _automaton(block)
        for text in texts:
            hits: dict[int, list[int]] = {}
            for end, (k, size) in made.iter(text) if isinstance(text, str) else ():
                at = end - size + 1
                own = hits.setdefault(k, [0, at, -1])
                if at > own[2]:
                    own[0], own[2] = own[0] + 1, end
            found.append([{"quote": block[k], "n": n, "at": at} for k, (n, at, _) in hits.items()])
        return pd.Series(found, dtype=object)

    return run


def quote_hits(docs: DataFrame, quotes: DataFrame, doc: str, item: str, most: int = 4 << 20) -> DataFrame:
    """item, doc, n, at: how often each quote (item, quote: not empty) occurs in each text (doc, text) without overlap, and where first, from
    0. The quotes are a stated query set, taken in blocks of ``most`` characters: every text is read through once for a block, by one automaton
    for all of its quotes, and isn't moved. Quotes and texts that are null hit nothing."""
    out = None
    for block in _blocks(quotes.filter("quote <> ''"), most):
        rows = docs.select(doc, F.explode(_searched(block)("text")).alias("h")).select(doc, "h.*")
        out = rows if out is None else out.union(rows)
    if out is None:
        out = docs.select(doc, F.lit("").alias("quote"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")).limit(0)
    return out.join(quotes.select(item, "quote"), "quote").select(item, doc, "n", "at")


def passages_top_k(blocks: DataFrame, claim_terms: list[str], k: int, doc: str = "doc_id", start: str = "start", terms: str = "terms", numbers: str | None = None, claim_numbers: list[str] = (), number_weight: float = 3.0) -> DataFrame:
    """The k blocks of each document that bear most on a claim: by the sum of ln(N / (1 + df)) + 1 over shared terms, N and df being
    counted over the document's own blocks, and number_weight for each shared number (column ``numbers``, if it is given). Blocks without a
    positive score are left out. Shared terms stay in their row; only counts of a document's terms are grouped."""
    wanted = F.array(*map(F.lit, sorted(claim_terms))).cast("array<string>")
    same = F.size(F.array_intersect(numbers, F.array(*map(F.lit, claim_numbers)).cast("array<string>"))) if numbers else F.lit(0)
    shared = blocks.select(doc, start, F.array_sort(F.array_intersect(terms, wanted)).alias("shared"), same.alias("same_"))
    held = [F.count_if(F.array_contains("shared", t)).alias(f"df{i}_") for i, t in enumerate(sorted(claim_terms))]
    per = shared.groupBy(doc).agg(F.count("*").alias("n_"), *held)
    df = F.map_from_arrays(wanted, F.array(*[F.col(f"df{i}_") for i in range(len(claim_terms))])) if claim_terms else F.create_map().cast("map<string,long>")
    weights = per.select(doc, F.transform_values(df, lambda t, n: F.log(F.col("n_") / (1 + n)) + 1).alias("w_"))
    both = shared.filter((F.size("shared") > 0) | (F.col("same_") > 0)).join(weights, doc)
    score = F.aggregate("shared", F.lit(0.0), lambda x, t: x + F.element_at("w_", t)) + number_weight * F.col("same_")
    scored = both.select(doc, start, score.alias("score"), "shared")
    w = Window.partitionBy(doc).orderBy(F.round("score", 9).desc(), start)
    return scored.filter(F.col("score") > 0).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def passages_for(rows: DataFrame, claim: list[str], start: str, terms: str, claim_terms: str, numbers: str, claim_numbers: str, k: int, number_weight: float = 3.0) -> DataFrame:
    """The k passages for each claim, of rows of a claim and a passage each: scored like ``passages_top_k``, every claim with its own terms. Document
    frequencies are counted over the claim's passages."""
    held = rows.withColumns({"shared_": F.array_intersect(terms, claim_terms), "same_": F.size(F.array_intersect(numbers, claim_numbers))})
    n = held.groupBy(*claim).agg(F.count("*").alias("n_"))
    each = held.select(*claim, start, F.explode("shared_").alias("t_"))
    weight = each.groupBy(*claim, "t_").agg(F.count("*").alias("df_")).join(n, claim).withColumn("w_", F.log(F.col("n_") / (1 + F.col("df_"))) + 1)
    words = each.join(weight.select(*claim, "t_", "w_"), [*claim, "t_"]).groupBy(*claim, start).agg(F.sum("w_").alias("words_"))
    scored = held.join(words, [*claim, start], "left").withColumn("score", F.coalesce("words_", F.lit(0.0)) + number_weight * F.col("same_")).filter("score > 0")
    w = Window.partitionBy(*claim).orderBy(F.round("score", 9).desc(), start)
    return scored.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).drop("shared_", "same_", "words_")


def none_occurs(haystack: Column, needles: list[str]) -> Column:
    """Whether not one of the terms is part of the text, case aside."""
    return ~F.exists(F.array(*map(F.lit, needles)), lambda t: F.contains(F.lower(haystack), t))
