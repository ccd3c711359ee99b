"""Corpus analytics: firing rates, movement between batches, coverage, precision, medians, samples, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.exact import wilson

LOUD, QUIET, MOVED, FEWEST_LABELS = 0.35, 0.01, 0.05, 10


def firing_rates(hits: DataFrame, batch: str, rule: str, paper: str) -> DataFrame:
    """For each batch and rule: fired, papers_hit, rate over the batch's papers, and a flag: ``!`` loud, ``-`` silent, ``.`` quiet."""
    papers = hits.groupBy(batch).agg(F.count_distinct(paper).alias("papers"))
    per = hits.groupBy(batch, rule).agg(F.count("*").alias("fired"), F.count_distinct(paper).alias("papers_hit"))
    out = per.join(papers, batch).withColumn("rate", F.col("papers_hit") / F.col("papers"))
    flag = F.when(F.col("rate") >= LOUD, "!").when(F.col("fired") == 0, "-").when(F.col("rate") <= QUIET, ".").otherwise("")
    return out.withColumn("flag", flag)


def movement(rates: DataFrame, batch: str, rule: str) -> DataFrame:
    """Rules whose rate moved by MOVED or more between the first and the last batch that has them."""
    out = rates.groupBy(rule).agg(F.min_by("rate", batch).alias("first_rate"), F.max_by("rate", batch).alias("last_rate"))
    out = out.withColumn("delta", F.col("last_rate") - F.col("first_rate")).filter(F.abs("delta") >= MOVED)
    return out.withColumn("direction", F.when(F.col("delta") > 0, "up").otherwise("down"))


def coverage(rules: DataFrame, ran: DataFrame, fired: DataFrame, rule: str) -> DataFrame:
    """fired, silent or never-ran for each rule."""
    r, f = ran.select(rule).distinct().withColumn("ran_", F.lit(True)), fired.select(rule).distinct().withColumn("fired_", F.lit(True))
    status = F.when(F.col("fired_"), "fired").when(F.col("ran_"), "silent").otherwise("never-ran")
    return rules.select(rule).distinct().join(r, rule, "left").join(f, rule, "left").select(rule, status.alias("status"))


def precision(labels: DataFrame, group: str, correct: Column) -> DataFrame:
    """n, n_correct, precision and its Wilson bounds; a verdict says so where there are too few labels to rate."""
    out = labels.groupBy(group).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    few = F.col("n") < FEWEST_LABELS
    return out.withColumns({"precision": F.when(~few, F.col("n_correct") / F.col("n")), "low": low, "high": high, "verdict": F.when(few, "too few to rate").otherwise("rated")})


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value of each group, the upper one of two: by counts of values, so no group is gathered in one task before it is summed."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n_"))
    along = Window.partitionBy(group).orderBy(value)
    seen = counts.withColumns({"upto_": F.sum("n_").over(along), "all_": F.sum("n_").over(Window.partitionBy(group))})
    return seen.filter(F.col("upto_") > F.floor(F.col("all_") / 2)).groupBy(group).agg(F.min(value).alias("median"), F.max("all_").alias("n"))


def stratified_sample(rows: DataFrame, stratum: str, key: Column, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, those with the smallest seeded hashes."""
    order = F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)
    return rows.withColumn("order_", order).withColumn("k", F.row_number().over(Window.partitionBy(stratum).orderBy("order_"))).filter(F.col("k") <= n).drop("order_")


def budget_prefix(rows: DataFrame, group: str, order: list[str], length: str, budget: int) -> DataFrame:
    """Rows of each group in order while the budget lasts; ``taken`` is what the last one may still use of it."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(length).over(before), F.lit(0))
    return rows.withColumn("left_", left).filter(F.col("left_") > 0).withColumn("taken", F.least(F.col(length), F.col("left_"))).drop("left_")


def greedy_budget(rows: DataFrame, group: str, order: str, name: str, length: str, budget: int) -> DataFrame:
    """Names of each group in order, each taken if it still fits: one that doesn't is skipped, not the end."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(length).cast("long").alias("l"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("names"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["l"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["l"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["names"], F.array(x["n"].cast("bigint")))).otherwise(acc["names"]).alias("names"))

    return rows.groupBy(group).agg(F.aggregate(items, start, step).alias("a")).select(group, "a.used", "a.names")


def quote_rates(quotes: DataFrame, by: str, verdict: str) -> DataFrame:
    """n and share of each verdict on a model's quotes within each group, and the share that was located."""
    per = quotes.groupBy(by, verdict).agg(F.count("*").alias("n"))
    total = per.groupBy(by).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col(verdict) == "located", F.col("n")).otherwise(0)).alias("n_located"))
    return per.join(total, by).select(by, verdict, "n", (F.col("n") / F.col("n_all")).alias("share"), (F.col("n_located") / F.col("n_all")).alias("located"))


def screened(rows: DataFrame, paper: str, hit: Column, least: int = 2, keep: int | None = None) -> DataFrame:
    """Papers with ``least`` hits or more, by name; at most ``keep`` of them, the first by name. Never the ones with the most hits: rates
    measured on those would be rates of papers chosen for them."""
    passed = rows.groupBy(paper).agg(F.count_if(hit).alias("n_hits")).filter(F.col("n_hits") >= least)
    return passed.orderBy(paper).limit(keep) if keep else passed


def review_order(per_rule: DataFrame, fired: str, rule: str) -> DataFrame:
    """Rules as a reviewer takes them: the one that fired most first, then by name."""
    return per_rule.withColumn("place", F.row_number().over(Window.orderBy(F.col(fired).desc(), rule)))  # a row for each rule


def unanswered(questions: DataFrame, by: str, state: str) -> DataFrame:
    """What a model left open, as abstentions: by, what. States are answered, unanswered, unverified (its quote isn't there) and over-budget."""
    words = {"unanswered": "questions without an answer", "unverified": "answers whose quote isn't in the text", "over-budget": "questions beyond the budget"}
    said = F.create_map(*[F.lit(x) for p in words.items() for x in p])
    return questions.filter(F.col(state).isin(*words)).groupBy(by, state).agg(F.count("*").alias("n")).select(by, F.concat(F.col("n").cast("string"), F.lit(" "), said[F.col(state)]).alias("what"))


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each group, and group, n_left of the groups that have more: what a cap leaves out is said, not dropped."""
    first = rows.withColumn("k_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("k_") <= most).drop("k_")
    left = rows.groupBy(group).agg((F.count("*") - most).alias("n_left")).filter("n_left > 0")
    return first, left
