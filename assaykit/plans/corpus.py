"""Corpus analytics over batches, labels and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import findings, rates
from assaykit.plans.registry import query, table

RATES_SQL = """
e AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS batch, event_type AS rule, user_id FROM events WHERE value > 100), p AS (SELECT batch, count(DISTINCT user_id) AS papers FROM e GROUP BY 1),
r AS (SELECT batch, rule, count(*) AS fired, count(DISTINCT user_id) AS papers_hit FROM e GROUP BY 1, 2), x AS (SELECT r.*, papers, papers_hit / papers::DOUBLE AS rate FROM r JOIN p USING (batch))
"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").filter("value > 100").select(F.to_date("ts").alias("batch"), F.col("event_type").alias("rule"), "user_id")
    return rates.firing_rates(hits, "batch", "rule", "user_id")


@query(f"WITH {RATES_SQL} SELECT batch, rule, fired, papers_hit, papers, round(rate, 6) AS rate, CASE WHEN rate >= 0.35 THEN '!' WHEN fired = 0 THEN '-' WHEN rate <= 0.01 THEN '.' ELSE '' END AS flag FROM x")
def q40_rule_rates_flags(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("batch", "rule", "fired", "papers_hit", "papers", F.round("rate", 6).alias("rate"), "flag")


@query(f"""
WITH {RATES_SQL}, m AS (SELECT rule, arg_min(rate, batch) AS a, arg_max(rate, batch) AS b FROM x GROUP BY 1)
SELECT rule, round(a, 6) AS first_rate, round(b, 6) AS last_rate, CASE WHEN b > a THEN 'up' ELSE 'down' END AS direction FROM m WHERE abs(b - a) >= 0.05
""")
def q41_batch_movement(spark: SparkSession, d: str) -> DataFrame:
    out = rates.movement(_rates(spark, d), "batch", "rule")
    return out.select("rule", F.round("first_rate", 6).alias("first_rate"), F.round("last_rate", 6).alias("last_rate"), "direction")


@query("""
WITH a AS (SELECT DISTINCT p_type AS rule FROM part), r AS (SELECT DISTINCT p_type AS rule FROM part WHERE p_size > 5), f AS (SELECT DISTINCT p_type AS rule FROM part WHERE p_size > 48)
SELECT rule, CASE WHEN f.rule IS NOT NULL THEN 'fired' WHEN r.rule IS NOT NULL THEN 'silent' ELSE 'never-ran' END AS status FROM (SELECT a.rule, r.rule AS rr, f.rule AS ff FROM a LEFT JOIN r USING (rule) LEFT JOIN f USING (rule)) x(rule, rr, ff)
LEFT JOIN r USING (rule) LEFT JOIN f USING (rule)
""")
def q42_rule_coverage_sets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_type").alias("rule"), "p_size")
    return rates.coverage(part, part.filter("p_size > 5"), part.filter("p_size > 48"), "rule")


@query("""
WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1),
w AS (SELECT *, c / n::DOUBLE AS p, 1.96 * 1.96 AS zz FROM g)
SELECT source, n, c AS n_correct, CASE WHEN n >= 10 THEN round(p, 6) END AS precision, round(greatest(0.0, (p + zz / (2 * n) - 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)), 6) AS low,
       round(least(1.0, (p + zz / (2 * n) + 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)), 6) AS high, CASE WHEN n < 10 THEN 'too few to rate' ELSE 'rated' END AS verdict FROM w
""")
def q43_wilson_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    out = rates.precision(labels, "source", F.col("quality") == 1)
    return out.select("source", "n", "n_correct", *[F.round(c, 6).alias(c) for c in ("precision", "low", "high")], "verdict")


@query("SELECT lang, doc_id, k FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || CAST(doc_id AS VARCHAR))) AS k FROM documents) WHERE k <= 30")
def q44_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    out = rates.stratified_sample(table(spark, d, "documents").select("lang", "doc_id"), "lang", F.col("doc_id"), 30, "7")
    return out.select("lang", "doc_id", F.col("k").cast("long"))


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT source, doc_id, turn, row_number() OVER (PARTITION BY turn // 10 ORDER BY turn, source) AS place, turn // 10 AS batch FROM r
""")
def q45_interleave_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sources in turn, ten turns a batch; places are counted within a batch, so nothing is sorted as a whole."""
    from pyspark.sql.window import Window

    rows = findings.interleaved(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").withColumn("batch", F.floor(F.col("turn") / 10).cast("long"))
    return rows.select("source", "doc_id", F.col("turn").cast("long"), F.row_number().over(Window.partitionBy("batch").orderBy("turn", "source")).cast("long").alias("place"), "batch")


@query("""
WITH l AS (SELECT conv_id, turn, role, length(text) AS n, 3000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations)
SELECT conv_id, turn, role, n, CAST(least(n, room) AS BIGINT) AS taken FROM l WHERE room > 0
""")
def q46_char_budget_excerpt(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), rank.alias("rank"))
    return rates.budget_prefix(rows, "conv_id", ["rank", "turn"], "n", 3000).drop("rank")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
g AS (SELECT conv_id, k, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, CASE WHEN n <= 1500 THEN [turn] ELSE []::BIGINT[] END AS names FROM c WHERE k = 1
  UNION ALL SELECT c.conv_id, c.k, CASE WHEN used + n <= 1500 THEN used + n ELSE used END, CASE WHEN used + n <= 1500 THEN list_append(names, turn) ELSE names END FROM g JOIN c ON c.conv_id = g.conv_id AND c.k = g.k + 1)
SELECT conv_id, arg_max(used, k) AS used, arg_max(names, k) AS names FROM g GROUP BY 1
""")
def q47_greedy_skip_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return rates.greedy_budget(rows, "conv_id", "turn", "turn", "n", 1500)


@query("""
SELECT fp, count(*) AS n, min(event_id) AS first_event, count(DISTINCT user_id) AS papers FROM (SELECT *, substr(sha256(event_type || '|' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS VARCHAR)), 1, 12) AS fp FROM events WHERE event_type = 'error') GROUP BY fp
""")
def q49_crash_groups(spark: SparkSession, d: str) -> DataFrame:
    frame = F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("string")
    fp = F.substring(F.sha2(F.concat_ws("|", "event_type", frame), 256), 1, 12)
    errors = table(spark, d, "events").filter("event_type = 'error'").withColumn("fp", fp)
    return errors.groupBy("fp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.count_distinct("user_id").alias("papers"))


@query("""
WITH c AS (SELECT role, CASE WHEN length(text) // 4 > 300 THEN 'large' WHEN length(text) // 4 < 100 THEN 'tiny' ELSE 'usual' END AS size, length(text) // 4 AS tokens FROM conversations)
SELECT role, size, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY 1, 2
""")
def q55_prompt_census(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.floor(F.length("text") / 4)
    size = F.when(tokens > 300, "large").when(tokens < 100, "tiny").otherwise("usual")
    return table(spark, d, "conversations").groupBy("role", size.alias("size")).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"))


@query("""
WITH w AS (SELECT source, lang AS why, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, why, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, why) AS k FROM w) WHERE k <= 4
""")
def q56_why_tags_top(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "why")
    counts = table(spark, d, "documents").groupBy("source", F.col("lang").alias("why")).agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(w)).filter("k <= 4").drop("k")


@query("""
WITH l AS (SELECT doc_id, quality FROM labels), d AS (SELECT doc_id, source FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS n_live, count(*) FILTER (quality = 1) AS n_good, (SELECT count(*) FROM l WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM d WHERE doc_id IS NOT NULL)) AS n_stale FROM l JOIN d USING (doc_id) GROUP BY source
""")
def q57_stale_labels(spark: SparkSession, d: str) -> DataFrame:
    return stale_labels(table(spark, d, "labels"), table(spark, d, "documents"))


def stale_labels(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels by source, of documents that are there and have a text; n_stale counts all others, so none is dropped in silence."""
    live = docs.filter("text IS NOT NULL").select("doc_id", "source")
    stale = labels.join(live, "doc_id", "left_anti").agg(F.count("*").alias("n_stale"))
    per = labels.join(live, "doc_id").groupBy("source").agg(F.count("*").alias("n_live"), F.count_if(F.col("quality") == 1).alias("n_good"))
    return per.join(F.broadcast(stale), how="inner")


@query("""
WITH x AS (SELECT unnest(['lang', 'source', 'digit', 'label']) AS slice, unnest([lang IS NOT NULL, source IS NOT NULL, regexp_matches(text, '[0-9]'), l.doc_id IS NOT NULL]) AS has FROM documents LEFT JOIN labels l USING (doc_id))
SELECT slice, count(*) AS asked, count(*) FILTER (has) AS filled, round(count(*) FILTER (has) / count(*)::DOUBLE, 6) AS coverage FROM x GROUP BY slice
""")
def q58_slice_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many papers have each slice filled, of those that asked for it."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left")
    has = {"lang": F.col("lang").isNotNull(), "source": F.col("source").isNotNull(), "digit": F.col("text").rlike("[0-9]"), "label": F.coalesce("l", F.lit(False))}
    long = docs.select(*[c.alias(k) for k, c in has.items()]).unpivot([], list(has), "slice", "has")
    return long.groupBy("slice").agg(F.count("*").alias("asked"), F.count_if("has").alias("filled"), F.round(F.count_if("has") / F.count("*"), 6).alias("coverage"))
