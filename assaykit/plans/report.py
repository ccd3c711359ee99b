"""Findings of several checks in one report: suppressed, ordered, counted, audited, written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.operators import findings as fd
from assaykit.plans import keyed, numeric
from assaykit.plans.documents import SENTENCES_SQL, sentences
from assaykit.plans.registry import SQL, query, table

# A configuration: waivers in order; the first that matches counts.
WAIVERS = ((1, "keys/undefined", "legacy orders", "key 1"), (2, "keys/undefined", "bulk import", "7 uses"), (3, "numbers/total", "known rounding", "off by 6"), (4, "numbers/total", "never used", "off by 99"), (5, "config/conflict", "reviewed", None))

_FINGERPRINT = "substr(sha256(rule || '|' || array_to_string(regexp_extract_all(message, '[0-9]+(?:\\.[0-9]+)?|''[^'']*'''), ' ')), 1, 12)"
FINDINGS_SQL = f"""
u AS ({SQL["q05_undefined_keys"]}), t AS ({SQL["q07_table_total_check"]}), g AS ({SQL["q10_grim_means"]}), c AS ({SQL["q12_effective_config"]}),
f0 AS (
 SELECT 'keys/undefined' AS rule, CASE WHEN n_uses > 4 THEN 'high' ELSE 'med' END AS severity, CAST(l_orderkey AS VARCHAR) AS subject, 'key ' || l_orderkey || ' has ' || n_uses || ' uses and no definition' AS message,
        list_transform(first_places, lambda p: 'line ' || p) AS anchors, 'definitions' AS absent_from FROM u
 UNION ALL SELECT 'numbers/total', 'med', CAST(l_orderkey AS VARCHAR), 'total ' || stated || ' of ' || n || ' parts that sum to ' || summed || ', off by ' || (stated - summed), ['stated ' || stated, 'sum ' || summed], NULL FROM t WHERE NOT consistent
 UNION ALL SELECT 'stats/grim', 'high', CAST(l_partkey AS VARCHAR), 'mean ' || unscaled || ' is not attainable from ' || g || ' values', ['mean ' || unscaled, 'n ' || g], NULL FROM g WHERE verdict = 'inconsistent'
 UNION ALL SELECT 'config/conflict', 'low', CAST(user_id AS VARCHAR), 'user ' || user_id || ' has ' || n_top || ' values at strength ' || binding, ['binding ' || binding, 'candidates ' || n_candidates], NULL FROM c WHERE conflict),
f AS (SELECT *, {_FINGERPRINT} AS fingerprint FROM f0),
w(seq, rule, reason, match) AS (VALUES {", ".join("({}, '{}', '{}', {})".format(a, b, c, f"'{m}'" if m else "NULL") for a, b, c, m in WAIVERS)}),
s AS (SELECT f.*, (SELECT arg_min(reason, seq) FROM w WHERE w.rule = f.rule AND (match IS NULL OR contains(message, match))) AS suppressed_by,
      (SELECT min(seq) FROM w WHERE w.rule = f.rule AND (match IS NULL OR contains(message, match))) AS seq FROM f)
"""


def waivers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WAIVERS, "seq int, rule string, reason string, match string")


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Four checks in one schema. Messages are words and columns in turn, the words first."""

    def s(*parts: str):
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])

    u, t, g, c = (f(spark, d) for f in (keyed.q05_undefined_keys, numeric.q07_table_total_check, numeric.q10_grim_means, keyed.q12_effective_config))
    t = t.filter("NOT consistent").withColumn("off", F.col("stated") - F.col("summed"))
    return (
        fd.finding(u, "keys/undefined", F.when(F.col("n_uses") > 4, "high").otherwise("med"), F.col("l_orderkey"), s("key ", "l_orderkey", " has ", "n_uses", " uses and no definition"), F.transform("first_places", lambda p: F.concat(F.lit("line "), p.cast("string"))), F.lit("definitions"))
        .unionByName(fd.finding(t, "numbers/total", F.lit("med"), F.col("l_orderkey"), s("total ", "stated", " of ", "n", " parts that sum to ", "summed", ", off by ", "off"), F.array(s("stated ", "stated"), s("sum ", "summed"))))
        .unionByName(fd.finding(g.filter("verdict = 'inconsistent'"), "stats/grim", F.lit("high"), F.col("l_partkey"), s("mean ", "unscaled", " is not attainable from ", "g", " values"), F.array(s("mean ", "unscaled"), s("n ", "g"))))
        .unionByName(fd.finding(c.filter("conflict"), "config/conflict", F.lit("low"), F.col("user_id"), s("user ", "user_id", " has ", "n_top", " values at strength ", "binding"), F.array(s("binding ", "binding"), s("candidates ", "n_candidates"))))
    )


@query(f"WITH {FINDINGS_SQL} SELECT rule, severity, subject, message, anchors, absent_from, fingerprint, suppressed_by FROM s")
def q01_findings_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: four checks, their findings in one schema, waivers applied, worst first."""
    out = fd.suppress(all_findings(spark, d), waivers(spark))
    return out.orderBy(*fd.report_order(out))


@query(f"WITH {FINDINGS_SQL} SELECT seq, rule, reason, match FROM w WHERE seq NOT IN (SELECT seq FROM s WHERE seq IS NOT NULL)")
def q18_suppression_unused(spark: SparkSession, d: str) -> DataFrame:
    return fd.unused_waivers(all_findings(spark, d), waivers(spark)).select("seq", "rule", "reason", "match")


@query(f"""
WITH {FINDINGS_SQL} SELECT rule, count(*) FILTER (severity = 'high' AND suppressed_by IS NULL) AS n_high, count(*) FILTER (severity = 'med' AND suppressed_by IS NULL) AS n_med, count(*) FILTER (severity = 'low' AND suppressed_by IS NULL) AS n_low,
 count(*) FILTER (suppressed_by IS NOT NULL) AS n_suppressed, CAST(bool_or(suppressed_by IS NULL AND severity IN ('med', 'high')) AS INTEGER) AS exit_code FROM s GROUP BY rule
""")
def q39_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return fd.severity_counts(fd.suppress(all_findings(spark, d), waivers(spark)), ["rule"])


@query(f"""
WITH {SENTENCES_SQL}, a AS (SELECT doc_id, ordinal, start - (ordinal % 5 = 4)::INT * 100000 AS a, start + CASE WHEN ordinal % 5 = 3 THEN 0 ELSE length(rtrim(translate(piece, chr(10) || chr(9) || chr(13), '   '))) END AS b FROM s),
pr AS (SELECT CASE WHEN a < 0 OR b > length(text) OR a > b THEN 'out-of-bounds' WHEN a = b THEN 'empty' WHEN trim(translate(substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), chr(10) || chr(9) || chr(13), '   ')) = '' THEN 'whitespace' END AS problem, ordinal FROM a JOIN documents USING (doc_id))
SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM pr GROUP BY 1
""")
def q48_anchor_audit(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all sentences, some of them moved or emptied, held against the texts they point into."""
    docs = table(spark, d, "documents")
    own = sentences(docs).select("doc_id", "ordinal", (F.col("start") - F.when(F.col("ordinal") % 5 == 4, 100000).otherwise(0)).alias("a"), F.when(F.col("ordinal") % 5 == 3, F.col("start")).otherwise(F.col("stop")).alias("b"))
    checked = fd.anchor_problems(own.join(docs.select("doc_id", "text"), "doc_id", "left"), "text", "a", "b")
    return checked.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""
WITH {FINDINGS_SQL} SELECT rule, subject, CASE severity WHEN 'high' THEN 'error' WHEN 'med' THEN 'warning' ELSE 'note' END AS level, message, anchors[1] AS uri,
  CASE WHEN len(anchors) > 1 THEN array_to_string(list_transform(range(2, len(anchors) + 1), lambda i: (i - 1) || ' ' || anchors[i]), '; ') END AS related, absent_from, fingerprint, suppressed_by FROM s
""")
def q54_sarif_json(spark: SparkSession, d: str) -> DataFrame:
    """A SARIF result for each finding, one row each; runs are put together by the sink, so no rule's results are gathered. Engines print JSON
    differently, so what is compared is what a reader of the JSON finds."""
    from assaykit.sources.sinks import sarif_results

    out = sarif_results(fd.suppress(all_findings(spark, d), waivers(spark)))
    place = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>"
    related = "struct<id: int, physicalLocation: struct<artifactLocation: struct<uri: string>>>"
    schema = f"struct<ruleId: string, level: string, message: struct<text: string>, locations: array<{place}>, relatedLocations: array<{related}>, partialFingerprints: struct<v1: string>, suppressions: array<struct<justification: string>>, properties: struct<absentFrom: string>>"
    r = out.select("subject", F.from_json("result", schema).alias("r")).select("subject", "r.*")
    others = F.array_join(F.transform("relatedLocations", lambda x: F.concat(x["id"].cast("string"), F.lit(" "), x["physicalLocation"]["artifactLocation"]["uri"])), "; ")
    return r.select(
        F.col("ruleId").alias("rule"), "subject", "level", F.col("message.text").alias("message"), F.col("locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), others.alias("related"),
        F.col("properties.absentFrom").alias("absent_from"), F.col("partialFingerprints.v1").alias("fingerprint"), F.try_element_at("suppressions", F.lit(1))["justification"].alias("suppressed_by"),
    )


@query(f"""
WITH {FINDINGS_SQL}, a AS (SELECT fingerprint, rule, message FROM s), b AS (SELECT DISTINCT fingerprint FROM s WHERE TRY_CAST(subject AS BIGINT) % 2 = 0)
SELECT rule, count(*) AS n_new FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM b) GROUP BY rule
""")
def q59_baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a run finds beyond a baseline, by fingerprint. The findings of even subjects are the baseline."""
    every = all_findings(spark, d)
    base = every.filter(F.col("subject").cast("long") % 2 == 0).select("fingerprint").distinct()
    return every.join(base, "fingerprint", "left_anti").groupBy("rule").agg(F.count("*").alias("n_new"))
