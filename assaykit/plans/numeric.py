"""Queries over printed numbers: totals, partitions, near misses, reachable means, recomputed p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import exact, special
from assaykit.operators import intervals
from assaykit.plans.registry import query, table


@query("""
WITH p AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
s AS (SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS summed, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT l_orderkey, n, summed, summed + (l_orderkey % 7) AS stated, 10 * (l_orderkey % 7) <= 5 * n AS consistent FROM s
""")
def q07_table_total_check(spark: SparkSession, d: str) -> DataFrame:
    """The stated total is the sum moved by some units of the last place, so both verdicts occur; half a unit for each part is slack."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("summed"), F.count("*").alias("n")).filter("n >= 2")
    stated = sums.withColumn("stated", F.col("summed") + F.col("l_orderkey") % 7)
    return stated.withColumn("consistent", 10 * F.abs(F.col("stated") - F.col("summed")) <= 5 * F.col("n"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey, sum(n) AS total FROM c GROUP BY 1),
s AS (SELECT c_nationkey, CAST((n * 1000 * 2 + total) // (2 * total) AS BIGINT) AS permille FROM c JOIN t USING (c_nationkey))
SELECT c_nationkey, count(*) AS n_parts, CAST(sum(permille) AS BIGINT) AS summed, bool_and(permille BETWEEN 0 AND 1000) AS shares,
       CASE WHEN 2 * abs(sum(permille) - 1000) <= count(*) THEN 'partition' WHEN abs(sum(permille) - 1000) <= 50 THEN 'near' ELSE 'independent' END AS verdict FROM s GROUP BY 1
""")
def q08_percent_partition(spark: SparkSession, d: str) -> DataFrame:
    """Shares rounded to tenths of a percent: within half a unit for each they make a whole, within 5 % they nearly do."""
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    totals = counts.groupBy("c_nationkey").agg(F.sum("n").alias("total"))
    share = F.expr("(n * 2000 + total) div (2 * total)")
    per = counts.join(totals, "c_nationkey").withColumn("permille", share).groupBy("c_nationkey")
    out = per.agg(F.count("*").alias("n_parts"), F.sum("permille").alias("summed"), F.bool_and(F.col("permille").between(0, 1000)).alias("shares"))
    off = F.abs(F.col("summed") - 1000)
    return out.withColumn("verdict", F.when(2 * off <= F.col("n_parts"), "partition").when(off <= 50, "near").otherwise("independent"))


@query("""
WITH c AS (SELECT l_partkey AS part, list_distinct(list(CAST(round(100 * l_extendedprice / l_quantity) AS BIGINT))) AS cells FROM lineitem GROUP BY 1),
s AS (SELECT p_partkey AS part, CAST(round(100 * p_retailprice) AS BIGINT) AS stated FROM part),
n AS (SELECT part, stated, list_sort(list_transform(cells, lambda x: {'d': abs(x - stated), 'c': x}))[1].c AS nearest FROM s JOIN c USING (part) WHERE len(cells) <= 40 AND NOT list_contains(cells, stated))
SELECT part, stated, nearest, round(abs(stated - nearest) / abs(nearest)::DOUBLE, 6) AS gap FROM n WHERE abs(stated - nearest) / abs(nearest)::DOUBLE <= 0.02
""")
def q09_near_miss_value(spark: SparkSession, d: str) -> DataFrame:
    """As in SQL, prices times 100 are divided by quantities, and millionths of the gap are rounded: in another order of the steps, halves fall to the other side."""
    cents = lambda c: F.round(c).cast("long")
    cells = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), cents(100 * F.col("l_extendedprice") / F.col("l_quantity")).alias("cell"))
    stated = table(spark, d, "part").select(F.col("p_partkey").alias("part"), cents(100 * F.col("p_retailprice")).alias("stated"))
    return intervals.near_misses(stated, cells, ["part"], "stated", "cell", most=40).select("part", "stated", "nearest", (F.round(1e6 * F.col("gap")) / 1e6).alias("gap"))


_GRIM_SQL = """
WITH m AS (SELECT l_partkey, count(*) AS g, CAST(sum(l_quantity) AS BIGINT) AS k FROM lineitem GROUP BY 1),
p AS (SELECT l_partkey, g, (2 * k * 100 + g) // (2 * g) + (l_partkey % 3) AS unscaled FROM m)
SELECT l_partkey, g, unscaled, CASE WHEN g >= 100 THEN 'no-power'
  WHEN len(list_filter(range(0, 4), lambda i: abs(2 * (unscaled * g // 100 - 1 + i) * 100 - 2 * unscaled * g) < g OR 2 * (unscaled * g // 100 - 1 + i) * 100 - 2 * unscaled * g = -g
       OR (2 * (unscaled * g // 100 - 1 + i) * 100 - 2 * unscaled * g = g AND unscaled % 2 = 0))) > 0 THEN 'consistent' ELSE 'inconsistent' END AS verdict,
  list_sort(list_transform(list_slice(list_sort(list_transform(list_distinct(list_transform(range(0, 4), lambda i: (2 * (unscaled * g // 100 - 1 + i) * 100 + g) // (2 * g))), lambda v: {'d': abs(v - unscaled), 'v': v})), 1, 2), lambda s: s.v)) AS nearest
FROM p
"""


@query(_GRIM_SQL)
def q10_grim_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of whole quantities as printed to two places, some moved by one or two units of the last place."""
    means = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("g"), F.sum("l_quantity").cast("long").alias("k"))
    rows = means.select("l_partkey", "g", (F.expr("(200 * k + g) div (2 * g)") + F.col("l_partkey") % 3).alias("unscaled"))
    args = (F.col("unscaled"), F.lit(2), F.col("g"))
    return rows.withColumns({"verdict": exact.grim_verdict(*args), "nearest": exact.grim_nearest(*args)})


# p of a two-sided t test with whole degrees of freedom is a finite sum (of sines and cosines of atan(t / sqrt(df))).
_EVEN = "sin(x) * list_sum(list_transform(range(0, df // 2), lambda i: coalesce(list_product(list_transform(range(1, i + 1), lambda j: (2 * j - 1) / (2.0 * j))), 1) * pow(cos(x), 2 * i)))"
_ODD = "2 / pi() * (x + coalesce(sin(x) * list_sum(list_transform(range(0, (df - 1) // 2), lambda i: coalesce(list_product(list_transform(range(1, i + 1), lambda j: (2 * j) / (2.0 * j + 1))), 1) * pow(cos(x), 2 * i + 1))), 0))"


def p_sql(stat: str) -> str:
    return f"(SELECT 1 - CASE WHEN df % 2 = 0 THEN {_EVEN} ELSE {_ODD} END FROM (SELECT atan(abs({stat}) / sqrt(df)) AS x))"


#: v: l_partkey, df, stat, p, printed, verdict of the same tests as ``t_tests``.
T_TEST_SQL = f"""
g AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS m, stddev(l_quantity) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 5 AND stddev(l_quantity) > 0),
t AS (SELECT l_partkey, n - 1 AS df, round((m - 25) / (s / sqrt(n)), 3) AS stat FROM g), q AS (SELECT *, {p_sql("stat")} AS p FROM t),
r AS (SELECT *, round(CASE WHEN l_partkey % 5 = 0 THEN least(p + 0.04, 1.0) ELSE p END, 3) AS printed, greatest(abs(stat) - 0.0005, 0) AS low, abs(stat) + 0.0005 AS high FROM q),
e AS (SELECT *, {p_sql("low")} AS p_high, {p_sql("high")} AS p_low FROM r),
v AS (SELECT l_partkey, df, stat, p, printed, CASE WHEN p_low <= printed + 0.0005 AND p_high >= printed - 0.0005 THEN 'consistent' WHEN NOT (p_low < 0.05 AND p_high >= 0.05) AND (printed < 0.05) <> (p_high < 0.05) THEN 'decision' ELSE 'inconsistent' END AS verdict FROM e)
"""


def t_tests(spark: SparkSession, d: str) -> DataFrame:
    """A t test of each part's mean quantity against 25, printed to three places with its p, some p's altered."""
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev("l_quantity").alias("s")).filter("n >= 5 AND s > 0")
    tests = per.select("l_partkey", F.lit("t").alias("kind"), F.round((F.col("m") - 25) / (F.col("s") / F.sqrt("n")), 3).alias("stat"), (F.col("n") - 1).cast("double").alias("df1"), F.lit(0.0).alias("df2"), F.lit(2.0).alias("tail"))
    tests = tests.withColumn("p", special.p_of(*map(F.col, ("kind", "stat", "df1", "df2", "tail"))))
    return tests.withColumn("printed", F.round(F.when(F.col("l_partkey") % 5 == 0, F.least(F.col("p") + 0.04, F.lit(1.0))).otherwise(F.col("p")), 3))


@query(f"WITH {T_TEST_SQL} SELECT l_partkey, stat, CAST(df AS DOUBLE) AS df1, round(p, 5) AS p, printed, verdict FROM v")
def q50_pvalue_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and their p's read as intervals and compared."""
    rows = t_tests(spark, d)
    low, high = exact.interval_of(F.abs("stat"), F.lit(3))
    ends = rows.withColumns({"p_high": special.p_of(F.col("kind"), F.greatest(low, F.lit(0.0)), F.col("df1"), F.col("df2"), F.col("tail")), "p_low": special.p_of(F.col("kind"), high, F.col("df1"), F.col("df2"), F.col("tail"))})
    said_low, said_high = exact.interval_of(F.col("printed"), F.lit(3))
    consistent = (F.col("p_low") <= said_high) & (F.col("p_high") >= said_low)
    straddles = (F.col("p_low") < 0.05) & (F.col("p_high") >= 0.05)
    verdict = F.when(F.col("p").isNull(), "unsupported").when(consistent, "consistent").when(~straddles & ((F.col("printed") < 0.05) != (F.col("p_high") < 0.05)), "decision").otherwise("inconsistent")
    return ends.select("l_partkey", "stat", "df1", F.round("p", 5).alias("p"), "printed", verdict.alias("verdict"))


@query("""
SELECT l_partkey, printed, n_decimals, low, high FROM (SELECT p_partkey AS l_partkey, replace(printf('%.2f', p_retailprice), '.', ',') AS printed, 2 AS n_decimals,
  round(p_retailprice - 0.005, 3) AS low, round(p_retailprice + 0.005, 3) AS high FROM part)
""")
def q38_printed_precision(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as printed, with a decimal comma: places are counted from the text, and the text stands for an interval."""
    from assaykit.functions import text as tx

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("printed"))
    value, places = tx.decimal_text(F.col("printed")).cast("double"), tx.decimals(F.col("printed"))
    low, high = exact.interval_of(value, places)
    return rows.select("l_partkey", "printed", places.alias("n_decimals"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))
