"""Queries over keys: orphans, effective values, aliases, ladders, lookups, intervals, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import intervals, keys
from assaykit.plans.registry import query, table


@query("""
SELECT l_orderkey, count(*) AS n_uses, list_slice(list_sort(list(l_linenumber)), 1, 3) AS first_places FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey
""")
def q05_undefined_keys(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return keys.undefined_keys(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "l_linenumber")


@query("""
WITH u AS (SELECT o_orderkey, o_orderpriority, o_orderstatus = 'O' AS f FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT o_orderpriority, count(*) AS n_unused, bool_and(f) AS all_flagged, list_slice(list_sort(list(o_orderkey)), 1, 8) AS first_keys FROM u GROUP BY o_orderpriority
""")
def q06_unused_entries(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority", "o_orderstatus")
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return keys.unused_entries(orders, uses, "key", "o_orderpriority", F.col("o_orderstatus") == "O")


@query("""
WITH u AS (SELECT doc_id, lang, source = 'src0' AS f FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT lang, count(*) AS n_unused, bool_and(f) AS all_flagged, list_slice(list_sort(list(doc_id)), 1, 8) AS first_keys FROM u GROUP BY lang
""")
def q06_unlabelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return keys.unused_entries(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id", "lang", F.col("source") == "src0")


EFFECTIVE_SQL = """
WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 40 WHEN 'click' THEN 30 WHEN 'view' THEN 20 ELSE 10 END AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events),
m AS (SELECT user_id, max(s) AS s, count(*) AS n FROM e GROUP BY user_id)
SELECT e.user_id, m.s AS binding, CASE WHEN min(v) = max(v) THEN min(v) END AS effective, min(v) <> max(v) AS conflict, count(*) AS n_top, max(n) AS n_candidates
FROM e JOIN m USING (user_id, s) GROUP BY e.user_id, m.s
"""


@query(EFFECTIVE_SQL)
def q12_effective_config(spark: SparkSession, d: str) -> DataFrame:
    strength = F.when(F.col("event_type") == "purchase", 40).when(F.col("event_type") == "click", 30).when(F.col("event_type") == "view", 20).otherwise(10)
    rows = table(spark, d, "events").select("user_id", strength.alias("s"), F.get_json_object("props", "$.k").cast("long").alias("v"))
    return keys.effective_values(rows, ["user_id"], "s", "v")


def _alias_sql(name: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.ALIASES.items())
    flat = f"ltrim(translate(lower(trim({name})), '- ', '__'), '_')"
    pick = lambda x: f"CASE {x} {known} END"
    return f"coalesce({pick(f'lower(trim({name}))')}, {pick(flat)}, {pick(f'replace({flat}, {chr(39)}_{chr(39)}, {chr(39)}{chr(39)})')}, {flat})"


_RAW = "CASE event_type WHEN 'purchase' THEN ' Base_LR' WHEN 'click' THEN 'n-epochs' WHEN 'view' THEN 'Batch Size' ELSE concat('--', event_type) END"


@query(f"SELECT {_RAW} AS raw_name, {_alias_sql(_RAW)} AS canonical, count(*) AS n FROM events GROUP BY 1, 2")
def q13_alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_RAW)
    return table(spark, d, "events").select(raw.alias("raw_name")).groupBy("raw_name").agg(F.count("*").alias("n")).select("raw_name", tx.canonical(F.col("raw_name")).alias("canonical"), "n")


@query("""
WITH e AS (SELECT user_id, event_type AS name, event_id, round(value, 2) AS v FROM events WHERE value IS NOT NULL),
p AS (SELECT user_id, name, arg_min(v, event_id) AS stated, arg_max(v, event_id) AS code, count(*) AS n FROM e GROUP BY user_id, name HAVING count(*) > 1)
SELECT user_id, name, stated, code,
       CASE WHEN code = 0 THEN CASE WHEN stated = 0 THEN 'same' ELSE 'drift' END WHEN abs(stated - code) / abs(code) <= 0.0001 THEN 'same'
            WHEN abs(stated - 100 * code) < 1e-9 OR abs(100 * stated - code) < 1e-9 THEN 'unit' ELSE 'drift' END AS verdict FROM p
""")
def q14_hparam_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", F.col("event_type").alias("name"), "event_id", F.round("value", 2).alias("v"))
    pairs = rows.groupBy("user_id", "name").agg(F.min_by("v", "event_id").alias("stated"), F.max_by("v", "event_id").alias("code"), F.count("*").alias("n")).filter("n > 1")
    s, c = F.col("stated"), F.col("code")
    zero = F.when(s == 0, "same").otherwise("drift")
    verdict = F.when(c == 0, zero).when(F.abs(s - c) / F.abs(c) <= 1e-4, "same").when((F.abs(s - 100 * c) < 1e-9) | (F.abs(100 * s - c) < 1e-9), "unit").otherwise("drift")
    return pairs.select("user_id", "name", "stated", "code", verdict.alias("verdict"))


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, c_nationkey, l_quantity AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_linenumber = 1),
a AS (SELECT o_orderkey, count(*) c, min(v) v FROM f GROUP BY 1), b AS (SELECT o_custkey, count(*) c, min(v) v FROM f GROUP BY 1), n AS (SELECT c_nationkey, count(*) c, min(v) v FROM f GROUP BY 1),
r AS (SELECT o_orderkey, o_custkey, c_nationkey, coalesce(a.c, 0) ca, a.v va, coalesce(b.c, 0) cb, b.v vb, coalesce(n.c, 0) cn, n.v vn FROM orders JOIN customer ON o_custkey = c_custkey
      LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_custkey) LEFT JOIN n USING (c_nationkey))
SELECT o_orderkey, o_custkey, c_nationkey, CASE WHEN ca = 1 THEN va WHEN ca > 1 THEN NULL WHEN cb = 1 THEN vb WHEN cb > 1 THEN NULL WHEN cn = 1 THEN vn END AS resolved,
       CASE WHEN ca = 1 THEN 'o_orderkey' WHEN ca > 1 THEN 'abstain' WHEN cb = 1 THEN 'o_custkey' WHEN cb > 1 THEN 'abstain' WHEN cn = 1 THEN 'c_nationkey' WHEN cn > 1 THEN 'abstain' ELSE 'none' END AS resolved_at,
       CASE WHEN ca = 1 THEN 0 WHEN ca > 1 THEN ca WHEN cb = 1 THEN 0 WHEN cb > 1 THEN cb WHEN cn = 1 THEN 0 WHEN cn > 1 THEN cn ELSE 0 END AS n_found FROM r
""")
def q11_n_resolution_ladder(spark: SparkSession, d: str) -> DataFrame:
    levels = ["o_orderkey", "o_custkey", "c_nationkey"]
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(*levels)
    lines = table(spark, d, "lineitem").filter("l_quantity >= 49 AND l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("v"))
    facts = rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(*levels, "v")
    return keys.exactly_one_ladder(rows, facts, levels, "v")


@query("""
WITH h AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 12 HOUR AS stop FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, e.ts, min(h.start) AS section FROM events e LEFT JOIN h ON e.user_id = h.user_id AND h.start <= e.ts AND e.ts < h.stop GROUP BY ALL
""")
def q15_point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    halves = events.filter("event_type = 'purchase'").select("user_id", day.alias("start")).distinct()
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    day_at = seconds(F.col("start"))
    halves = halves.select("user_id", day_at.alias("from"), (day_at + 43_200).alias("to"), F.col("start").alias("section"))
    points = events.select("event_id", "user_id", "ts", seconds(F.col("ts")).alias("at"))
    return intervals.point_in_interval(points, halves, ["user_id"], "at", "from", "to", "section", 43_200).drop("at")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events)
SELECT event_id, user_id, "at" FROM e a WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND a.user_id = b.user_id AND abs(a."at" - b."at") <= 3600)
""")
def q17_band_semi_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return intervals.band_semi_join(rows.filter("event_type <> 'purchase'").drop("event_type"), rows.filter("event_type = 'purchase'"), "user_id", "at", 3600)


@query("""
WITH a AS (SELECT c_custkey AS key, c_mktsegment AS asked FROM customer), i AS (SELECT o_custkey AS key, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
j AS (SELECT o_custkey AS key, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT key, asked, CASE WHEN i.v IS NOT NULL OR j.v IS NOT NULL THEN 'found' ELSE 'unknown' END AS status, CASE WHEN i.v IS NOT NULL THEN 'first' WHEN j.v IS NOT NULL THEN 'second' END AS answered_by, coalesce(i.v, j.v) AS answer
FROM a LEFT JOIN i USING (key) LEFT JOIN j USING (key)
""")
def q26_lookup_three_outcomes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority", "o_orderstatus")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("asked"))
    one, two = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'P'")
    # the third index can't be asked, so whatever the first two lack is unknown, not absent
    return keys.first_answer(asked, [("first", one, True), ("second", two, True), ("third", orders, False)], "key", "o_orderpriority")


@query("""
SELECT o_orderkey, year(o_orderdate) AS stated_year, max(year(l_shipdate)) AS record_year, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey, o_orderdate HAVING max(year(l_shipdate)) <> year(o_orderdate)
""")
def q25_metadata_drift(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.year("l_shipdate")).alias("record_year"), F.count("*").alias("n_lines"))
    orders = table(spark, d, "orders").select("o_orderkey", tx.year_digits(F.col("o_orderdate").cast("string")).cast("int").alias("stated_year"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).filter("stated_year <> record_year").drop("l_orderkey")


@query("""
WITH u AS (SELECT user_id, count(DISTINCT event_type) AS n_types, count(*) AS n, bool_or(value > 200) AS varies FROM events GROUP BY 1)
SELECT user_id, n_types, n FROM u WHERE n_types <= 5 AND NOT varies
""")
def q32_seed_single_literal(spark: SparkSession, d: str) -> DataFrame:
    users = keys.single_literal(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 200, 5)
    return users.select("user_id", F.col("n_values").alias("n_types"), "n")


@query("""
SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount = 0) AS n_unpinned, round(count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE, 6) AS share FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_suppkey HAVING count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE >= 0.5
""")
def q33_unpinned_share(spark: SparkSession, d: str) -> DataFrame:
    locked = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, d, "lineitem").join(locked, "l_suppkey", "left_anti")
    none = lines.groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") == 0).alias("n_unpinned"))
    return keys.share_of(lines, "l_suppkey", F.col("l_discount") <= 0.05, 0.5, "l_linenumber").join(none, "l_suppkey").select("l_suppkey", "n", "n_unpinned", F.round("share", 6).alias("share"))


@query("""
SELECT o_custkey, count(*) AS n, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'high' ELSE 'med' END AS severity FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus = 'F')
""")
def q31_ghost_groups(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("promise"), F.bool_and(F.col("o_orderstatus") == "F").alias("ghost"))
    return per.filter("ghost").select("o_custkey", "n", F.when(F.col("promise"), "high").otherwise("med").alias("severity"))


@query("""
SELECT l_partkey, first_seen, n FROM (SELECT l_partkey, l_orderkey AS first_seen, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1
""")
def q52_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(at).alias("at"), F.count("*").alias("n")).select("l_partkey", F.col("at.l_orderkey").alias("first_seen"), "n")
