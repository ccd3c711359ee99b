"""What stands beside the rules: identified titles, excerpts, rates of quotes, screens, lists of ids, records of indexes, links, audits, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import excerpts, intervals, rates, retrieval
from assaykit.operators import findings as fd
from assaykit.plans.documents import _TERMS, CLAIM, SENTENCES_SQL, TITLES_SQL, q20_quote_locate, sentences, titles
from assaykit.plans.registry import SQL, query, table
from assaykit.sources import records, repositories


@query(f"""
WITH {TITLES_SQL}, j AS (SELECT doc_id, item_id, n_shared / (na + nb - n_shared)::DOUBLE AS s FROM x WHERE n_shared > 0)
SELECT doc_id, item_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS k FROM j WHERE s >= 0.1 AND (s >= 0.2 OR doc_id % 2 = item_id % 2)) WHERE k = 1
""")
def q94_title_identified(spark: SparkSession, d: str) -> DataFrame:
    """The best title that is known for sure; the parity of the ids stands for an author or a year that agrees."""
    scored = titles(spark, d).withColumn("score", F.col("n_shared") / (F.col("n_left") + F.col("n_right") - F.col("n_shared")))
    return retrieval.identified(scored, "doc_id", "score", "item_id", F.col("doc_id") % 2 == F.col("item_id") % 2, 0.1, 0.2).select("doc_id", "item_id", F.round("score", 6).alias("score"))


_BUDGET, _PART = 1500, 400


@query(f"""
WITH d AS (SELECT doc_id, text, length(text) AS len FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, len, unnest(range((len + {_PART - 1}) // {_PART})) AS i FROM d WHERE len > 0),
s AS (SELECT doc_id, i * {_PART} AS start, least((i + 1) * {_PART}, len) AS stop FROM i WHERE i % 3 = 1),
f AS (SELECT doc_id, 0 AS start, CASE WHEN len > {_PART} THEN {_PART} ELSE len END AS stop FROM d WHERE len > 0),
c AS (SELECT doc_id, 1 AS rank, 'results' AS role, start, stop FROM s UNION ALL SELECT doc_id, 2, 'abstract', start, stop FROM f),
b AS (SELECT doc_id, unnest(range(len(x))) AS ordinal, unnest(x) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
o AS (SELECT doc_id, block, CAST(sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(block) - 1 AS start FROM b),
t AS (SELECT doc_id, start, start + length(block) AS stop, list_intersect({_TERMS.format("block")}, {list(CLAIM)}) AS shared FROM o), n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1),
e AS (SELECT doc_id, start, stop, unnest(shared) AS term FROM t), df AS (SELECT doc_id, term, count(*) AS df FROM e GROUP BY 1, 2),
w AS (SELECT doc_id, start, stop, sum(ln(n / (1 + df)::DOUBLE) + 1) AS score FROM e JOIN df USING (doc_id, term) JOIN n USING (doc_id) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, start) AS k FROM w WHERE score > 0),
p AS (SELECT doc_id, 2 + k AS rank, 'passage' AS role, start, stop FROM k WHERE k <= 12 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND k.start < c.stop AND k.stop > c.start)),
a AS (SELECT *, {_BUDGET} - coalesce(sum(stop - start) OVER (PARTITION BY doc_id ORDER BY rank, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM (SELECT * FROM c UNION ALL SELECT * FROM p))
SELECT doc_id, role, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(least(stop - start, room) AS BIGINT) AS taken FROM a WHERE room > 0
""")
def q95_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of documents read as sections of 400 characters, of which every third holds results: results first, then the front, then passages."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.lit(0).alias("body_start"))
    parts = F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / _PART).cast("int")), lambda i: i * _PART < F.length("text"))
    cut = docs.filter(F.length("text") > 0).select("doc_id", F.length("text").alias("len"), F.explode(parts).alias("i"))
    name = F.when(F.col("i") % 3 == 1, F.concat(F.lit("3."), F.col("i").cast("string"), F.lit(" Main results"))).when(F.col("i") % 3 == 2, "Methods").otherwise("Thanks")
    sections = cut.select("doc_id", name.alias("name"), (F.col("i") * _PART).alias("start"), F.least((F.col("i") + 1) * _PART, F.col("len")).alias("stop"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "block")).withColumn("step", F.length("block") + 1)
    blocks = intervals.running_starts(lines, "doc_id", "k", "step").select("doc_id", "start", (F.col("start") + F.length("block")).alias("stop"), tx.terms(F.col("block")).alias("terms"))
    return excerpts.excerpt(docs, sections, blocks, ["results", "abstract"], _BUDGET, list(CLAIM))


@query(f"""
WITH q AS ({SQL["q20_quote_locate"]}), c AS (SELECT item_id % 3 AS model, verdict, count(*) AS n FROM q GROUP BY 1, 2)
SELECT model, verdict, n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share, round(coalesce(sum(n) FILTER (verdict = 'located') OVER (PARTITION BY model), 0) / sum(n) OVER (PARTITION BY model), 6) AS located FROM c
""")
def q96_quote_rates(spark: SparkSession, d: str) -> DataFrame:
    quotes = q20_quote_locate(spark, d).withColumn("model", F.col("item_id") % 3)
    return rates.quote_rates(quotes, "model", "verdict").select("model", "verdict", "n", F.round("share", 6).alias("share"), F.round("located", 6).alias("located"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS n_hits FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') >= 2 ORDER BY user_id LIMIT 25")
def q97_screen_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Users as papers: those with two errors or more, the first 25 by name, whatever their number of hits."""
    return rates.screened(table(spark, d, "events"), "user_id", F.col("event_type") == "error", 2, 25)


@query("""
WITH l AS (SELECT page_id, trim(split_part(CASE page_id % 4 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' ELSE url || ' # twice' END, '#', 1)) AS id FROM pages UNION ALL SELECT page_id + 1000000, trim(split_part(url, '#', 1)) FROM pages)
SELECT id, min(page_id) AS place FROM l WHERE id <> '' GROUP BY id
""")
def q98_id_list(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    m = F.col("page_id") % 4
    noisy = pages.select("page_id", F.when(m == 0, F.concat(F.lit("# "), "url")).when(m == 1, "  ").otherwise(F.concat("url", F.lit(" # twice"))).alias("value"))
    lines = noisy.union(pages.select(F.col("page_id") + 1000000, "url"))
    return records.read_ids(lines, ["page_id"]).select("id", F.col("place.page_id").alias("place"))


@query("""
SELECT p_partkey, 'Study of ' || p_name AS title, CAST(CASE WHEN p_size % 2 = 0 THEN 1990 + p_size ELSE 1980 END AS VARCHAR) AS year, CASE WHEN p_size % 3 = 0 THEN ['Li, Ada', 'Wu'] ELSE ['Li, Ada'] END AS authors, p_brand AS venue, '10.1/' || p_partkey AS doi FROM part
""")
def q99_index_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as an index writes works: titles in a list, with white space of their own, and one of two dates."""
    date = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    people = F.array(F.struct(F.lit("Li").alias("family"), F.lit("Ada").alias("given")), F.struct(F.when(F.col("p_size") % 3 == 0, "Wu").alias("family"), F.lit(None).cast("string").alias("given")))
    body = F.struct(F.array(F.concat(F.lit("Study  of\n"), "p_name")).alias("title"), people.alias("author"), F.when(F.col("p_size") % 2 == 0, date(1990 + F.col("p_size"))).alias("published-print"), date(F.lit(1980)).alias("issued"), F.array("p_brand").alias("container-title"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("DOI"))
    rows = table(spark, d, "part").select("p_partkey", records.index_record("crossref", F.to_json(body)).alias("r"))
    return rows.select("p_partkey", "r.title", "r.year", "r.authors", "r.venue", "r.doi")


@query("SELECT p_partkey AS doc_id, 'https://gitlab.com/me' || p_size || '/tool' || p_partkey AS url, 'me' || p_size || '/tool' || p_partkey AS slug FROM part WHERE p_size % 3 > 0")
def q100_own_repository(spark: SparkSession, d: str) -> DataFrame:
    """The first link that isn't a tool's; some texts only link tools."""
    n = F.col("p_size").cast("string")
    own = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" gitlab.com/me"), n, F.lit("/tool"), F.col("p_partkey").cast("string"), F.lit(".git, github.com/later/one"))).otherwise("")
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Built on https://github.com/PyTorch/vision and github.com/me/paper.pdf;"), own).alias("raw"))
    return repositories.own_repository(texts)


@query(f"""
WITH {SENTENCES_SQL}, a AS (SELECT lang, doc_id, start AS a, start + length(rtrim(translate(piece, chr(10) || chr(9) || chr(13), '   '))) AS b, ordinal FROM s),
l AS (SELECT a.*, text, length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) + 1 + (ordinal % 4 = 3)::INT AS line, length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) + 1 AS real FROM a LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) USING (doc_id)),
z AS (SELECT lang, CASE WHEN text IS NULL THEN 'missing-source' WHEN a = b THEN 'empty' WHEN trim(translate(substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), chr(10) || chr(9) || chr(13), '   ')) = '' THEN 'whitespace' WHEN line <> real THEN 'wrong-line' END AS problem FROM l)
SELECT lang, count(*) FILTER (problem IS NULL OR problem <> 'missing-source') AS n_checked, count(*) FILTER (problem <> 'missing-source') AS n_failed, count(*) FILTER (problem = 'missing-source') AS n_missing, least(20, count(*) FILTER (problem <> 'missing-source')) AS n_shown FROM z GROUP BY lang
""")
def q101_anchor_lines(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all sentences with the line they say they begin on, wrong for some; only sources with a label are at hand."""
    docs = table(spark, d, "documents")
    at = F.substring("text", F.lit(1), F.col("a").cast("int"))
    own = sentences(docs).select("lang", "doc_id", "ordinal", F.col("start").cast("int").alias("a"), F.col("stop").cast("int").alias("b")).join(docs.select("doc_id", "text"), "doc_id")
    lined = own.withColumn("line", F.length(at) - F.length(F.replace(at, F.lit("\n"), F.lit(""))) + 1 + F.when(F.col("ordinal") % 4 == 3, 1).otherwise(0))
    held = lined.join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("at_hand")).distinct(), "doc_id", "left").withColumn("text", F.when(F.col("at_hand"), F.col("text")))
    return fd.audit(fd.anchor_problems(held, "text", "a", "b", "line"), "lang", ["doc_id", "a"]).select("lang", "n_checked", "n_failed", "n_missing", F.coalesce(F.size("failures"), F.lit(0)).cast("long").alias("n_shown"))


@query("""
SELECT conv_id, turn, sha256('{"model":"m",' || CASE WHEN turn % 2 = 0 THEN '"schema":"s",' ELSE '' END || '"system":"' || role || '","user":"' || md5(text) || '","version":"1"}') AS key FROM conversations
""")
def q102_request_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    key = records.request_key(F.col("role"), F.md5("text"), F.when(F.col("turn") % 2 == 0, "s"), F.lit("1"), F.lit("m"))
    return rows.select("conv_id", "turn", key.alias("key"))
