"""Queries over texts: sentences, paragraphs, claims, quotes, similarity, passages, absence, links, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import findings, intervals, rates, retrieval
from assaykit.plans.registry import query, table

# Sentences with the white space after them, by the same rule in SQL.
_masked = "text"
for _a in tx.ABBREVIATIONS:
    _masked = f"replace({_masked}, '{_a}', replace('{_a}', '.', chr(1)))"
_PIECES = f"""list_transform(string_split(regexp_replace({_masked}, '([.!?])([ \\t\\r\\n]+)([A-Z(\\[])', '\\1\\2' || chr(30) || '\\3', 'g'), chr(30)), lambda s: replace(s, chr(1), '.'))"""
SENTENCES_SQL = f"""
p AS (SELECT doc_id, lang, unnest(range(len(x))) AS ordinal, unnest(x) AS piece FROM (SELECT doc_id, lang, {_PIECES} AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, lang, ordinal, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
"""


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ordinal, piece, start, stop of each sentence; stop leaves the white space out."""
    pieces = docs.select("doc_id", "lang", F.posexplode(tx.masked_sentences(F.col("text"))).alias("ordinal", "piece")).withColumn("n", F.length("piece"))
    out = intervals.running_starts(pieces, "doc_id", "ordinal", "n")
    return out.select("doc_id", "lang", F.col("ordinal").cast("long"), "piece", "start", (F.col("start") + F.length(F.rtrim(F.translate("piece", "\n\t\r", "   ")))).alias("stop"))


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, ordinal, start, start + length(rtrim(translate(piece, chr(10) || chr(9) || chr(13), '   '))) AS stop, md5(piece) AS digest FROM s")
def q02_doc_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents")).select("doc_id", "ordinal", "start", "stop", F.md5("piece").alias("digest"))


@query(f"""
WITH {SENTENCES_SQL}, c AS (SELECT lang, doc_id, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) AS k, count(*) OVER (PARTITION BY lang) AS docs FROM c)
SELECT lang, min(n) AS median, max(docs) AS n FROM r WHERE k >= docs // 2 + 1 GROUP BY lang
""")
def q03_sentence_census(spark: SparkSession, d: str) -> DataFrame:
    counts = sentences(table(spark, d, "documents")).groupBy("lang", "doc_id").agg(F.count("*").alias("n_sentences"))
    return rates.upper_median(counts, "lang", "n_sentences")


@query("""
WITH p AS (SELECT doc_id, unnest(range(len(x))) AS ordinal, unnest(x) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, ordinal, length(block) AS n, CAST(sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(block) - 1 AS start FROM p)
SELECT doc_id, ordinal, n, start FROM s WHERE n >= 120
""")
def q04_paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "block"))
    sized = blocks.select("doc_id", F.col("ordinal").cast("long"), F.length("block").cast("long").alias("n"), (F.length("block") + 1).alias("step"))
    return intervals.running_starts(sized, "doc_id", "ordinal", "step").filter("n >= 120").drop("step")


# Words whose places are looked for.
KEYWORDS = ("the", "and", "license", "est", "und", "que")


@query(f"""
WITH {SENTENCES_SQL}
SELECT doc_id, ordinal, start, list_sort(list_filter({list(KEYWORDS)}, lambda w: list_contains(string_split_regex(lower(piece), '[^a-z]+'), w))) AS keys FROM s
WHERE len(list_filter({list(KEYWORDS)}, lambda w: list_contains(string_split_regex(lower(piece), '[^a-z]+'), w))) >= 2
""")
def q16_interval_join_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that hold two keywords or more. Places of words are found in the whole text and joined to the sentence they lie in."""
    docs = table(spark, d, "documents")
    own = sentences(docs)
    # texts are cut before each keyword, so only as many pieces move as there are keywords; a keyword's place is what stands before its piece
    word = f"(?:{'|'.join(KEYWORDS)})(?![a-z])"
    pieces = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), f"(?<![a-z])(?={word})")).alias("k", "piece")).select("doc_id", "k", F.length("piece").alias("n"), F.regexp_extract("piece", f"^{word}", 0).alias("key"))
    placed = intervals.running_starts(pieces, "doc_id", "k", "n").filter("key <> ''").select("doc_id", "key", F.col("start").alias("at"))
    hits = intervals.points_inside(placed, own.select("doc_id", "ordinal", F.col("start").alias("s_"), "stop"), ["doc_id"], "at", "s_", "stop", 256)
    keys = hits.groupBy("doc_id", "ordinal", F.col("s_").alias("start")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return keys.filter(F.size("keys") >= 2)


QUOTES_SQL = """
q AS (SELECT item_id, regexp_replace(trim(text), '[ \\t\\r\\n]+', ' ', 'g') AS quote FROM benchmark UNION ALL SELECT 1000000, 'short one' UNION ALL SELECT 1000001, 'MIT License.'),
t AS (SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g') AS text FROM documents)
"""


@query(f"""
WITH {QUOTES_SQL}, m AS (SELECT item_id, doc_id, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n, instr(text, quote) - 1 AS at_ FROM q, t WHERE length(quote) >= 12 AND contains(text, quote)),
a AS (SELECT item_id, sum(n) AS n, count(*) AS docs, min(doc_id) AS doc_id, arg_min(at_, doc_id) AS at_ FROM m GROUP BY 1)
SELECT q.item_id, CASE WHEN length(quote) < 12 THEN 'too-short' WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'located' END AS verdict, CAST(coalesce(n, 0) AS BIGINT) AS n_found,
       CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n = 1 THEN at_ END AS start FROM q LEFT JOIN a USING (item_id)
""")
def q20_quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where each quote stands in the corpus, white space aside: exactly once, or not at all. The quotes are the stated query set:
    each text is read through once, by one automaton for all of them."""
    clean = lambda c: F.regexp_replace(c, r"[ \t\r\n]+", " ")
    quotes = table(spark, d, "benchmark").select("item_id", clean(F.trim("text")).alias("quote"))
    quotes = quotes.union(spark.createDataFrame([(1000000, "short one"), (1000001, "MIT License.")], "item_id long, quote string"))
    docs = table(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("text"))
    hits = retrieval.quote_hits(docs, quotes.filter(F.length("quote") >= 12), "doc_id", "item_id")
    per = hits.groupBy("item_id").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc"), F.min_by("at", "doc_id").alias("at"))
    out = quotes.join(per, "item_id", "left")
    verdict = F.when(F.length("quote") < 12, "too-short").when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").otherwise("located")
    one = F.col("n") == 1
    return out.select("item_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_found"), F.when(one, F.col("doc")).alias("doc_id"), F.when(one, F.col("at")).alias("start"))


_FOLD = f"translate(replace(replace(replace({{}}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({_FOLD}), '[a-z0-9]+')), lambda w: NOT list_contains({list(tx.TITLE_STOP)}, w))"
TITLES_SQL = f"""
a AS (SELECT doc_id, {_TOKENS.format("string_split(text, chr(10))[1]")} AS t FROM documents), b AS (SELECT item_id, {_TOKENS.format("text")} AS t FROM benchmark),
x AS (SELECT doc_id, item_id, len(list_intersect(a.t, b.t)) AS n_shared, len(a.t) AS na, len(b.t) AS nb FROM a, b)
"""


def titles(spark: SparkSession, d: str) -> DataFrame:
    first = tx.title_tokens(F.substring_index("text", "\n", 1))
    docs = table(spark, d, "documents").select("doc_id", first.alias("tokens"))
    items = table(spark, d, "benchmark").select("item_id", tx.title_tokens(F.col("text")).alias("tokens"))
    return retrieval.shared_token_pairs(docs, items, "doc_id", "item_id", "tokens")


@query(f"""
WITH {TITLES_SQL}, j AS (SELECT doc_id, item_id, n_shared / (na + nb - n_shared)::DOUBLE AS s FROM x WHERE n_shared > 0)
SELECT doc_id, item_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS k FROM j WHERE s >= 0.1) WHERE k = 1
""")
def q21_title_jaccard_best(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("n_shared") / (F.col("n_left") + F.col("n_right") - F.col("n_shared"))
    return retrieval.best_match(titles(spark, d).withColumn("score", score), "doc_id", "score", "item_id", 0.1).select("doc_id", "item_id", F.round("score", 6).alias("score"))


@query(f"WITH {TITLES_SQL} SELECT doc_id, item_id, round(n_shared / least(na, nb)::DOUBLE, 6) AS score FROM x WHERE n_shared > 0 AND n_shared / least(na, nb)::DOUBLE >= 0.25")
def q22_title_overlap_coeff(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("n_shared") / F.least("n_left", "n_right")
    return titles(spark, d).withColumn("raw", score).filter("raw >= 0.25").select("doc_id", "item_id", F.round("raw", 6).alias("score"))


@query(f"""
WITH {TITLES_SQL}, j AS (SELECT doc_id, item_id, n_shared / least(na, nb)::DOUBLE AS o FROM x WHERE n_shared > 0)
SELECT CASE WHEN o < 0.35 THEN 'high' WHEN o < 0.55 THEN 'med' ELSE 'none' END AS band, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM j GROUP BY 1
""")
def q24_mismatch_bands(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("n_shared") / F.least("n_left", "n_right")
    band = F.when(o < 0.35, "high").when(o < 0.55, "med").otherwise("none")
    return titles(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("""
WITH n AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'van der Berg, Anna' WHEN 1 THEN 'Müller, Jörg' WHEN 2 THEN 'Ada Lovelace' END AS ours, CASE s_suppkey % 3 WHEN 0 THEN 'Anna van der Berg' WHEN 1 THEN 'Jorg Muller' ELSE 'Ada King' END AS theirs FROM supplier)
SELECT s_suppkey, CASE WHEN ours IS NULL THEN '' WHEN ours LIKE 'van%' THEN 'berg' WHEN ours LIKE 'M%' THEN 'muller' ELSE 'lovelace' END AS ours, CASE WHEN theirs LIKE 'Anna%' THEN 'berg' WHEN theirs LIKE 'J%' THEN 'muller' ELSE 'king' END AS theirs,
       CASE WHEN ours IS NULL THEN NULL ELSE (ours LIKE 'van%' AND theirs LIKE 'Anna%') OR (ours LIKE 'M%' AND theirs LIKE 'J%') END AS agree FROM n
""")
def q23_surname_agreement(spark: SparkSession, d: str) -> DataFrame:
    m4, m3 = F.col("s_suppkey") % 4, F.col("s_suppkey") % 3
    ours = F.when(m4 == 0, "van der Berg, Anna").when(m4 == 1, "Müller, Jörg").when(m4 == 2, "Ada Lovelace")
    theirs = F.when(m3 == 0, "Anna van der Berg").when(m3 == 1, "Jorg Muller").otherwise("Ada King")
    rows = table(spark, d, "supplier").select("s_suppkey", ours.alias("a"), theirs.alias("b"))
    return rows.select("s_suppkey", tx.surname(F.col("a")).alias("ours"), tx.surname(F.col("b")).alias("theirs"), tx.authors_agree(F.array("a"), F.array("b")).alias("agree"))


# A claim's terms.
CLAIM = ("license", "version", "nicht", "that", "elle", "with", "erhe", "onthe", "aber", "para", "inor", "wher")
_TERMS = f"list_filter(list_distinct(list_transform(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z][a-z0-9-]{{{{2,}}}}'), lambda w: rtrim(w, '-'))), lambda w: NOT list_contains({list(tx.TERM_STOP)}, w))"


@query(f"""
WITH b AS (SELECT doc_id, unnest(range(len(x))) AS start, unnest(x) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, start, list_intersect({_TERMS.format("block")}, {list(CLAIM)}) AS shared FROM b), n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1),
e AS (SELECT doc_id, start, unnest(shared) AS term FROM t), f AS (SELECT doc_id, term, count(*) AS df FROM e GROUP BY 1, 2),
s AS (SELECT doc_id, start, sum(ln(n / (1 + df)::DOUBLE) + 1) AS score, list_sort(list(term)) AS shared FROM e JOIN f USING (doc_id, term) JOIN n USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, start, round(score, 6) AS score, shared, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, start) AS k FROM s WHERE score > 0) WHERE k <= 3
""")
def q27_idf_passages_topk(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("start", "block"))
    rows = blocks.select("doc_id", F.col("start").cast("long"), tx.terms(F.col("block")).alias("terms"))
    out = retrieval.passages_top_k(rows, list(CLAIM), 3)
    return out.select("doc_id", "start", F.round("score", 6).alias("score"), "shared", F.col("k").cast("long"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_TERMS.format("text")} AS a FROM conversations), p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 6) AS relatedness FROM p
""")
def q28_relatedness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.relatedness(F.col("text"), F.col("before")), 6).alias("relatedness"))


@query("SELECT doc_id, lang FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'the') OR contains(lower(text), 'que'))")
def q29_absence_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(retrieval.none_occurs(F.col("text"), ["license", "the", "que"])).select("doc_id", "lang")


@query("""
SELECT doc_id, len(c) AS n_claims, list_slice(c, 1, 3) AS shown, CASE WHEN len(c) > 2 THEN 'high' ELSE 'med' END AS severity
FROM (SELECT doc_id, regexp_extract_all(lower(text), 'licen[sc]ed?') AS c FROM documents WHERE NOT regexp_matches(text, '@|[0-9]{3}')) WHERE len(c) > 0
""")
def q30_doc_level_absence(spark: SparkSession, d: str) -> DataFrame:
    """Documents that claim something and support it nowhere."""
    claims = F.regexp_extract_all(F.lower("text"), F.lit("licen[sc]ed?"), 0)
    rows = table(spark, d, "documents").filter(~F.col("text").rlike("@|[0-9]{3}")).select("doc_id", claims.alias("c")).filter(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("n_claims"), F.slice("c", 1, 3).alias("shown"), F.when(F.size("c") > 2, "high").otherwise("med").alias("severity"))


def _hrefs() -> Column:
    return F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
s AS (SELECT DISTINCT '/' || array_to_string(list_slice(p, i, len(p)), '/') AS suffix FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS p FROM pages)))
SELECT page_id, target, count(*) AS n FROM h WHERE target LIKE '/%' AND target NOT IN (SELECT suffix FROM s) GROUP BY 1, 2
""")
def q34_entrypoint_missing(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are the end of no page's path. All ends of all paths are derived, so an equality join finds them."""
    pages = table(spark, d, "pages")
    targets = pages.select("page_id", F.explode(_hrefs()).alias("target")).filter(F.col("target").startswith("/"))
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/")
    ends = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("target")).distinct()
    return targets.join(ends, "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT page_id, regexp_replace(u, '[.,;:]+$', '') AS u FROM (SELECT page_id, unnest(regexp_extract_all(url || ' see http://hub.example.org/models/' || page_id || '.ckpt, https://data.example.org/dataset/' || (page_id % 7) || ';', 'https?://[^ <>"]+')) AS u FROM pages))
SELECT page_id, u AS link, CASE WHEN regexp_matches(lower(u), 'ckpt|checkpoint|weights|models') THEN 'checkpoint' WHEN contains(lower(u), 'dataset') THEN 'dataset' ELSE 'link' END AS kind FROM u
""")
def q35_url_links_kind(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    readme = F.concat("url", F.lit(" see http://hub.example.org/models/"), page, F.lit(".ckpt, https://data.example.org/dataset/"), (F.col("page_id") % 7).cast("string"), F.lit(";"))
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(readme, F.lit('https?://[^ <>"]+'), 0)).alias("raw"))
    link = F.regexp_replace("raw", "[.,;:]+$", "")
    kind = F.when(F.lower(link).rlike("ckpt|checkpoint|weights|models"), "checkpoint").when(F.contains(F.lower(link), F.lit("dataset")), "dataset").otherwise("link")
    return links.select("page_id", link.alias("link"), kind.alias("kind"))


@query("""
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)
""")
def q36_markup_to_plain(spark: SparkSession, d: str) -> DataFrame:
    """Tags become spaces first, then entities are read; the ampersand last, so nothing is read twice."""
    t = F.regexp_replace("html", "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.k') AS value FROM events")
def q37_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    leaves = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(leaves).alias("name", "value"))


@query("""
SELECT doc_id, CASE WHEN len(n) = 1 THEN CAST(n[1] AS DOUBLE) END AS number, len(n) AS n_tokens, CASE WHEN len(n) = 1 AND contains(n[1], '.') THEN length(string_split(n[1], '.')[2]) WHEN len(n) = 1 THEN 0 END AS n_decimals
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{1,12}(?:\\.[0-9]{1,6})?') AS n FROM documents) WHERE len(n) > 0
""")
def q38_cell_single_number(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract_all("text", F.lit(r"[0-9]{1,12}(?:\.[0-9]{1,6})?"), 0)
    rows = table(spark, d, "documents").select("doc_id", n.alias("n")).filter(F.size("n") > 0)
    one, first = F.size("n") == 1, F.element_at("n", 1)
    return rows.select("doc_id", F.when(one, first.cast("double")).alias("number"), F.size("n").cast("long").alias("n_tokens"), F.when(one, tx.decimals(first)).cast("long").alias("n_decimals"))


@query("""
SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda t: CAST(t AS DOUBLE) >= 10 AND NOT CAST(t AS DOUBLE) BETWEEN 1900 AND 2100),
  lambda t: regexp_replace(CASE WHEN contains(t, '.') THEN regexp_replace(t, '[.]?0+$', '') ELSE t END, '^0+([1-9])', '\\1')))) AS numbers FROM documents WHERE regexp_matches(text, '[0-9]{2}')
""")
def q51_numbers_weighting(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("text").rlike("[0-9]{2}")).select("doc_id", F.array_sort(tx.number_texts(F.col("text"))).alias("numbers"))


@query("SELECT doc_id, n FROM (SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text))")
def q52_once_only_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each text, with how often it occurs; only digests move."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("""
WITH p AS (SELECT doc_id, unnest(range(len(x))) AS ordinal, unnest(x) AS line, n FROM (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, ordinal, line, n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(line) - 1 AS start FROM p)
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS stop FROM s WHERE length(line) BETWEEN 2 AND 40
""")
def q53_sections_by_lead(spark: SparkSession, d: str) -> DataFrame:
    """Short lines read as headings: a section lasts to the next one."""
    lines = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("step", F.length("line") + 1)
    heads = intervals.running_starts(lines, "doc_id", "ordinal", "step").filter(F.length("line").between(2, 40))
    return intervals.next_start(heads, "doc_id", "start", F.col("n")).select("doc_id", "start", "stop")


@query("""
WITH p AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
d AS (SELECT doc_id, line, regexp_extract(t, '(MIT|Apache|GNU|CC BY)', 1) AS reason FROM p WHERE regexp_matches(t, '(MIT|Apache|GNU|CC BY)') AND regexp_matches(t, 'icense')),
f AS (SELECT doc_id, line, length(t) AS n FROM p WHERE length(t) < 80),
c AS (SELECT doc_id, line, line AS own, reason FROM d UNION ALL SELECT doc_id, line + 1, line, reason FROM d)
SELECT doc_id, line, n, arg_min(reason, own) AS directive FROM f LEFT JOIN c USING (doc_id, line) GROUP BY ALL
""")
def q19_inline_directive_match(spark: SparkSession, d: str) -> DataFrame:
    """Licence lines as directives: each covers its own line and the next; a line takes the first that covers it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t")).select("doc_id", (F.col("k") + 1).alias("line"), "t")
    found = lines.filter(F.col("t").rlike("MIT|Apache|GNU|CC BY") & F.contains("t", F.lit("icense"))).select("doc_id", "line", F.lit("short-line").alias("rule"), F.regexp_extract("t", "(MIT|Apache|GNU|CC BY)", 1).alias("reason"))
    short = lines.filter(F.length("t") < 80).select("doc_id", "line", F.length("t").cast("long").alias("n"), F.lit("short-line").alias("rule"))
    return findings.directed(short, found).select("doc_id", F.col("line").cast("long"), "n", "directive")
