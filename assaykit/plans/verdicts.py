"""Each rule over slices made from tables, so that SQL can say which findings must come out: severity, message and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.plans.numeric import T_TEST_SQL, t_tests
from assaykit.plans.registry import query, table
from assaykit.plans.rules import RULES


def _found(id: str, **slices: DataFrame) -> DataFrame:
    """doc_id, severity, message, anchors (joined) of one rule's findings."""
    out, _ = RULES[id].run({name: slices[name] for name in RULES[id].requires})
    return out.select("doc_id", "severity", "message", F.array_join("anchors", " ").alias("anchors"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, k, n: a paper for each part; k tells the cases apart, n is a number of its own."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("n"))


_PARTS = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_partkey AS k, CAST(p_size AS BIGINT) AS n FROM part)"


def _rows(papers: DataFrame, schema: str, *rows: tuple) -> DataFrame:
    """The same rows for each paper: values and columns of the paper, under the names and types of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split(" ", 1)[1] for x in schema.split(", ")]
    one = lambda row: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(c) for v, c, t in zip(row, names, kinds)])
    return papers.select("doc_id", F.explode(F.array(*map(one, rows))).alias("r")).select("doc_id", "r.*")


def _case(*texts: str | Column) -> Column:
    """The text for each remainder of k by their number."""
    out = F.lit(None).cast("string")
    for i, x in reversed(list(enumerate(texts))):
        out = F.when(F.col("k") % len(texts) == i, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
    return out


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_CELL = "table int, name string, row int, col int, text string, number double, decimals int, irregular boolean, start int"

@query(f"""
WITH {_PARTS} SELECT doc_id, 'high' AS severity, 'the text reports accuracy of ' || (n + 50 + k % 3) || ', but table 1 reports ' || CAST((n + 50)::DOUBLE AS VARCHAR) || ' for the same quantity' AS message, 'paper@7 paper@20' AS anchors
FROM p WHERE k % 3 > 0 AND (k % 3) / (n + 50)::DOUBLE <= 0.02
""")
def q73_rule_internal_mismatch(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    cells = _rows(p, _CELL, (0, "table 1", 0, 1, "Accuracy:", None, 0, False, 10), *[(0, "table 1", i + 1, 1, "x", n + 50 + 10 * i, 0, False, 20 + i) for i in range(3)], (1, "table 2", 0, 1, "Accuracy", None, 0, True, 40), (1, "table 2", 1, 1, "x", n + 51, 0, True, 41))
    return _found("numbers/internal-mismatch", numbers=_rows(p, "label string, raw string, start int", ("accuracy", n + 50 + k % 3, 7)), cells=cells)


@query(f"""
WITH {_PARTS} SELECT doc_id, 'med' AS severity, 'table 1 states a total of ' || CAST((2 * n + 3 + k % 4)::DOUBLE AS VARCHAR) || ', but its 3 entries sum to ' || CAST((2 * n + 3)::DOUBLE AS VARCHAR) AS message, 'paper@50 paper@11' AS anchors FROM p WHERE k % 4 >= 2
UNION ALL SELECT doc_id, 'low', 'table 2 column Share (%) reads as shares of a whole but sums to ' || CAST((100 + k % 3 * 2)::DOUBLE AS VARCHAR), 'paper@61 paper@63' FROM p WHERE k % 3 > 0
""")
def q74_rule_table_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    row = lambda i, label, value, at: [(0, "table 1", i, 0, label, None, 0, False, at - 1), (0, "table 1", i, 1, "v", value, 0, False, at)]
    sums = [*row(1, "One", n, 11), *row(2, "Two", n + 1, 21), *row(3, "Three", F.lit(2), 31), *row(4, "Total:", 2 * n + 3 + k % 4, 50)]
    shares = [(1, "table 2", 0, 1, "Share (%)", None, 0, False, 60), (1, "table 2", 1, 1, "v", F.lit(50), 0, False, 61), (1, "table 2", 2, 1, "v", F.lit(30), 0, False, 62), (1, "table 2", 3, 1, "v", 20 + k % 3 * 2, 0, False, 63)]
    return _found("numbers/table-arithmetic", cells=_rows(_parts(spark, d), _CELL, *sums, *shares))


@query("""
WITH m AS (SELECT l_partkey, count(*) AS g, CAST(sum(l_quantity) AS BIGINT) AS k FROM lineitem GROUP BY 1),
p AS (SELECT l_partkey, g, (2 * k * 100 + g) // (2 * g) + (l_partkey % 3) AS u FROM m WHERE g < 100),
c AS (SELECT *, list_transform(range(0, 4), lambda i: u * g // 100 - 1 + i) AS sums FROM p),
v AS (SELECT *, list_sort(list_transform(list_slice(list_sort(list_transform(list_distinct(list_transform(sums, lambda s: (200 * s + g) // (2 * g))), lambda x: {'d': abs(x - u), 'v': x})), 1, 2), lambda x: x.v)) AS near
      FROM c WHERE len(list_filter(sums, lambda s: abs(200 * s - 2 * u * g) < g OR 200 * s - 2 * u * g = -g OR (200 * s - 2 * u * g = g AND u % 2 = 0))) = 0)
SELECT CAST(l_partkey AS VARCHAR) AS doc_id, CASE WHEN l_partkey % 2 = 0 THEN 'med' ELSE 'high' END AS severity,
       'mean ' || printf('%.2f', u / 100.0) || ' is not attainable from N=' || g || ' whole responses; nearest: ' || array_to_string(list_transform(near, lambda x: CAST(x / 100.0 AS VARCHAR)), ', ') AS message, 'paper@5 paper@9' AS anchors FROM v
""")
def q75_rule_grim(spark: SparkSession, d: str) -> DataFrame:
    """A mean of whole quantities for each part, some moved; its sample size stands in its sentence, its section or elsewhere, in turn."""
    k = F.col("k")
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("g"), F.sum("l_quantity").cast("long").alias("s"))
    p = sums.select(F.col("l_partkey").cast("string").alias("doc_id"), F.col("l_partkey").alias("k"), "g", F.expr("(200 * s + g) div (2 * g) + l_partkey % 3").alias("u"))
    means = p.select("doc_id", F.format_string("%.2f", F.col("u") / 100.0).alias("raw"), F.lit(1).alias("items"), (k % 2 == 0).alias("items_inferred"), F.lit(5).alias("start"), F.lit(0).alias("sentence"), F.lit(0).alias("section"))
    sizes = p.select("doc_id", F.col("g").alias("n"), F.lit(9).alias("start"), F.when(k % 3 == 0, 0).otherwise(1).alias("sentence"), F.when(k % 3 < 2, 0).otherwise(1).alias("section"))
    return _found("stats/grim", means=means, sizes=sizes)


@query(f"""
WITH {T_TEST_SQL} SELECT CAST(l_partkey AS VARCHAR) AS doc_id, CASE WHEN verdict = 'decision' THEN 'high' ELSE 'med' END AS severity,
  't = ' || printf('%.3f', stat) || ' gives p = ' || CASE WHEN p < 1e-4 THEN printf('%.2e', p) ELSE printf('%.4f', p) END || ', not ' || printf('%.3f', printed) AS message, 'paper@3 paper@30' AS anchors FROM v WHERE verdict IN ('decision', 'inconsistent')
""")
def q76_rule_pvalue_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = t_tests(spark, d).select(F.col("l_partkey").cast("string").alias("doc_id"), "kind", F.format_string("%.3f", "stat").alias("statistic_raw"), "df1", F.lit(None).cast("double").alias("df2"), F.lit("=").alias("comparator"), F.format_string("%.3f", "printed").alias("p_raw"), F.lit(2).alias("tail"), F.lit(3).alias("start"), F.lit(30).alias("end"))
    return _found("stats/pvalue-mismatch", tests=rows)


_WORDS = ("It was significantly better. It was Significantly\nimproved. A significant gain, and (reliably outperforms) all.", "It was significantly better (p < .05).", "A significant effect was seen; insignificantly better ones, and significantly, better ones.", "Nothing is claimed here at all.", "It significantly outperformed the rest (SD 3).", "It significantly reduces cost, by a t-test.", "statistically significant. The SDK was used, and p was not given.")


@query(f"""
WITH {_PARTS} SELECT doc_id, CASE WHEN k % 7 = 0 THEN 'high' ELSE 'med' END AS severity,
  CASE k % 7 WHEN 0 THEN '4 claims of significance, the first ''significantly better''' WHEN 2 THEN '1 claims of significance, the first ''significant effect''' ELSE '1 claims of significance, the first ''statistically significant''' END || ', and no test anywhere' AS message,
  CASE k % 7 WHEN 0 THEN 'text@8 text@37 text@63' WHEN 2 THEN 'text@3' ELSE 'text@1' END AS anchors FROM p WHERE k % 7 IN (0, 2, 6)
""")
def q77_rule_significance_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return _found("stats/significance-unsupported", text=_parts(spark, d).select("doc_id", _case(*_WORDS).alias("text")))


def _entries(p: DataFrame, title: Column, year: Column, doi: Column, author: Column, kind: Column) -> DataFrame:
    fields = F.create_map(F.lit("title"), title, F.lit("year"), year, F.lit("doi"), doi, F.lit("author"), author)
    return p.select("doc_id", F.lit("a").alias("key"), kind.alias("entry_type"), fields.alias("fields"), F.lit(4).alias("start"))


def _records(p: DataFrame, status: Column, registration: Column, by: Column, title: Column, year: Column, authors: Column) -> DataFrame:
    return p.select("doc_id", F.lit("a").alias("key"), status.alias("status"), registration.alias("registration"), by.alias("matched_by"), title.alias("title"), year.alias("year"), authors.alias("authors"))


def _none() -> Column:
    return F.lit(None).cast("string")


@query(f"""
WITH {_PARTS} SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'med' ELSE 'high' END AS severity, '''a'' has DOI 10.1/' || k || ', which is not registered' AS message, 'bib@4' AS anchors FROM p WHERE k % 4 = 0
""")
def q78_rule_unresolved(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    bib = _entries(p, F.lit("T"), F.lit("2020"), _cat("https://doi.org/10.1/", k), _none(), F.when(n % 2 == 0, "misc").otherwise("article"))
    res = _records(p, _case("not-found", "found", "not-found", "unknown"), _case("dead", "registered", "unchecked", "dead"), _none(), _none(), _none(), F.lit(None).cast("array<string>"))
    return _found("bib/unresolved", bib=bib, resolutions=res)


@query(f"""
WITH {_PARTS} SELECT doc_id, CASE k % 5 WHEN 1 THEN 'high' ELSE 'med' END AS severity, '''a'' is titled ''Sparse Heads in Neural Retrieval'', but its DOI is that of ''' || CASE k % 5 WHEN 4 THEN 'Sparse Heads of Lettuce and Cabbage' ELSE 'A Study of Lamps' END || '''' AS message, 'bib@4 index:10.1/' || k AS anchors FROM p WHERE k % 5 IN (1, 3, 4)
""")
def q79_rule_doi_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """The same title, another by others, another by the same authors, another by nobody named, half another."""
    k = F.col("k")
    p = _parts(spark, d)
    title = _case("Sparse heads in neural retrieval!", "A Study of Lamps", "A Study of Lamps", "A Study of Lamps", "Sparse Heads of Lettuce and Cabbage")
    authors = F.when(k % 5 == 3, F.lit(None).cast("array<string>")).when(k % 5 == 2, F.array(F.lit("Ben Okoye"))).otherwise(F.array(F.lit("Mei Ito")))
    bib = _entries(p, F.lit("Sparse Heads in Neural Retrieval"), F.lit("2020"), _cat("doi:10.1/", k), F.lit("Okoye, Ben and Reyes, Ana"), F.lit("article"))
    return _found("bib/doi-mismatch", bib=bib, resolutions=_records(p, F.lit("found"), F.lit("registered"), F.lit("doi"), title, F.lit("2020"), authors))


@query(f"""
WITH {_PARTS} SELECT doc_id, 'med' AS severity, '''a'' gives the year ' || (2000 + n) || ', the record ' || (2000 + n + k % 3) AS message, 'bib@4 index:10.1/x' AS anchors FROM p WHERE k % 3 > 0 AND k % 2 = 0
""")
def q80_rule_metadata_drift(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    bib = _entries(p, F.lit("T"), _cat("May ", 2000 + n), F.lit("10.1/x"), _none(), F.lit("article"))
    return _found("bib/metadata-drift", bib=bib, resolutions=_records(p, F.lit("found"), F.lit("registered"), _case("doi", "title"), F.lit("T"), (2000 + n + k % 3).cast("string"), F.lit(None).cast("array<string>")))


@query("""
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, 'k' || (c_custkey % 60) AS key, c_custkey AS start FROM customer), b AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS doc_id, 'k' || (c_custkey % 70) AS key FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0),
u AS (SELECT doc_id, key, count(*) AS n, list_slice(list_sort(list(start)), 1, 3) AS f FROM c WHERE doc_id IN (SELECT doc_id FROM b) AND (doc_id, key) NOT IN (SELECT doc_id, key FROM b) GROUP BY 1, 2),
o AS (SELECT doc_id, count(*) AS n, list_slice(list_sort(list(key)), 1, 8) AS f FROM b WHERE (doc_id, key) NOT IN (SELECT doc_id, key FROM c) GROUP BY 1)
SELECT doc_id, 'med' AS severity, '''' || key || ''' is cited ' || n || ' times and has no entry' AS message, array_to_string(list_transform(f, lambda x: 'paper@' || x), ' ') AS anchors FROM u
UNION ALL SELECT doc_id, 'low', n || ' entries are never cited: ' || array_to_string(f, ', '), 'bib@3' FROM o
""")
def q81_rule_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nations as papers, customers as citations and entries; one nation has no entries, so nothing can be said of it."""
    people = table(spark, d, "customer").withColumn("doc_id", F.col("c_nationkey").cast("string"))
    cites = people.select("doc_id", _cat("k", F.col("c_custkey") % 60).alias("key"), F.col("c_custkey").alias("start"))
    bib = people.filter("c_acctbal > 0 AND c_nationkey > 0").select("doc_id", _cat("k", F.col("c_custkey") % 70).alias("key")).distinct().withColumns({"entry_type": F.lit("article"), "start": F.lit(3)})
    return _found("bib/orphans", citations=cites, bib=bib)


@query(f"WITH {_PARTS} SELECT doc_id, 'low' AS severity, '''a'' was found in no index' AS message, 'bib@4' AS anchors FROM p WHERE k % 3 = 0 AND n % 2 = 1")
def q82_rule_unindexed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    p = _parts(spark, d)
    bib = _entries(p, F.lit("T"), F.lit("2020"), _case("", "10.1/x", ""), _none(), F.when(n % 2 == 0, "misc").otherwise("book"))
    return _found("bib/unindexed", bib=bib, resolutions=_records(p, _case("not-found", "not-found", "unknown"), _none(), _none(), _none(), _none(), F.lit(None).cast("array<string>")))


@query(f"""
WITH {_PARTS} SELECT doc_id, CASE WHEN k % 5 = 2 THEN 'low' ELSE 'high' END AS severity, 'the paper states learning rate 3e-4, the code uses ' || CASE k % 5 WHEN 1 THEN '1e-4' ELSE '0.03' END AS message, 'paper@8 local.yaml@30' AS anchors FROM p WHERE k % 5 IN (1, 2)
""")
def q83_rule_hparam_drift(spark: SparkSession, d: str) -> DataFrame:
    """The value stated, another, one that differs by a unit, two at one strength, a weaker one that differs."""
    k = F.col("k")
    p = _parts(spark, d)
    strong = _case("0.0003", "1e-4", "0.03", "1e-4", "3e-4")
    rows = [("train.py", "lr", strong, 20, 20), ("conf.yaml", "learning-rate", F.lit("9"), 10, 5), ("local.yaml", "LR", F.when(k % 5 == 3, "2e-4").otherwise(strong), 20, 30)]
    return _found("repro/hparam-drift", hyperparameters=_rows(p, "label string, raw string, start int", ("learning rate", "3e-4", 8)), configs=_rows(p, "path string, raw_name string, value string, binding int, start int", *rows))


@query(f"WITH {_PARTS} SELECT doc_id, 'high' AS severity, 'the paper reports ' || n || ' runs, the code sets the seed to 7 only' AS message, 'paper@12 a.py@3' AS anchors FROM p WHERE k % 3 = 0 AND n >= 2")
def q84_rule_seed_claim(spark: SparkSession, d: str) -> DataFrame:
    """One literal, two literals, one that varies."""
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    seeds = _rows(p, "path string, argument string, varies boolean, start int", ("a.py", "7", F.lit(False), 3), ("b.py", F.when(k % 3 == 1, "8").when(k % 3 == 0, "7"), k % 3 == 2, 1))
    return _found("repro/seed-claim", runs=_rows(p, "n long, start int", (n, 12), (99, 40)), seeds=seeds)


@query(f"WITH {_PARTS} SELECT doc_id, 'med' AS severity, 'the README runs ''eval' || n || '.py'', which is not there' AS message, 'README:eval' || n || '.py' AS anchors FROM p WHERE k % 2 = 1")
def q85_rule_entrypoint_missing(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    return _found("repro/entrypoint-missing", entrypoints=_rows(_parts(spark, d), "target string, exists boolean", ("train.py", True), (_cat("eval", n, ".py"), k % 2 == 0)))


@query(f"WITH {_PARTS} SELECT doc_id, CASE k % 4 WHEN 0 THEN 'high' ELSE 'med' END AS severity, 'the repository has 2 files and none is code' AS message, 'repo:LICENSE' AS anchors FROM p WHERE k % 4 < 2")
def q86_rule_ghost_repo(spark: SparkSession, d: str) -> DataFrame:
    files = _rows(_parts(spark, d), "path string, content string", ("LICENSE", "MIT"), (_case("README.md", "docs/index.rst", "train.py", "src/run.sh"), "Code will be released soon."))
    return _found("repro/ghost-repo", files=files)


@query(f"WITH {_PARTS} SELECT doc_id, 'low' AS severity, CASE k % 3 WHEN 0 THEN '3 of 4 dependencies have no exact version: numpy, scipy, torch' ELSE '2 of 4 dependencies have no exact version: numpy, scipy' END AS message, CASE k % 3 WHEN 0 THEN 'requirements.txt requirements:numpy, scipy, torch' ELSE 'requirements.txt requirements:numpy, scipy' END AS anchors FROM p WHERE k % 3 < 2 AND n % 5 > 0")
def q87_rule_unpinned_deps(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters, a half, a quarter without a version; a lock file settles it."""
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    deps = _rows(p, "name string, pinned boolean", ("torch", k % 3 > 0), ("numpy", False), ("scipy", k % 3 == 2), ("pandas", True))
    return _found("repro/unpinned-deps", deps=deps, files=_rows(p, "path string", (F.when(n % 5 == 0, "sub/poetry.lock").otherwise("poetry.lock.txt"),)))


def _answers(p: DataFrame, *rows: tuple[str, dict]) -> DataFrame:
    one = lambda field, record: F.struct(F.lit(field).alias("field"), F.create_map(*[x for a, b in record.items() for x in (F.lit(a), b if isinstance(b, Column) else F.lit(b))]).alias("record"))
    return p.select("doc_id", F.explode(F.array(*[one(*r) for r in rows])).alias("r")).select("doc_id", "r.*")


def _text(p: DataFrame, *parts) -> DataFrame:
    return p.select("doc_id", _cat(*parts).alias("text"), F.lit(0).alias("body_start"))


@query(f"WITH {_PARTS} SELECT doc_id, 'high' AS severity, 'the claim at ''Recall on long documents always rises'' is contradicted by ''a'': ''recall on long documents fell by ' || n || ' points''' AS message, 'paper@3 cited:a' AS anchors FROM p WHERE k % 5 = 0")
def q88_rule_citation_support(spark: SparkSession, d: str) -> DataFrame:
    """A quote that is there once, one that isn't there, a verdict of support, a quote off the topic, a work without a text."""
    n, k = F.col("n"), F.col("k")
    p, claim = _parts(spark, d), "Recall on long documents always rises"
    quote = _cat("recall on long documents fell by ", n, " points")
    cited = _cat("In our tests ", quote, ". The weather was fine on most of these days.")
    said = {"key": "a", "claim": claim, "verdict": _case("contradicted", "contradicted", "supported", "contradicted", "contradicted"), "quote": F.when(k % 5 == 1, "recall on long documents doubled").when(k % 5 == 3, "The weather was fine on most").otherwise(quote)}
    claims = p.select("doc_id", F.lit(claim).alias("text"), F.lit(3).alias("start"), F.array(F.lit("a")).alias("keys"))
    texts = p.filter(k % 5 < 4).select("doc_id", F.lit("a").alias("key"), cited.alias("text"))
    return _found("bib/citation-support", claims=claims, bib=p.select("doc_id", F.lit("a").alias("key")), cited_texts=texts, answers=_answers(p, ("citation_verdict", said)), text=_text(p, "x"))


@query(f"WITH {_PARTS} SELECT doc_id, 'med' AS severity, '''substantially'' rests on ' || CAST((n + 1000 + k % 3 * 10)::DOUBLE AS VARCHAR) || ' against ' || CAST((n + 1000)::DOUBLE AS VARCHAR) AS message, 'text@6 paper@9 paper@8' AS anchors FROM p WHERE (k % 3 * 10) / (n + 1000)::DOUBLE < 0.01 AND k % 3 > 0")
def q89_rule_overreach(spark: SparkSession, d: str) -> DataFrame:
    """Equal values stand in two cells, a small gain, a larger one."""
    n, k = F.col("n"), F.col("k")
    p, said = _parts(spark, d), "We are substantially better than the rest."
    ours = n + 1000 + k % 3 * 10
    cells = _rows(p, _CELL, (0, "t", 1, 1, "x", n + 1000, 0, False, 8), (0, "t", 2, 1, "x", ours, 0, False, 9))
    answers = _answers(p, ("comparisons", {"sentence": said, "ours": _cat(ours, "%"), "baseline": (n + 1000).cast("string")}), ("comparisons", {"sentence": "This one was made up to be better clearly outperform.", "ours": "1", "baseline": "1"}))
    return _found("claim/overreach", text=_text(p, "Intro ", said, " End."), cells=cells, answers=answers)


@query(f"WITH {_PARTS} SELECT doc_id, 'med' AS severity, '''all'' is claimed, ' || (1 + k % 2) || ' datasets are evaluated: ' || CASE k % 2 WHEN 0 THEN 'wikismall' ELSE 'newsbig, wikismall' END AS message, 'text@0 text:' || CASE k % 2 WHEN 0 THEN 'wikismall' ELSE 'newsbig, wikismall' END AS anchors FROM p WHERE k % 4 < 2")
def q90_rule_scope_creep(spark: SparkSession, d: str) -> DataFrame:
    """One dataset in the text, two, none, three."""
    p, said = _parts(spark, d), "Our system works on all languages."
    there = _case("WikiSmall is used.", "NewsBig and WikiSmall are used.", "Nothing is used.", "NewsBig, WikiSmall and Third are used.")
    answers = _answers(p, ("scope", {"sentence": said}), ("scope", {"sentence": "Our system works."}), *[("datasets", {"name": x}) for x in ("WikiSmall", "NewsBig", "Third", "x")])
    return _found("claim/scope-creep", text=_text(p, said, " ", there), answers=answers)


@query(f"WITH {_PARTS} SELECT doc_id, 'med' AS severity, 'the claim ''We introduce a lattice decoder for streams.'' has no word in the body' AS message, 'text@0' AS anchors FROM p WHERE k % 3 = 0")
def q91_rule_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """A body without the claim's words, one with a word, one too short to tell."""
    k = F.col("k")
    p, said = _parts(spark, d), "We introduce a lattice decoder for streams."
    body = F.when(k % 3 == 2, F.lit("short")).otherwise(F.concat(_case("", "The lattices are here. ", ""), F.repeat(F.lit("Plain words about nothing in particular. "), F.lit(120))))
    return _found("claim/unsupported", text=_text(p, said, " ", body), answers=_answers(p, ("abstract_claims", {"sentence": said, "terms": "lattice decoder"})))


@query(f"WITH {_PARTS} SELECT doc_id, 'low' AS severity, '''We add a lattice decoder with pruning.'' is nowhere in the repository' AS message, 'text@0' AS anchors FROM p WHERE k % 5 = 0")
def q92_rule_unimplemented(spark: SparkSession, d: str) -> DataFrame:
    """Nowhere, in a file's name, in a symbol, in a setting, and no repository at all."""
    k = F.col("k")
    p, said = _parts(spark, d), "We add a lattice decoder with pruning."
    own = p.filter(k % 5 < 4)
    files = _rows(own, "path string", (_case("train.py", "src/Lattice.py", "train.py", "train.py", "train.py"),))
    symbols = _rows(own, "symbol string", (_case("fit", "fit", "LatticeDecoder", "fit", "fit"),))
    configs = _rows(own, "raw_name string", (_case("lr", "lr", "lr", "use_pruning", "lr"),))
    return _found("claim/unimplemented", text=_text(p, said, " More."), files=files, symbols=symbols, configs=configs, answers=_answers(p, ("contributions", {"sentence": said, "terms": "lattice decoder pruning"})))


@query(f"WITH {_PARTS} SELECT doc_id, 'med' AS severity, 'ours had ' || CAST((n * 1000)::DOUBLE AS VARCHAR) || ', the baseline ' || CAST((n * 400 + k % 3 * 100)::DOUBLE AS VARCHAR) AS message, 'text@0 text@' || (36 + length(CAST(n AS VARCHAR))) AS anchors FROM p WHERE n * 1000 >= 2 * (n * 400 + k % 3 * 100)")
def q93_rule_baseline_fairness(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    p = _parts(spark, d)
    ours, base = _cat("Ours was tuned for ", n, "k trials in all."), _cat("The baseline had ", n * 400 + k % 3 * 100, " trials.")
    return _found("eval/baseline-fairness", text=_text(p, ours, " ", base), answers=_answers(p, ("budgets", {"ours": ours, "baseline": base})))
