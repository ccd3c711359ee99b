"""Extraction over texts rendered from tables: what is read back is known, so SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators.scale import written
from assaykit.plans import engine
from assaykit.plans.numeric import p_sql
from assaykit.plans.registry import query, table
from assaykit.sources import archives, papers, repositories, shared
from assaykit.streaming import sweep


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("k"))


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(name: str, text: str, *files: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias(name), F.coalesce(b, F.lit("")).alias(text)) for a, b in files])


def _read(rows: DataFrame, raw: Column, *slices: str, bib: Column | None = None) -> DataFrame:
    return papers.read_papers(rows.select(F.col("l_partkey").alias("doc_id"), raw.alias("raw"), (F.lit(None).cast("string") if bib is None else bib).alias("bibliography")), slices or tuple(papers.SLICES))


@query("""
WITH p AS (SELECT l_partkey AS doc_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS k FROM lineitem GROUP BY 1)
SELECT doc_id, 't' AS kind, printf('%.2f', (k % 500) / 100.0) AS statistic_raw, CAST(n AS DOUBLE) AS df1, '=' AS comparator, '.' || lpad(CAST(k % 97 AS VARCHAR), 3, '0') AS p_raw, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS tail FROM p
UNION ALL SELECT doc_id, 'F', printf('%.2f', (k % 700) / 100.0), 2.0, '<', '.05', 2 FROM p
""")
def q60_tests_extracted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    tail = F.when(k % 2 == 0, "in a one-tailed test").otherwise("in the usual test")
    raw = _cat("\\begin{document}It held ", tail, ", $t(", F.col("n"), ") = ", F.format_string("%.2f", (k % 500) / 100.0), "$, $p = .", F.lpad((k % 97).cast("string"), 3, "0"), "$. Then % no test here: t(1) = 2, p = .5\nthe whole was clear, $F(2, 30) = ", F.format_string("%.2f", (k % 700) / 100.0), "$, $p < .05$.\\end{document}")
    return papers.rows_of(_read(_parts(spark, d), raw, "tests"), "tests").select("doc_id", "kind", "statistic_raw", "df1", "comparator", "p_raw", "tail")


@query("""
WITH p AS (SELECT l_partkey AS doc_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS k FROM lineitem GROUP BY 1)
SELECT doc_id, printf('%.2f', k / 100.0) AS raw, n, CASE WHEN k % 3 = 0 THEN 'section' ELSE 'sentence' END AS level FROM p
""")
def q61_means_with_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Means and the sample size that stands in their sentence, or else in their section."""
    k = F.col("k")
    mean = F.format_string("%.2f", k / 100.0)
    raw = F.when(k % 3 == 0, _cat("\\section{One}People (N = ", F.col("n"), ") were asked. They liked it (M = ", mean, "). \\section{Two}Nothing more.")).otherwise(_cat("\\section{One}They liked it (M = ", mean, ", N = ", F.col("n"), "). Later (N = 7) some left."))
    read = _read(_parts(spark, d), raw, "means", "sizes")
    means, sizes = papers.rows_of(read, "means"), papers.rows_of(read, "sizes")
    own = sizes.groupBy("doc_id", "sentence").agg(F.count("*").alias("c0"), F.min("n").alias("n0"))
    near = sizes.groupBy("doc_id", "section").agg(F.count("*").alias("c1"), F.min("n").alias("n1"))
    both = means.join(own, ["doc_id", "sentence"], "left").join(near, ["doc_id", "section"], "left")
    level = F.when(F.col("c0") == 1, "sentence").when(F.col("c0").isNull() & (F.col("c1") == 1), "section")
    return both.select("doc_id", "raw", F.when(level == "sentence", F.col("n0")).otherwise(F.col("n1")).cast("long").alias("n"), level.alias("level"))


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5') AS row, l_linenumber AS a, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT doc_id, CAST(row AS INTEGER) AS row, 1 AS col, CAST(q AS VARCHAR) || '.5' AS text, q + 0.5::DOUBLE AS number, 1 AS decimals FROM r
UNION ALL SELECT doc_id, CAST(row AS INTEGER), 0, 'line ' || CAST(a AS VARCHAR), CAST(a AS DOUBLE), 0 FROM r
""")
def q62_table_cells(spark: SparkSession, d: str) -> DataFrame:
    line = _cat("line ", F.col("l_linenumber"), " & \\textbf{", F.col("l_quantity").cast("long"), ".5} \\\\ ")
    # the lines of one order, seven at most
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("l_partkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    raw = _cat("\\begin{table}\\caption{Lines}\\begin{tabular}{lr} Line & Quantity \\\\ \\hline ", F.col("body"), "\\end{tabular}\\end{table}")
    cells = papers.rows_of(_read(orders, raw, "cells"), "cells").filter("row > 0")
    return cells.select("doc_id", "row", "col", "text", "number", "decimals")


@query("""
SELECT p_partkey AS doc_id, 'part' || p_partkey AS key, 'article' AS entry_type, 'École of ' || p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year, CASE WHEN p_size % 2 = 0 THEN '10.5/' || p_partkey END AS doi FROM part
""")
def q63_bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    doi = F.when(F.col("p_size") % 2 == 0, _cat(", doi = {10.5/", F.col("l_partkey"), "}")).otherwise("")
    bib = _cat("@comment{x}\n@article{part", F.col("l_partkey"), ",\n title = {{\\'E}cole of {", F.col("p_name"), "}},\n year = ", 1950 + F.col("p_size"), ", title = {second}", doi, "}\n@broken{")
    rows = papers.rows_of(_read(part, F.lit("\\begin{document}x\\end{document}"), "bib", bib=bib), "bib")
    f = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return rows.select("doc_id", "key", "entry_type", f("title"), f("year"), f("doi"))


@query("""
SELECT p_partkey AS doc_id, 'k' || (p_size % 5) AS key, 1 + (p_size % 2) AS n_uses FROM part UNION ALL SELECT p_partkey, 'both', 1 FROM part
""")
def q64_citation_uses(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    key = _cat("k", F.col("p_size") % 5)
    again = F.when(F.col("p_size") % 2 == 1, _cat(" and again~\\citep[see][p.~3]{", key, "}")).otherwise("")
    raw = _cat("\\newcommand{\\mine}{\\cite{never}}\\begin{document}One~\\cite{", key, ", both}", again, ". % \\cite{hidden}\n\\end{document}")
    return papers.rows_of(_read(part, raw, "citations"), "citations").groupBy("doc_id", "key").agg(F.count("*").alias("n_uses"))


@query("""
SELECT p_partkey AS doc_id, 'learning rate' AS label, '3e-' || (1 + p_size % 4) AS raw FROM part UNION ALL SELECT p_partkey, 'batch size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'epochs', CAST(p_size * 2 AS VARCHAR) FROM part
""")
def q65_hyperparameters(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    raw = _cat("\\begin{document}We use a learning rate of 3e-", 1 + F.col("p_size") % 4, " and the batch size was set to ", F.col("p_size"), " for ", F.col("p_size") * 2, " epochs.\\end{document}")
    return papers.rows_of(_read(part, raw, "hyperparameters"), "hyperparameters").select("doc_id", "label", "raw")


@query("""
SELECT p_partkey AS repo_id, 'lr' AS raw_name, '0.' || p_size AS value, 30 AS binding, 'opt.lr' AS origin FROM part UNION ALL SELECT p_partkey, 'lr', '0.5', 20, 'argparse' FROM part UNION ALL SELECT p_partkey, 'depth', CAST(p_size AS VARCHAR), 40, 'model.depth' FROM part
""")
def q66_repository_configs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("repo_id"), "p_size")
    files = _files(
        "path",
        "content",
        ("conf/base.yaml", _cat("# settings\nopt:\n  lr: 0.", F.col("p_size"), "\n  names:\n    - a\n")),
        ("train.py", F.lit("import argparse\np = argparse.ArgumentParser()\np.add_argument('--lr', default=0.5)\np.add_argument('--x', default=f())\n")),
        ("conf/local.json", _cat('{"model": {"depth": ', F.col("p_size"), ', "none": null, "list": [1]}}')),
    )
    rows = part.select("repo_id", F.explode(files).alias("f")).select("repo_id", "f.*")
    return repositories.read_files(rows).select("repo_id", F.explode("configs").alias("c")).select("repo_id", "c.raw_name", "c.value", "c.binding", "c.origin")


@query("""
SELECT p_partkey AS repo_id, 'numpy' AS name, '==1.' || p_size AS "constraint", true AS pinned FROM part UNION ALL SELECT p_partkey, 'torch', '>=2', false FROM part UNION ALL SELECT p_partkey, 'scipy', '', false FROM part
""")
def q67_dependencies(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.col("p_partkey").alias("repo_id"), F.lit("requirements.txt").alias("path"), _cat("# needs\nnumpy==1.", F.col("p_size"), "\ntorch[cpu] >=2  # new\n\n-e .\nscipy\n").alias("content"))
    return repositories.dependencies(files)


@query("""
SELECT p_partkey AS repo_id, target, exists FROM part, (VALUES ('train.py', true), ('tools/eval.py', false), ('pkg/run.py', true), ('deep/x.sh', true)) v(target, exists)
""")
def q68_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("repo_id"))
    readme = "```\npython train.py --x 1\npython3 ./train.py\ntorchrun tools/eval.py\npython -m pkg.run\nbash deep/x.sh\n```"
    files = _files("path", "content", *[(p, F.lit(c)) for p, c in (("README.md", readme), ("train.py", ""), ("pkg/run/__init__.py", ""), ("src/deep/x.sh", ""))])
    return repositories.entrypoints(part.select("repo_id", F.explode(files).alias("f")).select("repo_id", "f.*"))


@query("""SELECT p_partkey AS path, 'main.tex' AS root FROM part
""")
def q69_root_document(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size")
    body = lambda n: F.concat(F.lit("\\documentclass{a}\\begin{document}"), F.repeat(F.lit("x"), n))
    files = _files("member", "text", ("main.tex", body(F.col("p_size"))), ("supplement.tex", body(F.lit(60))), ("sections/intro.tex", F.repeat(F.lit("y"), F.lit(90))))
    return archives.roots(part.select("path", F.explode(files).alias("f")).select("path", "f.*"))


@query(f"""
WITH m AS (SELECT l_partkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS k FROM lineitem GROUP BY 1), t AS (SELECT 20 AS df, 2.09::DOUBLE AS stat),
b AS (SELECT {p_sql("(stat - 0.005)")} AS p_high, {p_sql("(stat + 0.005)")} AS p_low FROM t), q AS (SELECT *, (k % 97) / 1000.0 AS p FROM m, b),
r AS (SELECT 'stats/pvalue-mismatch' AS rule, CASE WHEN NOT (p_low < 0.05 AND p_high >= 0.05) AND (p < 0.05) <> (p_high < 0.05) THEN 'high' ELSE 'med' END AS severity FROM q WHERE NOT (p_low <= p + 0.0005 AND p_high >= p - 0.0005)
 UNION ALL SELECT 'stats/grim', 'med' FROM m WHERE n < 100 AND len(list_filter(list_transform(range(0, 4), lambda i: k * n // 100 - 1 + i), lambda s: abs(200 * s - 2 * k * n) < n OR 200 * s - 2 * k * n = -n OR (200 * s - 2 * k * n = n AND k % 2 = 0))) = 0
 UNION ALL SELECT 'numbers/table-arithmetic', 'med' FROM m WHERE l_partkey % 3 = 2)
SELECT rule, severity, count(*) AS n FROM r GROUP BY 1, 2
""")
def q70_engine_report(spark: SparkSession, d: str) -> DataFrame:
    """All rules that can run, over a paper rendered for each part: a table whose total is off for some, a mean, a test."""
    k, n = F.col("k"), F.col("n")
    raw = _cat("\\begin{document}They liked it (M = ", F.format_string("%.2f", k / 100.0), ", N = ", n, "), $t(20) = 2.09$, $p = .", F.lpad((k % 97).cast("string"), 3, "0"), "$. \\begin{tabular}{lr} Part & Rows \\\\ One & ", k, " \\\\ Two & ", n, " \\\\ Total & ", k + n + F.col("l_partkey") % 3, " \\\\ \\end{tabular}\\end{document}")
    read = _read(_parts(spark, d), raw)
    out = engine.run(engine.slices_of(written(read, "papers")))
    return out.findings.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT sha256(text)) AS n FROM (SELECT text, arg_min(source, (doc_id, lang, source)) AS source FROM documents GROUP BY text) GROUP BY source")
def q71_streaming_sweep(spark: SparkSession, d: str) -> DataFrame:
    """New texts by source, read as a stream of files; running it again would add nothing."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    out, state = shared.scratch(spark, "sweep"), shared.scratch(spark, "sweep-state")
    sweep.sweep(spark, f"{d}/documents.parq*", docs.schema, out, state, lambda df: df.select("digest", "doc_id", "source"))
    return sweep.results(spark, out).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q72_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sweep.windowed_counts(events, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
