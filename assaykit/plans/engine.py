"""Runs rules over papers: which run and why others don't, slices, findings, waivers, abstentions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.text import terms
from assaykit.operators import findings as fd
from assaykit.operators import retrieval
from assaykit.operators.rates import capped
from assaykit.operators.scale import written
from assaykit.plans.rules import RULES, Rule, Slices
from assaykit.sources import papers, repositories

PAPER_ROWS = ("tests", "means", "sizes", "runs", "numbers", "hyperparameters", "cells", "citations", "claims", "bib", "directives")
REPO_SLICES = ("files", "configs", "seeds", "symbols", "deps", "entrypoints")
EMPTY = {
    "resolutions": "doc_id string, key string, status string, registration string, matched_by string, title string, year string, authors array<string>",
    "cited_texts": "doc_id string, key string, text string",
    "answers": "doc_id string, field string, record map<string,string>",
}
FINDING = "rule string, severity string, doc_id string, message string, anchors array<string>, absent_from string, fingerprint string"
#: Rules that conclude from what a repository lacks; they say nothing of one that wasn't read whole.
FROM_ABSENCE = ("repro/ghost-repo", "repro/entrypoint-missing", "claim/unimplemented")


@dataclass
class Report:
    """notes: waivers and directives that matched nothing, and waivers that have run out (about, what)."""

    findings: DataFrame
    abstentions: DataFrame
    skipped: dict[str, str]
    notes: DataFrame | None = None


def planned(available: set[str], disabled: set[str] = frozenset(), enabled: set[str] = frozenset()) -> tuple[list[Rule], dict[str, str]]:
    """The rules that run, and why each other one doesn't."""
    run, skipped = [], {}
    for r in RULES.values():
        missing = [x for x in r.requires if x not in available]
        if r.id in disabled:
            skipped[r.id] = "disabled"
        elif r.opt_in and r.id not in enabled:
            skipped[r.id] = "opt-in, and not named"
        elif missing:
            skipped[r.id] = "needs a repository" if set(missing) & set(REPO_SLICES) else "needs model answers" if "answers" in missing else f"needs {', '.join(missing)}"
        else:
            run.append(r)
    return run, skipped


def slices_of(read: DataFrame, repo_files: DataFrame | None = None, **lookups: DataFrame) -> Slices:
    """Named tables of papers (as ``papers.read_papers`` gives them), of their repositories (repo_id is the paper's doc_id), and of lookups."""
    read = read.withColumn("doc_id", F.col("doc_id").cast("string"))
    out: Slices = {"text": read.select("doc_id", "text", "body_start"), "raw": read.select("doc_id", "raw")}
    out |= {name: papers.rows_of(read, name) for name in PAPER_ROWS}
    if repo_files is not None:
        walked = repositories.walk(repo_files).withColumnRenamed("repo_id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
        out["unread"] = walked.filter("status <> 'read'").select("doc_id", "path", "status")
        files = walked.filter("status = 'read'").withColumn("content", F.col("content").cast("string")).withColumnRenamed("doc_id", "repo_id")
        # four slices come from it: read once
        got = written(repositories.read_files(files), "repositories").withColumnRenamed("repo_id", "doc_id")
        rows = lambda c: got.select("doc_id", "path", F.explode(c).alias("x_")).select("doc_id", "path", "x_.*")
        out |= {"files": files.withColumnRenamed("repo_id", "doc_id").select("doc_id", "path", "content"), "configs": rows("configs"), "seeds": rows("seeds"), "symbols": got.select("doc_id", "path", F.explode("symbols").alias("symbol"))}
        out |= {"deps": repositories.dependencies(files).withColumnRenamed("repo_id", "doc_id"), "entrypoints": repositories.entrypoints(files).withColumnRenamed("repo_id", "doc_id")}
    spark = read.sparkSession
    for name in ("resolutions", "cited_texts"):
        out[name] = lookups.get(name, spark.createDataFrame([], EMPTY[name]))
    if "answers" in lookups:
        out["answers"] = lookups["answers"]
    return out


def run(slices: Slices, waivers: DataFrame | None = None, today: str = "1970-01-01", disabled: set[str] = frozenset(), enabled: set[str] = frozenset(), floor: str = "low") -> Report:
    """All findings of the rules that can run, those below ``floor`` left out after waivers are applied; abstentions are never left out. The rules run
    now, their findings are written to the shared folder. ``today`` is a parameter, so the same input gives the same report."""
    spark: SparkSession = slices["text"].sparkSession
    rules, skipped = planned(set(slices), disabled, enabled)
    every, abst = spark.createDataFrame([], FINDING), spark.createDataFrame([], "rule string, doc_id string, what string")
    for r in rules:
        own, silent = r.run({name: slices[name] for name in r.requires})
        if "unread" in slices and r.id in FROM_ABSENCE:
            part = slices["unread"].select("doc_id").distinct()
            own, kept = own.join(part, "doc_id", "left_anti"), own.join(part, "doc_id", "left_semi")
            abst = abst.unionByName(kept.select("rule", "doc_id", F.lit("the repository wasn't read whole, so nothing is concluded from what it lacks").alias("what")).distinct())
        every = every.unionByName(own)
        if silent is not None:
            abst = abst.unionByName(silent)
    for name, where in (("unread", "repository"), ("refused", "paper")):
        if name in slices:
            counts = slices[name].groupBy("doc_id", "status").agg(F.count("*").alias("n"))
            abst = abst.unionByName(counts.select(F.lit(f"read/{where}").alias("rule"), "doc_id", F.concat(F.col("n").cast("string"), F.lit(" unread: "), F.col("status")).alias("what")))
    # waivers, directives and notes all go through the findings: the rules run once
    every, notes = written(every, "findings"), [spark.createDataFrame([], "about string, what string")]
    if waivers is None:
        out = every.withColumn("suppressed_by", F.lit(None).cast("string"))
    else:
        over = F.col("expires") < F.lit(today).cast("date")
        live = waivers.filter(F.col("expires").isNull() | ~over)
        out = fd.suppress(every, live)
        notes += [waivers.filter(over).select(F.col("rule").alias("about"), F.lit("a waiver has run out").alias("what")), fd.unused_waivers(every, live).select(F.col("rule").alias("about"), F.lit("a waiver matched nothing").alias("what"))]
    if "directives" in slices:
        covered = _directed(out, slices)
        notes.append(_unused_directives(covered, slices).select(F.concat_ws(" ", "rule", "doc_id").alias("about"), F.concat(F.lit("the directive on line "), F.col("line").cast("string"), F.lit(" matched nothing")).alias("what")))
        out = out.join(covered.groupBy("doc_id", "rule", "message").agg(F.min("directive").alias("directive")), ["doc_id", "rule", "message"], "left").withColumn("suppressed_by", F.coalesce("directive", "suppressed_by")).drop("directive")
    out = out.filter(fd.severity_rank(F.col("severity")) >= fd.severity_rank(F.lit(floor)))
    return Report(out, abst, skipped, reduce(DataFrame.unionByName, notes))


def _directed(found: DataFrame, slices: Slices) -> DataFrame:
    """doc_id, rule, message, line, directive of findings that a directive in the source covers: they come last and win; one covers a finding of
    its rule with an anchor on its line or the next."""
    spots = found.select("doc_id", "rule", "message", F.explode("anchors").alias("a")).filter(F.col("a").startswith("paper@")).join(slices["directives"].select("doc_id", "rule").distinct(), ["doc_id", "rule"], "left_semi")
    placed = spots.join(slices["raw"], "doc_id").withColumn("before", F.substring("raw", F.lit(1), F.substring_index("a", "@", -1).cast("int")))
    lines = placed.select("doc_id", "rule", "message", (F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit(""))) + 1).alias("line"))
    return fd.directed(lines, slices["directives"]).filter("directive IS NOT NULL")


def _unused_directives(covered: DataFrame, slices: Slices) -> DataFrame:
    hit = covered.select("doc_id", "rule", F.explode(F.array("line", F.col("line") - 1)).alias("line")).distinct()
    return slices["directives"].select("doc_id", "rule", "line").join(hit, ["doc_id", "rule", "line"], "left_anti")


def citation_questions(slices: Slices, k: int = 3, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, claim, passages: what a model is asked about each claim that cites a work whose text is at hand: the k passages of the work that bear
    most on the claim, by shared terms and numbers, in order. Its answers come back as the table ``answers``. Of a paper ``most`` questions are asked, the
    first by key and claim; how many are left is the second table, as abstentions (rule, doc_id, what)."""
    from assaykit.functions.text import number_texts
    from assaykit.sources import papers as reader

    @F.udf("array<struct<start: int, text: string>>")
    def blocks(text: str):
        return [{"start": a, "text": b} for a, b in reader.paragraphs(text or "")]

    asked = slices["claims"].select("doc_id", F.col("text").alias("claim"), F.explode("keys").alias("key")).distinct()
    texts = slices["cited_texts"].select("doc_id", "key", F.explode(blocks("text")).alias("b")).select("doc_id", "key", F.col("b.start").alias("start"), F.col("b.text").alias("passage"))
    marked = texts.withColumns({"terms": terms(F.col("passage")), "numbers": number_texts(F.col("passage"))})
    both = asked.withColumns({"c_terms": terms(F.col("claim")), "c_numbers": number_texts(F.col("claim"))}).join(marked, ["doc_id", "key"])
    best = retrieval.passages_for(both, ["doc_id", "key", "claim"], "start", "terms", "c_terms", "numbers", "c_numbers", k)
    every = best.groupBy("doc_id", "key", "claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "passage"))), lambda x: x["passage"]).alias("passages"))
    asked_now, left = capped(every, "doc_id", ["key", "claim"], most)
    return asked_now, left.select(F.lit("bib/citation-support").alias("rule"), "doc_id", F.concat(F.col("n_left").cast("string"), F.lit(" questions beyond the budget")).alias("what"))


def paper_records(slices: Slices, report: Report) -> DataFrame:
    """doc_id, status, source_sha256, census, n_high, n_med, n_low, n_suppressed, fingerprints, unchecked of every paper: how many rows each slice has, what was found, and
    what couldn't be checked. A paper that wasn't read is there as well, with its reason."""
    counted = [n for n in PAPER_ROWS if n in slices]
    rows = reduce(DataFrame.union, [slices[n].groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(n).alias("slice"), "n") for n in counted])
    census = rows.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slice", "n")))).alias("census"))
    counts = fd.severity_counts(report.findings, ["doc_id"]).drop("exit_code")
    prints = report.findings.groupBy("doc_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))
    silent = report.abstentions.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "rule", "what"))).alias("unchecked"))
    papers_ = slices["raw"].select("doc_id", F.when(F.length(F.coalesce("raw", F.lit(""))) > 0, "ok").otherwise("unreadable").alias("status"), F.sha2("raw", 256).alias("source_sha256"))
    if "refused" in slices:
        papers_ = papers_.unionByName(slices["refused"].select("doc_id", F.lit("unreadable").alias("status"), F.lit(None).cast("string").alias("source_sha256")).distinct().join(papers_.select("doc_id"), "doc_id", "left_anti"))
    out = papers_.join(census, "doc_id", "left").join(counts, "doc_id", "left").join(prints, "doc_id", "left").join(silent, "doc_id", "left")
    none = F.array().cast("array<string>")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_high", "n_med", "n_low", "n_suppressed")}
    return out.withColumns(zero | {"census": F.coalesce("census", F.create_map().cast("map<string,bigint>")), "fingerprints": F.coalesce("fingerprints", none), "unchecked": F.coalesce("unchecked", none)})
