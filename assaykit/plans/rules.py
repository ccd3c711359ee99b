"""The rules: each a query over named slices, giving findings and, where it could not check, abstentions.

Slices are tables keyed by doc_id. Papers' slices come from ``sources.papers``, a repository's from ``sources.repositories`` (repo_id
is the paper's doc_id). Lookups and model answers are tables as well: resolutions (doc_id, key, status, registration, matched_by, title, year,
authors), cited_texts (doc_id, key, text), answers (doc_id, field, record map<string,string>). What is unknown there is never a finding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module
from pkgutil import walk_packages

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions import exact, special
from assaykit.functions import text as tx
from assaykit.operators import intervals, keys, retrieval
from assaykit.operators.findings import finding

ALPHA = 0.05
Slices = dict[str, DataFrame]
Found = tuple[DataFrame, DataFrame | None]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    tier: str
    requires: tuple[str, ...]
    cannot_detect: str
    run: Callable[[Slices], Found]
    opt_in: bool = False


RULES: dict[str, Rule] = {}


def rule(id: str, severity: str, requires: str, cannot_detect: str, tier: str = "deterministic", opt_in: bool = False):
    """Registers a rule. What it can't detect must be said; ids have a family; a rule sees only the slices it names."""
    if "/" not in id or not cannot_detect.strip() or id in RULES:
        raise ValueError(f"{id}: a rule needs a family, a limit that it states, and an id of its own")

    def register(f: Callable[[Slices], Found]) -> Callable[[Slices], Found]:
        RULES[id] = Rule(id, severity, tier, tuple(requires.split()), cannot_detect, f, opt_in)
        return f

    return register


def discover(package: str) -> list[str]:
    """Imports every module of a package, so that the rules they hold are registered; the ids of those that are new."""
    before = set(RULES)
    home = import_module(package)
    for module in sorted(m.name for m in walk_packages(getattr(home, "__path__", []), f"{package}.")):
        import_module(module)
    return sorted(set(RULES) - before)


def _s(*parts: str | Column) -> Column:
    """Words and columns in turn, the words first."""
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce((p if isinstance(p, Column) else F.col(p)).cast("string"), F.lit("?")) for i, p in enumerate(parts)])


def _at(source: str, start: str | Column = "start") -> Column:
    return F.concat(F.lit(f"{source}@"), (start if isinstance(start, Column) else F.col(start)).cast("string"))


def _find(rows: DataFrame, id: str, message: Column, anchors: Column, severity: Column | None = None, absent: Column | None = None) -> DataFrame:
    return finding(rows, id, F.lit(RULES[id].severity) if severity is None else severity, F.col("doc_id"), message, anchors, absent).withColumnRenamed("subject", "doc_id")


def _abstain(rows: DataFrame, id: str, what: Column) -> DataFrame:
    return rows.select(F.lit(id).alias("rule"), F.col("doc_id").cast("string"), what.alias("what")).distinct()


@rule("numbers/internal-mismatch", "high", "numbers cells", "Values of different quantities under one heading, and numbers that sum several cells up.")
def internal_mismatch(s: Slices) -> Found:
    heads = s["cells"].filter("row = 0 AND NOT irregular").select("doc_id", "table", "name", "col", F.rtrim(F.lower(F.trim("text")), F.lit(":")).alias("label"))
    body = s["cells"].filter("row > 0 AND number IS NOT NULL AND NOT irregular").select("doc_id", "table", "col", F.col("number").alias("cell"), F.col("start").alias("cell_at"))
    # one column of one table at a time; a document's tables of one heading are its keys
    cells = heads.join(body, ["doc_id", "table", "col"])
    stated = s["numbers"].withColumn("value", F.col("raw").try_cast("double")).join(heads.select("doc_id", "label", "table", "col", "name").distinct(), ["doc_id", "label"])
    hit = intervals.near_misses(stated, cells, ["doc_id", "label", "table", "col"], "value", "cell", place="cell_at")
    first = hit.withColumn("k_", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("table", "col"))).filter("k_ = 1")
    return _find(first, "numbers/internal-mismatch", _s("the text reports ", "label", " of ", "raw", ", but ", "name", " reports ", "nearest", " for the same quantity"), F.array(_at("paper"), _at("paper", "nearest_place"))), None


# Labels of rows that hold totals, and headings of shares of a whole.
_TOTALS = ("total", "sum", "overall", "all", "combined", "aggregate")
_PERCENT = ("%", "percent", "percentage", "share", "proportion")


@rule("numbers/table-arithmetic", "med", "cells", "Totals of parts that the table doesn't show, and columns whose rows have denominators of their own.")
def table_arithmetic(s: Slices) -> Found:
    # a document's cells meet its own cells: both sides grow with the documents, whatever their files' sizes say, so none is broadcast
    body = s["cells"].filter("row > 0 AND NOT irregular")
    totals = body.filter(F.col("col") == 0).filter(F.rtrim(F.lower(F.trim("text")), F.lit(":")).isin(*_TOTALS)).select("doc_id", "table", F.col("row").alias("total_row"))
    nums = body.filter("number IS NOT NULL AND col > 0")
    stated = totals.hint("merge").join(nums, ["doc_id", "table"]).filter("total_row = row").select("doc_id", "table", "col", "total_row", F.col("number").alias("stated"), F.col("start").alias("at"), "name")
    parts = stated.hint("merge").join(nums.select("doc_id", "table", "col", "row", "number", "decimals", F.col("start").alias("part_at")), ["doc_id", "table", "col"]).filter("row <> total_row")
    sums = parts.groupBy("doc_id", "table", "col", "total_row", "stated", "at", "name").agg(F.sum(F.col("number").cast("decimal(28,6)")).cast("double").alias("summed"), F.count("*").alias("n"), F.max("decimals").alias("d"), F.min("part_at").alias("part_at"))
    bad = sums.filter((F.col("n") >= 2) & (F.abs(F.col("summed") - F.col("stated")) > 5 * F.pow(F.lit(10.0), -(F.col("d") + 1)) * F.col("n") + 1e-9))
    out = _find(bad, "numbers/table-arithmetic", _s("", "name", " states a total of ", "stated", ", but its ", "n", " entries sum to ", "summed"), F.array(_at("paper", "at"), _at("paper", "part_at")))
    heads = s["cells"].filter("row = 0 AND NOT irregular").filter(F.exists(F.array(*map(F.lit, _PERCENT)), lambda w: F.contains(F.lower("text"), w))).select("doc_id", "table", "col", F.col("text").alias("head"))
    shares = nums.join(heads.hint("merge"), ["doc_id", "table", "col"]).join(totals.select("doc_id", "table").distinct().hint("merge"), ["doc_id", "table"], "left_anti")
    whole = shares.groupBy("doc_id", "table", "col", "name", "head").agg(F.sum(F.col("number").cast("decimal(28,6)")).cast("double").alias("summed"), F.count("*").alias("n"), F.max("decimals").alias("d"), F.bool_and(F.col("number").between(0, 100)).alias("ok"), F.min("start").alias("a"), F.max("start").alias("b"))
    off = F.abs(F.col("summed") - 100)
    near = whole.filter((F.col("n") >= 3) & F.col("ok") & (off > 5 * F.pow(F.lit(10.0), -(F.col("d") + 1)) * F.col("n")) & (off <= 5))
    return out.unionByName(_find(near, "numbers/table-arithmetic", _s("", "name", " column ", "head", " reads as shares of a whole but sums to ", "summed"), F.array(_at("paper", "a"), _at("paper", "b")), F.lit("low"))), None


@rule("stats/grim", "high", "means sizes", "Anything on a scale of fractions; it abstains without one exact sample size, or where nearly every mean can be reached.")
def grim(s: Slices) -> Found:
    level = lambda df: df.withColumns({"by_sentence": F.concat_ws("/", "doc_id", "sentence"), "by_section": F.concat_ws("/", "doc_id", "section")})
    levels = ["by_sentence", "by_section", "doc_id"]
    facts = level(s["sizes"]).select(*levels, F.struct("n", F.col("start").alias("n_at")).alias("v"))
    out = keys.exactly_one_ladder(level(s["means"]), facts, levels, "v").withColumnRenamed("resolved", "size")
    d = tx.decimals(F.col("raw"))
    rows = out.withColumns({"d": d, "m": F.replace(tx.decimal_text(F.col("raw")), F.lit("."), F.lit("")).cast("long")})
    known = rows.filter("size IS NOT NULL").withColumn("g", F.col("size.n") * F.col("items"))
    args = (F.col("m"), F.col("d"), F.col("g"))
    bad = known.withColumns({"verdict": exact.grim_verdict(*args), "near": exact.grim_nearest(*args)}).filter("verdict = 'inconsistent'")
    shown = F.array_join(F.transform("near", lambda v: F.format_string("%s", (v / F.pow(F.lit(10.0), F.col("d"))).cast("string"))), ", ")
    found = _find(bad, "stats/grim", _s("mean ", "raw", " is not attainable from N=", "size.n", " whole responses; nearest: ", shown), F.array(_at("paper"), _at("paper", "size.n_at")), F.when(F.col("items_inferred"), "med").otherwise("high"))
    return found, _abstain(rows.filter("size IS NULL"), "stats/grim", F.when(F.col("n_found") > 1, _s("", "n_found", " sample sizes for one mean")).otherwise("no sample size for a mean"))


@rule("stats/pvalue-mismatch", "med", "tests", "Tests reported without degrees of freedom, and corrections that the text doesn't state.")
def pvalue_mismatch(s: Slices) -> Found:
    t = s["tests"].withColumns({"stat": tx.decimal_text(F.col("statistic_raw")).cast("double"), "p": tx.decimal_text(F.col("p_raw")).cast("double"), "ds": tx.decimals(F.col("statistic_raw")), "dp": tx.decimals(F.col("p_raw")), "tails": F.col("tail").cast("double")})
    lo, hi = exact.interval_of(F.abs("stat"), F.col("ds"))
    p = lambda stat: special.p_of(F.col("kind"), stat, F.coalesce("df1", F.lit(0.0)), F.coalesce("df2", F.lit(0.0)), F.col("tails"))
    t = t.withColumns({"computed": p(F.col("stat")), "p_high": p(F.greatest(lo, F.lit(0.0))), "p_low": p(hi)})
    said_lo, said_hi = exact.interval_of(F.col("p"), F.col("dp"))
    fits = F.when(F.col("comparator") == "<", F.col("p_low") < F.col("p")).when(F.col("comparator") == ">", F.col("p_high") > F.col("p")).otherwise((F.col("p_low") <= said_hi) & (F.col("p_high") >= said_lo))
    claimed = F.when(F.col("comparator") == "<", F.col("p") <= ALPHA).when(F.col("comparator") == ">", F.lit(False)).otherwise(F.col("p") < ALPHA)
    decision = ~((F.col("p_low") < ALPHA) & (F.col("p_high") >= ALPHA)) & (claimed != (F.col("p_high") < ALPHA))
    bad = t.filter(F.col("computed").isNotNull() & ~fits)
    shown = F.when(F.col("computed") < 1e-4, F.format_string("%.2e", "computed")).otherwise(F.format_string("%.4f", "computed"))
    out = _find(bad, "stats/pvalue-mismatch", _s("", "kind", " = ", "statistic_raw", " gives p = ", shown, ", not ", "p_raw", ""), F.array(_at("paper"), _at("paper", "end")), F.when(decision, "high").otherwise("med"))
    return out, _abstain(t.filter("computed IS NULL"), "stats/pvalue-mismatch", _s("cannot recompute p for ", "kind", ""))


# Words that claim a reliable difference: a first word and those that may follow it, a star for any ending.
CLAIMS = {
    "statistically": "significant",
    "significantly": "better worse higher lower outperform* improv* reduc* increas* decreas*",
    "significant": "difference improvement effect increase decrease gain",
    "reliably": "better outperform* improv*",
}
# What supports a claim wherever it stands: parts of words, words of their own, and symbols by what follows them before a digit.
SUPPORT_PARTS = ("confidence interval", "standard error", "standard deviation", "±", "+/-", "bootstrap", "permutation test", "wilcoxon", "mann-whitney", "mann whitney", "t-test", "anova", "error bar", "significance test")
SUPPORT_WORDS = ("ci", "std", "sd", "sem")
SUPPORT_SYMBOLS = (("p", "<>="), ("t", "("), ("f", "("))


def claims_of(text: Column) -> Column:
    """The claims of a text, each as its two words, lower-case, in order."""
    words = F.split(F.lower(text), r"\s+")
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    ends, begins = lambda w: F.regexp_extract(w, r"([a-z0-9_]+)$", 1), lambda w: F.regexp_extract(w, r"^([a-z0-9_]+)", 1)

    def claimed(pair: Column) -> Column:
        out = F.lit(False)
        for first, seconds in CLAIMS.items():
            stems = [x[:-1] for x in seconds.split() if x.endswith("*")]
            whole = [x for x in seconds.split() if not x.endswith("*")]
            follows = pair["b"].isin(*whole) if whole else F.lit(False)
            for stem in stems:
                follows = follows | F.startswith(pair["b"], F.lit(stem))
            out = out | ((pair["a"] == first) & follows)
        return out

    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), after, lambda x, y: F.struct(ends(x).alias("a"), begins(y).alias("b")))
    return F.transform(F.filter(pairs, claimed), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))


def supported(text: Column) -> Column:
    """Whether a text holds any statistical support: a word for it, or a symbol of a test with a number behind it."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    out = F.contains(F.regexp_replace(flat, r"[ ^]", ""), F.lit("chi2"))
    for part in SUPPORT_PARTS:
        out = out | F.contains(flat, F.lit(part))
    for word in SUPPORT_WORDS:
        out = out | flat.rlike(rf"(?<![a-z]){word}(?![a-z0-9_])")
    for symbol, signs in SUPPORT_SYMBOLS:
        out = out | flat.rlike(rf"(?<![a-z]){symbol} ?[{signs}] ?[.]?[0-9]")
    return out


@rule("stats/significance-unsupported", "med", "text", "Support given in an appendix or supplement that isn't part of the text.")
def significance_unsupported(s: Slices) -> Found:
    rows = s["text"].withColumn("claims", claims_of(F.col("text"))).filter((F.size("claims") > 0) & ~supported(F.col("text")))
    low = F.regexp_replace(F.lower("text"), r"\s", " ")
    spots = F.transform(F.slice("claims", 1, 3), lambda c: F.concat(F.lit("text@"), F.instr(low, c).cast("string")))
    return _find(rows, "stats/significance-unsupported", _s("", F.size("claims"), " claims of significance, the first '", F.element_at("claims", 1), "', and no test anywhere"), spots, F.when(F.size("claims") > 2, "high").otherwise("med"), F.lit("the text")), None


def _resolved(s: Slices) -> DataFrame:
    r = s["resolutions"].select("doc_id", "key", "status", "registration", "matched_by", F.col("title").alias("r_title"), F.col("year").alias("r_year"), F.col("authors").alias("r_authors"))
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    b = s["bib"].withColumns({"title": f("title"), "year": f("year"), "doi": f("doi"), "authors": F.filter(F.split(f("author"), r"\s+and\s+"), lambda a: a != "")})
    return b.join(r, ["doc_id", "key"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


@rule("bib/unresolved", "high", "bib resolutions", "Works without a DOI, and works that no index holds.")
def unresolved(s: Slices) -> Found:
    b = _resolved(s)
    bad = b.filter("doi <> '' AND status = 'not-found' AND registration = 'dead'")
    grey = F.col("entry_type").isin("phdthesis", "mastersthesis", "misc", "techreport", "unpublished")
    out = _find(bad, "bib/unresolved", _s("'", "key", "' has DOI ", tx.normalize_doi(F.col("doi")), ", which is not registered"), F.array(_at("bib")), F.when(grey, "med").otherwise("high"), F.lit("every index asked"))
    return out, _abstain(b.filter("status = 'unknown'"), "bib/unresolved", F.lit("entries that no index answered for"))


@rule("bib/doi-mismatch", "high", "bib resolutions", "DOIs of similar works, as a preprint and its published version, and titles in another language.")
def doi_mismatch(s: Slices) -> Found:
    b = _resolved(s).filter("status = 'found' AND matched_by = 'doi' AND title <> '' AND r_title <> ''")
    b = b.withColumns({"o": tx.overlap(tx.title_tokens(F.col("title")), tx.title_tokens(F.col("r_title"))), "agree": tx.authors_agree(F.col("authors"), F.col("r_authors"))})
    bad = b.filter((F.col("o") < 0.55) & ~F.coalesce("agree", F.lit(False)))
    sure = (F.col("o") < 0.35) & F.coalesce(~F.col("agree"), F.lit(False))
    return _find(bad, "bib/doi-mismatch", _s("'", "key", "' is titled '", "title", "', but its DOI is that of '", "r_title", "'"), F.array(_at("bib"), F.concat(F.lit("index:"), tx.normalize_doi(F.col("doi")))), F.when(sure, "high").otherwise("med")), None


@rule("bib/metadata-drift", "med", "bib resolutions", "Differences of any field but the year.")
def metadata_drift(s: Slices) -> Found:
    b = _resolved(s).filter("status = 'found'").withColumns({"y": tx.year_digits(F.col("year")), "ry": tx.year_digits(F.col("r_year"))}).filter("y <> '' AND ry <> '' AND y <> ry")
    out = _find(b.filter("matched_by = 'doi'"), "bib/metadata-drift", _s("'", "key", "' gives the year ", "y", ", the record ", "ry", ""), F.array(_at("bib"), F.concat(F.lit("index:"), tx.normalize_doi(F.col("doi")))))
    return out, _abstain(b.filter("matched_by <> 'doi'"), "bib/metadata-drift", F.lit("entries matched by title only, which may be another work"))


@rule("bib/orphans", "low", "citations bib", "Citations made by a package of their own.")
def orphans(s: Slices) -> Found:
    missing = keys.undefined_keys(s["citations"], s["bib"], "key", "start", within="doc_id")
    out = _find(missing, "bib/orphans", _s("'", "key", "' is cited ", "n_uses", " times and has no entry"), F.transform("first_places", lambda p: F.concat(F.lit("paper@"), p.cast("string"))), F.lit("med"), F.lit("the bibliography"))
    unused = keys.unused_entries(s["bib"], s["citations"], "key", "doc_id", F.col("entry_type").isin("bibitem", "ref"), within="doc_id", place="start")
    wording = F.when(F.col("all_flagged"), " listed references are never cited: ").otherwise(" entries are never cited: ")
    return out.unionByName(_find(unused, "bib/orphans", F.concat(F.col("n_unused").cast("string"), wording, F.array_join("first_keys", ", ")), F.array(_at("bib", "first_place")), None, F.lit("the citations"))), None


@rule("bib/unindexed", "low", "bib resolutions", "Whether a work that no index holds exists.", opt_in=True)
def unindexed(s: Slices) -> Found:
    bad = _resolved(s).filter("doi = '' AND status = 'not-found' AND title <> ''").filter(F.col("entry_type").isin("article", "inproceedings", "proceedings", "conference", "incollection", "book"))
    return _find(bad, "bib/unindexed", _s("'", "key", "' was found in no index"), F.array(_at("bib")), None, F.lit("every index asked")), None


@rule("repro/hparam-drift", "high", "hyperparameters configs", "Values set on a command line, and settings that differ between experiments.")
def hparam_drift(s: Slices) -> Found:
    paper = s["hyperparameters"].withColumns({"name": tx.canonical(F.col("label")), "stated": F.col("raw").try_cast("double")}).filter("stated IS NOT NULL")
    conf = s["configs"].withColumn("name", tx.canonical(F.col("raw_name")))
    eff = keys.effective_values(conf, ["doc_id", "name"], "binding", "value")
    place = conf.groupBy("doc_id", "name", "binding").agg(F.min(F.struct("path", "start")).alias("where"))
    both = paper.join(eff, ["doc_id", "name"]).join(place, ["doc_id", "name", "binding"]).withColumn("code", F.col("effective").try_cast("double"))
    gap = exact.relative_gap(F.col("stated"), F.col("code"))
    unit = (F.abs(F.col("stated") - 100 * F.col("code")) < 1e-9) | (F.abs(100 * F.col("stated") - F.col("code")) < 1e-9)
    bad = both.filter(F.col("code").isNotNull() & (gap > 1e-4))
    out = _find(bad, "repro/hparam-drift", _s("the paper states ", "label", " ", "raw", ", the code uses ", "effective", ""), F.array(_at("paper"), F.concat(F.col("where.path"), F.lit("@"), F.col("where.start").cast("string"))), F.when(unit, "low").otherwise("high"))
    return out, _abstain(both.filter("conflict"), "repro/hparam-drift", _s("the code has several values of ", "name", ""))


@rule("repro/seed-claim", "high", "runs seeds", "Seeds set by a launcher outside the repository.")
def seed_claim(s: Slices) -> Found:
    said = s["runs"].groupBy("doc_id").agg(F.min_by("n", "start").alias("n_runs"), F.min("start").alias("said_at")).filter("n_runs >= 2")
    fixed = keys.single_literal(s["seeds"], "doc_id", "argument", F.col("varies"))
    where = s["seeds"].groupBy("doc_id").agg(F.min(F.struct("path", "start")).alias("where"))
    bad = said.join(fixed, "doc_id").join(where, "doc_id")
    return _find(bad, "repro/seed-claim", _s("the paper reports ", "n_runs", " runs, the code sets the seed to ", "first_value", " only"), F.array(_at("paper", "said_at"), F.concat(F.col("where.path"), F.lit("@"), F.col("where.start").cast("string")))), None


@rule("repro/entrypoint-missing", "med", "entrypoints", "Commands that create the file they run.")
def entrypoint_missing(s: Slices) -> Found:
    return _find(s["entrypoints"].filter("NOT exists"), "repro/entrypoint-missing", _s("the README runs '", "target", "', which is not there"), F.array(F.concat(F.lit("README:"), "target")), None, F.lit("the file tree")), None


@rule("repro/ghost-repo", "high", "files", "Code kept on another branch or elsewhere.")
def ghost_repo(s: Slices) -> Found:
    name = F.lower(F.substring_index("path", "/", -1))
    doc = name.rlike(r"\.(md|txt|rst)$") | name.startswith("license") | name.startswith(".")
    promise = F.col("content").rlike(r"(?i)(?:code|implementation|models?|weights?|data(?:set)?)\s+(?:will\s+be|to\s+be|is|are)?\s*(?:released|available|published|uploaded|coming)|coming\s+soon|stay\s+tuned|under\s+construction|work\s+in\s+progress")
    per = s["files"].groupBy("doc_id").agg(F.bool_and(doc).alias("ghost"), F.bool_or(promise & name.startswith("readme")).alias("promise"), F.count("*").alias("n"), F.min("path").alias("first")).filter("ghost")
    return _find(per, "repro/ghost-repo", _s("the repository has ", "n", " files and none is code"), F.array(F.concat(F.lit("repo:"), "first")), F.when(F.col("promise"), "high").otherwise("med"), F.lit("the file tree")), None


@rule("repro/unpinned-deps", "low", "deps files", "Pins kept in an image or outside the repository.")
def unpinned_deps(s: Slices) -> Found:
    locked = s["files"].filter(F.lower("path").rlike(r"(^|/)(poetry\.lock|pipfile\.lock|uv\.lock|conda-lock\.yml|environment\.lock|requirements\.lock)$")).select("doc_id").distinct()
    bad = keys.share_of(s["deps"].join(locked, "doc_id", "left_anti"), "doc_id", ~F.col("pinned"), 0.5, "name").withColumn("names", F.array_join("first_names", ", "))
    return _find(bad, "repro/unpinned-deps", _s("", "n_flagged", " of ", "n", " dependencies have no exact version: ", "names", ""), F.array(F.lit("requirements.txt"), F.concat(F.lit("requirements:"), "names"))), None


# --- rules that rest on a model's answers. A quote must stand in the text exactly once, or the answer isn't used.


def _answers(s: Slices, field: str, quote: str) -> DataFrame:
    """Records of a field whose quote is located in the text, with its place."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = s["answers"].filter(F.col("field") == field).join(s["text"].select("doc_id", clean(F.col("text")).alias("text"), "body_start"), "doc_id")
    rows = rows.withColumn("quote", clean(F.coalesce(F.try_element_at("record", F.lit(quote)), F.lit(""))))
    return rows.withColumn("verdict", retrieval.quote_verdict(F.col("text"), F.col("quote"))).filter("verdict = 'located'").withColumn("at", F.instr("text", F.col("quote")) - 1)


def _get(name: str) -> Column:
    return F.coalesce(F.try_element_at("record", F.lit(name)), F.lit(""))


@rule("bib/citation-support", "high", "claims bib cited_texts answers text", "Works whose full text isn't at hand.", tier="model")
def citation_support(s: Slices) -> Found:
    ask = s["claims"].select("doc_id", F.col("text").alias("claim"), F.col("start").alias("claim_at"), F.explode("keys").alias("key"))
    entries = s["bib"].select("doc_id", "key").distinct()
    stray = ask.join(entries, ["doc_id", "key"], "left_anti")
    held = ask.join(entries, ["doc_id", "key"], "left_semi").join(s["cited_texts"].select("doc_id", "key", F.col("text").alias("cited")), ["doc_id", "key"], "left")
    said = s["answers"].filter("field = 'citation_verdict'").select("doc_id", _get("key").alias("key"), _get("claim").alias("claim"), _get("verdict").alias("verdict"), _get("quote").alias("quote"))
    both = held.filter("cited IS NOT NULL").join(said, ["doc_id", "key", "claim"])
    on_topic = F.arrays_overlap(tx.terms(F.col("quote")), tx.terms(F.col("claim")))
    bad = both.filter((F.col("verdict") == "contradicted") & on_topic & (retrieval.quote_verdict(F.col("cited"), F.col("quote")) == "located"))
    out = _find(bad, "bib/citation-support", _s("the claim at '", F.substring("claim", 1, 60), "' is contradicted by '", "key", "': '", F.substring("quote", 1, 60), "'"), F.array(_at("paper", "claim_at"), F.concat(F.lit("cited:"), "key")))
    silent = _abstain(held.filter("cited IS NULL"), "bib/citation-support", F.lit("cited works without a full text"))
    return out, silent.unionByName(_abstain(stray, "bib/citation-support", F.lit("cited works without an entry")))


# Words of strength. The first that a sentence holds counts.
_STRONG = ("significantly", "substantially", "dramatically", "considerably", "markedly", "vastly", "far better", "far outperform", "greatly", "clearly outperform", "by a wide margin", "by a large margin", "state of the art", "state-of-the-art")


@rule("claim/overreach", "med", "text cells answers", "Comparisons whose numbers aren't in a table of the paper.", tier="model")
def overreach(s: Slices) -> Found:
    strong = F.filter(F.array(*map(F.lit, _STRONG)), lambda w: F.contains(F.lower(F.col("quote")), w))
    rows = _answers(s, "comparisons", "sentence").withColumns({"strong": F.try_element_at(strong, F.lit(1)), "ours": F.regexp_replace(_get("ours"), "[%,]", "").try_cast("double"), "base": F.regexp_replace(_get("baseline"), "[%,]", "").try_cast("double")}).filter("strong IS NOT NULL AND ours IS NOT NULL AND base IS NOT NULL")
    once = s["cells"].filter("number IS NOT NULL").groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.min("start").alias("cell_at")).filter("n = 1").drop("n")
    both = rows.join(once.withColumnRenamed("number", "ours").withColumnRenamed("cell_at", "ours_at"), ["doc_id", "ours"]).join(once.withColumnRenamed("number", "base").withColumnRenamed("cell_at", "base_at"), ["doc_id", "base"])
    bad = both.withColumn("gain", tx.margin(F.col("ours"), F.col("base"))).filter("gain >= 0 AND gain < 0.01")
    return _find(bad, "claim/overreach", _s("'", "strong", "' rests on ", "ours", " against ", "base", ""), F.array(_at("text", "at"), _at("paper", "ours_at"), _at("paper", "base_at"))), None


# Words of breadth.
_BROAD = ("all", "any", "every", "always", "universal", "in general", "generally", "across domains", "across tasks", "broadly", "any domain", "real-world", "arbitrary", "wide range", "wide variety", "general-purpose", "robust to", "regardless", "everywhere", "never", "no matter")


@rule("claim/scope-creep", "med", "text answers", "Evaluations named in figures or supplements only.", tier="model")
def scope_creep(s: Slices) -> Found:
    names = s["answers"].filter("field = 'datasets'").select("doc_id", F.lower(_get("name")).alias("name")).filter(F.length("name") >= 2).distinct()
    there = names.join(s["text"].select("doc_id", F.lower("text").alias("low")), "doc_id").filter(F.contains("low", F.col("name"))).groupBy("doc_id").agg(F.count("*").alias("n_sets"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("sets"))
    broad = F.filter(F.array(*map(F.lit, _BROAD)), lambda w: F.contains(F.lower(F.col("quote")), w))
    rows = _answers(s, "scope", "sentence").withColumn("broad", F.try_element_at(broad, F.lit(1))).filter("broad IS NOT NULL")
    bad = rows.join(there, "doc_id").filter("n_sets < 3")
    out = _find(bad, "claim/scope-creep", _s("'", "broad", "' is claimed, ", "n_sets", " datasets are evaluated: ", "sets", ""), F.array(_at("text", "at"), F.concat(F.lit("text:"), "sets")))
    return out, _abstain(rows.join(there, "doc_id", "left_anti"), "claim/scope-creep", F.lit("no dataset named in the text"))


# Words that any claim may hold and that support none.
GENERIC = """
results better improve improved improvement performance approach method
methods model models paper work system experiments experiment evaluation
accuracy quality effective efficient novel state
""".split()


@rule("claim/unsupported", "med", "text answers", "Support under other words than the claim's.", tier="model")
def unsupported(s: Slices) -> Found:
    rows = _answers(s, "abstract_claims", "sentence").withColumn("terms", F.filter(tx.terms(_get("terms")), lambda t: (F.length(t) >= 5) & ~t.isin(*GENERIC))).filter((F.size("terms") >= 2) & (F.length("text") >= 4000))
    after = F.lower(F.substring("text", F.col("at") + F.length("quote") + 1, 1 << 30))
    bad = rows.filter(~F.exists("terms", lambda t: F.contains(after, t)))
    return _find(bad, "claim/unsupported", _s("the claim '", F.substring("quote", 1, 80), "' has no word in the body"), F.array(_at("text", "at")), None, F.lit("the body")), None


@rule("claim/unimplemented", "low", "text answers files symbols configs", "Parts under other names than the paper's.", tier="model")
def unimplemented(s: Slices) -> Found:
    rows = _answers(s, "contributions", "sentence").withColumn("terms", F.filter(tx.terms(_get("terms")), lambda t: F.length(t) >= 4)).filter(F.size("terms") >= 2)
    words = s["files"].select("doc_id", F.lower("path").alias("w")).union(s["symbols"].select("doc_id", F.lower("symbol"))).union(s["configs"].select("doc_id", F.lower("raw_name")))
    asked = rows.select("doc_id", "at", "quote", F.explode("terms").alias("t"))
    hit = asked.join(words, "doc_id").filter(F.contains("w", F.col("t"))).select("doc_id", "at").distinct()
    bad = rows.join(words.select("doc_id").distinct(), "doc_id", "left_semi").join(hit, ["doc_id", "at"], "left_anti")
    return _find(bad, "claim/unimplemented", _s("'", F.substring("quote", 1, 80), "' is nowhere in the repository"), F.array(_at("text", "at")), None, F.lit("files, symbols and settings")), None


@rule("eval/baseline-fairness", "med", "text answers", "Budgets stated in tables or figures.", tier="model")
def baseline_fairness(s: Slices) -> Found:
    ours = _answers(s, "budgets", "ours").select("doc_id", F.col("quote").alias("ours"), F.col("at").alias("ours_at"), _get("baseline").alias("base_quote"))
    other = _answers(s, "budgets", "baseline").select("doc_id", F.col("quote").alias("base_quote"), F.col("at").alias("base_at"))
    both = ours.withColumn("base_quote", F.trim(F.regexp_replace("base_quote", r"\s+", " "))).join(other, ["doc_id", "base_quote"])
    both = both.withColumns({"a": tx.quantity(F.col("ours")), "b": tx.quantity(F.col("base_quote"))})
    bad = both.filter((F.col("b") > 0) & (F.col("a") / F.col("b") >= 2))
    return _find(bad, "eval/baseline-fairness", _s("ours had ", "a", ", the baseline ", "b", ""), F.array(_at("text", "ours_at"), _at("text", "base_at"))), None
