"""The engine end to end, on papers of our own: planted defects are found, a clean paper has none."""

import pytest

from assaykit.operators import findings as fd
from assaykit.plans import engine
from assaykit.plans.rules import RULES, rule
from assaykit.sources import papers

PLANTED = r"""\documentclass{article}
\newcommand{\ours}{TinyRank}
\begin{document}
\section{Approach}
We present \ours, a compact ranking model for short documents~\cite{first2020,second2021}, and train it with a
learning rate of 5e-4 and batch size 64 for 30 epochs. Scores are averaged over 5 random seeds.
Earlier work exists~\cite{lost2019}.
\section{Findings}
Our model reaches 88.1 accuracy on the test split.
\begin{table}\caption{Main scores.}
\begin{tabular}{lcc}
Method & Accuracy & F1 \\ \hline
Plain & 85.0 & 84.1 \\
\textbf{Ours} & 87.9 & 86.0 \\
\end{tabular}\end{table}
\begin{table}\caption{Splits.}
\begin{tabular}{lr}
Part & Rows \\
One & 500 \\
Two & 300 \\
Three & 100 \\
Total & 1000 \\
\end{tabular}\end{table}
Raters liked the output (M = 4.13, N = 12).
The gain was reliable, $t(18) = 1.10$, $p = .02$.
A side result was $t(18) = 2.20$, $p = .01$.
Another one holds, $F(1, 30) = 4.17$, $p = .05$.
\end{document}
"""
BIB = """
@article{first2020, title = {Ranking Short Documents with Small Models}, author = {Reyes, Ana}, year = {2020}, doi = {10.1/good}}
@article{second2021, title = {Sparse Heads in Retrieval}, author = {Okoye, Ben}, year = {2018}, doi = {10.1/year}}
@article{third2022, title = {A Study of Lamps}, author = {Ito, Mei}, year = {2022}, doi = {10.1/dead}}
"""
CLEAN = r"""\documentclass{article}
\begin{document}
\section{Approach}
We use a small model~\cite{first2020} and say so in a sentence that is long enough. Trained with a learning rate of 5e-4.
\section{Findings}
Raters liked it (M = 4.25, N = 12), $t(18) = 2.20$, $p = .041$.
\begin{table}\begin{tabular}{lr}
Part & Rows \\ One & 500 \\ Two & 300 \\ Total & 800 \\
\end{tabular}\end{table}
\end{document}
"""
TRAIN = '''
import argparse
import random
p = argparse.ArgumentParser()
p.add_argument("--learning-rate", type=float, default=5e-4)
p.add_argument("--workers", default=len([1]))
random.seed(7)
'''


@pytest.fixture(scope="module")
def slices(spark):
    docs = spark.createDataFrame([("planted", PLANTED, BIB), ("clean", CLEAN, BIB.split("@article{second")[0]), ("none", None, None)], "doc_id string, raw string, bibliography string")
    files = spark.createDataFrame(
        [("planted", "train.py", bytearray(TRAIN.encode())), ("planted", "configs/base.yaml", bytearray(b"learning_rate: 1e-4\nmodel:\n  depth: 3\n")), ("planted", "README.md", bytearray(b"```\npython train.py\npython eval.py --x\n```\nhttps://example.org/weights.ckpt\n")), ("planted", "requirements.txt", bytearray(b"numpy\ntorch>=2\n# c\npandas==2.0\n")),
         ("planted", ".git/x.py", bytearray(b"x = 1")), ("ghost", "README.md", bytearray(b"Code will be released soon."))],
        "repo_id string, path string, content binary",
    )
    res = spark.createDataFrame(
        [("planted", "first2020", "found", "registered", "doi", "Ranking Short Documents with Small Models", "2020", ["Ana Reyes"]), ("planted", "second2021", "found", "registered", "doi", "Sparse Heads in Retrieval", "2021", ["Ben Okoye"]), ("planted", "third2022", "not-found", "dead", None, None, None, None)],
        engine.EMPTY["resolutions"],
    )
    return engine.slices_of(papers.read_papers(docs).cache(), files, resolutions=res)


@pytest.fixture(scope="module")
def report(slices):
    out = engine.run(slices)
    out.findings, out.abstentions = out.findings.cache(), out.abstentions.cache()
    return out


def by_rule(report, doc):
    out = {}
    for r in report.findings.filter(report.findings.doc_id == doc).collect():
        out.setdefault(r["rule"], []).append(r)
    return out


def test_planted_defects_are_found(report):
    got = by_rule(report, "planted")
    assert {k: len(v) for k, v in got.items()} == {
        "numbers/internal-mismatch": 1, "numbers/table-arithmetic": 1, "stats/grim": 1, "stats/pvalue-mismatch": 2, "bib/orphans": 2, "bib/unresolved": 1, "bib/metadata-drift": 1,
        "repro/hparam-drift": 1, "repro/seed-claim": 1, "repro/entrypoint-missing": 1, "repro/unpinned-deps": 1,
    }
    assert sorted(r["severity"] for r in got["stats/pvalue-mismatch"]) == ["high", "med"]
    assert "4.13" in got["stats/grim"][0]["message"] and got["stats/grim"][0]["severity"] == "med"
    assert "eval.py" in got["repro/entrypoint-missing"][0]["message"]
    assert all(len(r["anchors"]) >= 2 or r["absent_from"] for v in got.values() for r in v)


def test_clean_and_empty_papers_have_none(report):
    assert by_rule(report, "clean") == {} and by_rule(report, "none") == {}


def test_ghost_repository(report):
    got = by_rule(report, "ghost")["repro/ghost-repo"]
    assert got[0]["severity"] == "high"


def test_unknown_is_an_abstention(report):
    said = {(r["rule"], r["doc_id"]) for r in report.abstentions.collect()}
    assert ("bib/unresolved", "clean") in said


def test_reports_are_the_same_every_time(slices, report):
    rows = lambda r: [tuple(x) for x in r.findings.orderBy(*fd.report_order(r.findings.withColumnRenamed("doc_id", "subject"))[:2], "doc_id", "message").collect()]
    assert rows(report) == rows(engine.run(slices))


def test_waivers_and_directives(spark, slices):
    w = spark.createDataFrame([(1, "stats/grim", "scale is not whole", "4.13", None), (2, "bib/orphans", "old", None, None)], "seq int, rule string, reason string, match string, expires date")
    got = {r["rule"]: r["suppressed_by"] for r in engine.run(slices, w).findings.filter("doc_id = 'planted'").collect()}
    assert got["stats/grim"] == "scale is not whole" and got["bib/orphans"] == "old" and got["repro/seed-claim"] is None
    marked = PLANTED.replace("Raters liked", "% ignore stats/grim -- checked by hand\nRaters liked")
    docs = spark.createDataFrame([("d", marked, BIB)], "doc_id string, raw string, bibliography string")
    own = engine.run(engine.slices_of(papers.read_papers(docs))).findings.filter("rule = 'stats/grim'").collect()
    assert [r["suppressed_by"] for r in own] == ["checked by hand"]


def test_which_rules_run():
    run, skipped = engine.planned({"tests", "bib", "resolutions", "citations"}, disabled={"bib/orphans"})
    assert {r.id for r in run} == {"stats/pvalue-mismatch", "bib/unresolved", "bib/doi-mismatch", "bib/metadata-drift"}
    assert skipped["bib/orphans"] == "disabled" and skipped["bib/unindexed"].startswith("opt-in") and skipped["repro/ghost-repo"] == "needs a repository"
    assert len(RULES) == 21
    with pytest.raises(ValueError):
        rule("bib/orphans", "low", "bib", "x")
    with pytest.raises(ValueError):
        rule("no-family", "low", "bib", "x")


def test_model_rules(spark):
    body = "We are substantially better than the rest of the field. Our system works on all languages. We introduce a lattice decoder with pruning. Ours was tuned for 300 trials in total. The baseline was tuned for 50 trials in total. We evaluate on WikiSmall only. " + "Plain filler sentence about nothing in particular. " * 90
    table = "\\begin{tabular}{lr} Who & Acc \\\\ Base & 90.1 \\\\ Ours & 90.5 \\\\ \\end{tabular}"
    docs = spark.createDataFrame([("p", "\\begin{document}" + body + table + "\\end{document}", None)], "doc_id string, raw string, bibliography string")
    files = spark.createDataFrame([("p", "train.py", bytearray(b"def fit(): pass"))], "repo_id string, path string, content binary")
    answers = [
        ("comparisons", {"sentence": "We are substantially better than the rest of the field.", "ours": "90.5%", "baseline": "90.1"}),
        ("scope", {"sentence": "Our system works on all languages."}),
        ("datasets", {"name": "WikiSmall"}),
        ("contributions", {"sentence": "We introduce a lattice decoder with pruning.", "terms": "lattice decoder pruning"}),
        ("abstract_claims", {"sentence": "We introduce a lattice decoder with pruning.", "terms": "lattice decoder"}),
        ("budgets", {"ours": "Ours was tuned for 300 trials in total.", "baseline": "The baseline was tuned for 50 trials in total."}),
        ("scope", {"sentence": "This sentence is made up for all purposes."}),
    ]
    dim = spark.createDataFrame([("p", f, r) for f, r in answers], engine.EMPTY["answers"])
    got = sorted(r["rule"] for r in engine.run(engine.slices_of(papers.read_papers(docs), files, answers=dim)).findings.collect())
    assert got == ["claim/overreach", "claim/scope-creep", "claim/unimplemented", "claim/unsupported", "eval/baseline-fairness"]


def test_citation_support(spark):
    docs = spark.createDataFrame([("p", "\\begin{document}The first method always improves recall on long documents~\\cite{a}. The second sentence cites a work nobody has at hand~\\cite{b}.\\end{document}", "@article{a, title={T}}\n@article{b, title={U}}")], "doc_id string, raw string, bibliography string")
    read = papers.read_papers(docs)
    claim = read.selectExpr("explode(claims) c").selectExpr("c.text").first()[0]
    cited = spark.createDataFrame([("p", "a", "In our tests recall on long documents fell in every setting.")], engine.EMPTY["cited_texts"])
    answers = spark.createDataFrame([("p", "citation_verdict", {"key": "a", "claim": claim, "verdict": "contradicted", "quote": "recall on long documents fell in every setting"})], engine.EMPTY["answers"])
    out = engine.run(engine.slices_of(read, None, cited_texts=cited, answers=answers))
    assert [r["rule"] for r in out.findings.filter("rule LIKE '%support'").collect()] == ["bib/citation-support"]
    assert ("bib/citation-support", "p") in {(r["rule"], r["doc_id"]) for r in out.abstentions.collect()}
