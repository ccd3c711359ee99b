"""Configuration, records, labels, index records, excerpts, passages, the command line."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import excerpts, findings, intervals, rates, retrieval
from assaykit.plans import corpus, engine
from assaykit.plans.rules import claims_of, supported
from assaykit.sources import archives, config, markup, papers, records, repositories, sinks
from assaykit.streaming import sweep

CONFIG = """
# judgements
suppress:
  - rule: stats/grim
    reason: "scale has halves # not wholes"
    match: 4.13
  - rule: bib/orphans
    reason: 'old'
    expires: 2020-01-31
rules:
  bib/unindexed: on
  numbers/table-arithmetic: off
model:
  provider: none
"""


def test_configuration(spark, tmp_path):
    c = config.parse(CONFIG)
    assert c.disabled == {"numbers/table-arithmetic"} and c.enabled == {"bib/unindexed"} and c.model == {"provider": "none"}
    got = [tuple(r) for r in c.waiver_rows(spark).orderBy("seq").collect()]
    assert got == [(1, "stats/grim", "scale has halves # not wholes", "4.13", None), (2, "bib/orphans", "old", None, datetime.date(2020, 1, 31))]
    for wrong in ("suppress:\n  - rule: a/b\n", "suppress:\n  - reason: x\n", "suppress:\n  - rule: a/b\n    reason: x\n    expires: soon\n"):
        with pytest.raises(config.ConfigError):
            config.parse(wrong)
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / config.NAMES[0]).write_text(CONFIG)
    assert config.discover(str(deep)).path == str(tmp_path / config.NAMES[0]) and len(config.discover(str(deep)).waivers) == 2
    assert config.parse(config.EMPTY) == config.Config() and config.Config().waiver_rows(spark).count() == 0


def test_jsonl_of_an_interrupted_run(spark, tmp_path):
    good = '{"a": 1, "b": "x", "new": true}\n{"a": 2}\n\n'
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "one.jsonl").write_text(good + '{"a": 3, "b": "yé')
    (tmp_path / "cut" / "two.jsonl").write_text('{"a": 4}\n')
    got = records.read_jsonl(spark, str(tmp_path / "cut"), "a int, b string").collect()
    assert sorted((r["a"], r["b"] or "") for r in got) == [(1, "x"), (2, ""), (4, "")]
    for name, body in (("middle", '{"a": 1}\n{"a": \n{"a": 2}\n'), ("several", '{"a": \n{"a": 1}\n{"b": ')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text(body)
        with pytest.raises(ValueError, match="malformed"):
            records.read_jsonl(spark, str(tmp_path / name), "a int, b string")


def test_ids_stems_and_clones(spark):
    lines = spark.createDataFrame([(1, "# list"), (2, " 2608.1v1 # first"), (3, ""), (4, "b"), (5, "2608.1v1")], "n int, value string")
    ids = records.read_ids(lines, ["n"])
    assert [(r["id"], r["place"]["n"]) for r in ids.orderBy("place").collect()] == [("2608.1v1", 2), ("b", 4)]
    files = spark.createDataFrame([(p,) for p in ("/x/2608.1v1.tar.gz", "file:/y/b.tex", "/z/c.nxml", "2608.1v1")], "path string")
    assert [r[0] for r in files.select(records.stem(F.col("path"))).collect()] == ["2608.1v1", "b", "c", "2608.1v1"]
    assert records.named(files, ids, "path").count() == 3
    repo = spark.createDataFrame([("file:/r/clones/2608.1v1/src/a.py", b"x"), ("file:/r/clones/b/README.md", b"y"), ("file:/r/clones/stray.txt", b"z")], "path string, content binary")
    assert sorted((r["repo_id"], r["path"]) for r in records.clones(repo, "/r/clones/").collect()) == [("2608.1v1", "src/a.py"), ("b", "README.md")]


def test_findings_survive_json(spark):
    rows = [("a/b", "high", "p", "m 1", ["x", "y"], None, "f", None), ("a/c", "low", "p", "m 2", ["x"], "the text", "g", "known")]
    found = spark.createDataFrame(rows, "rule string, severity string, subject string, message string, anchors array<string>, absent_from string, fingerprint string, suppressed_by string")
    back = records.findings_from_json(records.findings_to_json(found))
    assert sorted(map(tuple, back.collect())) == sorted(rows, key=lambda r: r[0]) and back.columns == found.columns
    for wrong in ({"schema": 2, "rule": "a/b", "anchors": ["x", "y"]}, {"schema": 1, "rule": "a/b", "anchors": ["x"]}, {"rule": "a/b", "anchors": ["x", "y"], "suppressed_by": " "}, {"anchors": ["x", "y"]}):
        with pytest.raises(Exception, match="newer|two anchors|without a reason|no rule"):
            records.findings_from_json(spark.createDataFrame([(json.dumps(wrong),)], "finding string")).collect()


def test_labels(spark, tmp_path):
    path, schema = f"file://{tmp_path}/labels", "fingerprint string, rule string, correct boolean, paper string, why string"
    records.add_labels(spark, path, spark.createDataFrame([("f", "a/b", True, "p", None), ("g", "a/b", None, "p", None)], schema))
    records.add_labels(spark, path, spark.createDataFrame([("f", "a/b", False, "p", "wrong table")], schema))
    assert sorted((r["fingerprint"], r["correct"], r["why"]) for r in sinks.latest(spark, path).collect()) == [("f", False, "wrong table"), ("g", False, "ambiguous")]


def test_index_records(spark):
    bodies = {
        "crossref": {"title": ["A  Study\nof Lamps"], "author": [{"family": "Ito", "given": "Mei"}, {"given": "x"}, {"family": "Li"}], "issued": {"date-parts": [[2019, 3]]}, "published-print": {"date-parts": [[2020]]}, "container-title": ["J. Lamp"], "DOI": "10.1/AB"},
        "openalex": {"display_name": "A Study of Lamps", "publication_year": 2020, "doi": "https://doi.org/10.1/ab", "authorships": [{"author": {"display_name": "Mei Ito"}}, {"author": {}}], "primary_location": {"source": {"display_name": "J. Lamp"}}, "locations": [{"landing_page_url": "https://x.org"}, {"landing_page_url": "https://arxiv.org/abs/2001.12345v2"}], "ids": {"pmcid": "https://x/PMC12345"}},
        "csl": {"title": "A Study of Lamps", "author": [{"family": "Ito", "given": "Mei"}], "issued": {"date-parts": [[2020]]}, "container-title": "J. Lamp", "DOI": "10.1/ab"},
        "dblp": {"info": {"title": "A Study of Lamps.", "year": "2020", "venue": "J. Lamp", "doi": "10.1/ab", "authors": {"author": [{"text": "Mei Ito 0001"}]}}},
    }
    for index, body in bodies.items():
        df = spark.createDataFrame([(json.dumps(body),), ("{}",), (None,)], "j string").select(records.index_record(index, F.col("j")).alias("r"))
        r, bare, none = (x["r"] for x in df.collect())
        assert (r["source"], r["title"], r["year"], r["venue"], r["doi"]) == (index, "A Study of Lamps", "2020", "J. Lamp", "10.1/ab"), r
        assert r["authors"] == {"crossref": ["Ito, Mei", "Li"], "csl": ["Ito, Mei"]}.get(index, ["Mei Ito"])
        assert (r["arxiv_id"], r["pmcid"]) == (("2001.12345", "PMC12345") if index == "openalex" else ("", ""))
        assert bare["title"] == "" and none is None


def test_identifiers_keys_and_pacing(spark):
    m = lambda **kw: spark.createDataFrame([(kw,)], "f map<string,string>")
    arxiv = lambda **kw: m(**kw).select(tx.arxiv_id_of(F.col("f"))).first()[0]
    assert arxiv(eprint="1706.03762v5", archiveprefix="arXiv") == "1706.03762" and arxiv(journal="arXiv preprint arXiv:1706.03762") == "1706.03762"
    assert arxiv(eprint="hep-th/9901001") == "hep-th/9901001" and arxiv(eprint="1706.03762", archiveprefix="other") == "" and arxiv(note="1706.03762") == ""
    assert m(note="see pmc12345.").select(tx.pmcid_of(F.col("f"))).first()[0] == "PMC12345" and m(url="x").select(tx.pmcid_of(F.col("f"), F.lit("PMC9999"))).first()[0] == "PMC9999"
    q = spark.createDataFrame([("s", "u", None, "1", "m"), ("s", "u", "", "1", "m"), ("s", "u", None, "1", "m"), ("s", "v", None, "1", "m")], "a string, b string, c string, d string, e string")
    keys = [r[0] for r in q.select(records.request_key(*map(F.col, "abcde"))).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 3
    asked = spark.createDataFrame([("arxiv", 1), ("arxiv", 2), ("x", 3), ("x", 4)], "index string, n int")
    assert [(r["n"], r["at"]) for r in records.paced(asked, "index", ["n"], {"arxiv": 3.0}).orderBy("n").collect()] == [(1, 0.0), (2, 3.0), (3, 0.0), (4, 0.05)]
    waits = spark.createDataFrame([(0, None), (3, None), (9, None), (1, "7.5")], "n int, h string").select(records.retry_after(F.col("n"), F.col("h"))).collect()
    assert [r[0] for r in waits] == [1.0, 8.0, 60.0, 7.5]


def test_own_repository(spark):
    texts = ["see https://github.com/pytorch/pytorch and github.com/me/Tool.git.", "www.gitlab.com/a/b/tree, github.com/c/d", "github.com/huggingface/x and github.com/me/style.sty", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw string")
    assert sorted(tuple(r) for r in repositories.own_repository(df).collect()) == [(0, "https://github.com/me/Tool", "me/Tool"), (1, "https://gitlab.com/a/b", "a/b")]


def test_prose_keeps_paragraphs():
    assert markup.prose("One \\emph{two}\nthree.\n \n% gone\nFour~\\cite{k}.") == "One two three.\n\nFour ."
    xml = "<article article-type='x'><front><article-meta><article-title>A <i>b</i> &amp; c</article-title><abstract><p>First <b>bold</b>\n text.</p></abstract></article-meta></front><body><sec><p>Second.</p></sec></body></article>"
    assert markup.prose(xml) == "First bold text.\n\nSecond." and markup.jats_title(xml) == "A b & c"
    assert markup.prose("<article article-type='x'><front>") == "" and markup.jats_title("") == ""


def test_titles_need_corroboration(spark):
    pairs = spark.createDataFrame([(1, 10, 0.95, False), (1, 11, 0.95, True), (2, 10, 0.8, False), (2, 11, 0.78, True), (3, 10, 0.89, None), (4, 10, 0.74, True)], "ours int, theirs int, score double, agree boolean")
    got = retrieval.identified(pairs, "ours", "score", "theirs", F.col("agree")).collect()
    assert sorted((r["ours"], r["theirs"]) for r in got) == [(1, 10), (2, 11)]


def test_excerpts(spark):
    text = "Front matter here. " + "M" * 50 + "R" * 30 + "other words about lamps. " + "D" * 40
    docs = spark.createDataFrame([(1, text, 0), (2, "no sections at all", 0), (3, "", 0)], "doc_id int, text string, body_start int")
    at = [text.index("M"), text.index("R"), text.index("other"), text.index("D")]
    sections = spark.createDataFrame([(1, "2. Methods", at[1 - 1], at[1]), (1, "Results and analysis", at[1], at[2]), (1, "Acknowledgements", at[2], len(text))], "doc_id int, name string, start int, stop int")
    blocks = spark.createDataFrame([(1, at[2], at[3], ["lamps", "words"]), (1, at[1] + 5, at[2], ["lamps"]), (1, at[3], len(text), ["x"]), (1, len(text), len(text), ["y"]), (1, len(text), len(text), ["z"])], "doc_id int, start int, stop int, terms array<string>")
    rows = lambda *a: sorted((r["doc_id"], r["role"], r["start"], r["taken"]) for r in excerpts.excerpt(docs, sections, blocks, *a).collect())
    assert rows(["results", "abstract"], 1000, ["lamps"]) == [(1, "abstract", 0, 19), (1, "passage", at[2], 25), (1, "results", at[1], 30), (2, "abstract", 0, 18)]
    assert rows(["results", "methods"], 40, ["lamps"]) == [(1, "methods", at[0], 10), (1, "results", at[1], 30), (2, "leading", 0, 18)]


def test_questions_hold_the_best_passages(spark):
    claim = "Recall on long documents rises to 94.2 percent with lattice decoding"
    filler = "Plain words about something else entirely, said at some length so that a paragraph of it is long enough to be kept as one by the reader."
    body = "\n\n".join([filler, filler.replace("Plain", "Recall of documents, plain"), "The value reported for this setting is 94.2 and nothing else was measured in it, though the authors did try to for quite some time after that.", filler])
    slices = {"claims": spark.createDataFrame([("p", claim, ["a", "b"])], "doc_id string, text string, keys array<string>"), "cited_texts": spark.createDataFrame([("p", "a", body)], engine.EMPTY["cited_texts"])}
    slices["claims"] = slices["claims"].union(spark.createDataFrame([("p", claim + " always", ["a"])], slices["claims"].schema))
    asked, left = engine.citation_questions(slices, 2, 1)
    (r,) = asked.collect()
    assert [(x["doc_id"], x["what"]) for x in left.collect()] == [("p", "1 questions beyond the budget")]
    assert r["key"] == "a" and len(r["passages"]) == 2 and r["passages"][0].startswith("Recall of documents") and "94.2" in r["passages"][1]


def test_rows_that_are_equal_stay_as_many(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 50), (None, 5), (2, None)], "g int, at int")
    spans = spark.createDataFrame([(1, 0, 10, "a"), (1, 4, 700, "b"), (1, 9, 9, "none")], "g int, s int, e int, name string")
    got = intervals.point_in_interval(points, spans, ["g"], "at", "s", "e", "name", 8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 5, "a"), (1, 5, "a"), (1, 50, "b"), (None, 5, None), (2, None, None)], key=repr)
    left = spark.createDataFrame([(1, 5), (1, 5), (1, 99)], "g int, at int")
    assert intervals.band_semi_join(left, spark.createDataFrame([(1, 8), (1, 8), (1, 3)], "g int, at int"), "g", "at", 3).count() == 2
    found = spark.createDataFrame([("a/b", "m 1"), ("a/b", "m 1"), ("a/c", "m")], "rule string, message string")
    waivers = spark.createDataFrame([(2, "a/b", "later", None), (1, "a/b", "first", "m 1")], "seq int, rule string, reason string, match string")
    assert [(r["rule"], r["suppressed_by"]) for r in findings.suppress(found, waivers).orderBy("rule").collect()] == [("a/b", "first"), ("a/b", "first"), ("a/c", None)]
    assert [r["seq"] for r in findings.unused_waivers(found, waivers).collect()] == [2]


def test_stale_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "t", "s"), (2, "t", "s"), (3, None, "s"), (9, "t", "u")], "doc_id long, text string, source string")
    assert [tuple(r) for r in corpus.stale_labels(labels, docs).collect()] == [("s", 2, 1, 3)]


def test_replayed_batches_lose_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    none_of_b = lambda df: df.filter("text <> 'b'")
    rows = lambda: sorted((r["doc_id"], r["text"]) for r in sweep.results(spark, out).collect())
    first, second = batch((1, "a"), (2, "b"), (3, "a")), batch((4, "b"), (5, "c"), (6, "a"), (7, None))
    sweep.write_batch(first, 0, out, none_of_b)
    assert rows() == [(1, "a")]
    sweep.write_batch(first, 0, out, none_of_b)  # the commit was lost: the batch comes again
    assert rows() == [(1, "a")]

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):  # digests are there, results aren't
        sweep.write_batch(second, 1, out, fails)
    sweep.write_batch(second, 1, out, none_of_b)
    sweep.write_batch(first, 0, out, none_of_b)
    # b gave no result and is known all the same
    assert rows() == [(1, "a"), (5, "c")]


def test_audits_screens_and_rates(spark):
    spans = spark.createDataFrame([(1, "one\ntwo", 4, 7, 2), (1, "one\ntwo", 4, 7, 1), (1, "x", 0, 9, 1), (2, None, 0, 1, 1)], "g int, text string, a int, b int, line int")
    checked = findings.anchor_problems(spans, "text", "a", "b", "line")
    assert [r["problem"] for r in checked.collect()] == [None, "wrong-line", "out-of-bounds", "missing-source"]
    got = {r["g"]: r for r in findings.audit(checked, "g", ["a", "b"], 1).collect()}
    assert (got[1]["n_checked"], got[1]["n_failed"], got[1]["n_missing"], len(got[1]["failures"])) == (3, 2, 0, 1) and (got[2]["n_checked"], got[2]["n_missing"]) == (0, 1)
    quotes = spark.createDataFrame([("m", "located")] * 3 + [("m", "absent")], "model string, verdict string")
    assert sorted((r["verdict"], r["share"], r["located"]) for r in rates.quote_rates(quotes, "model", "verdict").collect()) == [("absent", 0.25, 0.75), ("located", 0.75, 0.75)]
    hits = spark.createDataFrame([("b", 1), ("b", 1), ("a", 1), ("a", 1), ("a", 1), ("c", 1), ("c", 0)], "p string, h int")
    assert [r["p"] for r in rates.screened(hits, "p", F.col("h") == 1, 2, 1).collect()] == ["a"] and rates.screened(hits, "p", F.col("h") == 1).count() == 2
    fired = spark.createDataFrame([("x", 1), ("b", 5), ("a", 5)], "rule string, fired int")
    assert [r["rule"] for r in rates.review_order(fired, "fired", "rule").orderBy("place").collect()] == ["a", "b", "x"]
    left = spark.createDataFrame([("r", "unverified"), ("r", "unverified"), ("r", "answered"), ("r", "over-budget")], "rule string, state string")
    assert sorted(r["what"] for r in rates.unanswered(left, "rule", "state").collect()) == ["1 questions beyond the budget", "2 answers whose quote isn't in the text"]


def test_claims_and_support(spark):
    texts = {"It was significantly\nbetter, and (Statistically significant) too.": (["significantly better", "statistically significant"], False), "insignificantly better; significant, gain": ([], False), "significantly outperformed, SD 3": (["significantly outperformed"], True), "reliably improves. P<.05": (["reliably improves"], True), "Mann-Whitney": ([], True), "the CI pipeline": ([], True), "map(3) and sdk, std_dev": ([], False), "χ chi^2": ([], True), "": ([], False)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", claims_of(F.col("t")).alias("c"), supported(F.col("t")).alias("s")).collect():
        assert (r["c"], r["s"]) == texts[r["t"]], r["t"]


def test_runs_and_citations():
    f = papers.facts("\\begin{document}Results are averaged over 5 random seeds. We did 3 runs and report the mean. We had 4 runs. Mean of ten trials was low. In often runs the mean. \\Citep[a][b]{x, y} \\citeA{z} \\nocite{*, w} \\citation{q}\\end{document}", None)
    assert [r["n"] for r in f["runs"]] == [5, 3, 10]
    assert [(c["key"], c["command"]) for c in f["citations"]] == [("x", "Citep"), ("y", "Citep"), ("z", "citeA"), ("w", "nocite")]
    assert "x, y" not in f["text"]


def test_repositories_that_were_not_read_whole(spark, monkeypatch):
    monkeypatch.setattr(repositories, "MOST_BYTES", 40)
    docs = spark.createDataFrame([("p", "\\begin{document}x\\end{document}", None), ("q", "\\begin{document}x\\end{document}", None)], "doc_id string, raw string, bibliography string")
    files = spark.createDataFrame([("p", "README.md", bytearray(b"soon")), ("p", "train.py", bytearray(b"x = 1\n" * 20)), ("q", "README.md", bytearray(b"soon"))], "repo_id string, path string, content binary")
    slices = engine.slices_of(papers.read_papers(docs), files)
    slices["refused"] = spark.createDataFrame([("r.pdf", "r.pdf", "pdf")], "doc_id string, path string, status string")
    out = engine.run(slices)
    assert [r["doc_id"] for r in out.findings.filter("rule = 'repro/ghost-repo'").collect()] == ["q"]
    said = {(r["rule"], r["doc_id"], r["what"]) for r in out.abstentions.collect()}
    assert ("read/repository", "p", "1 unread: too large") in said and ("read/paper", "r.pdf", "1 unread: pdf") in said and any(a == "repro/ghost-repo" and b == "p" for a, b, _ in said)
    got = {r["doc_id"]: r for r in engine.paper_records(slices, out).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"p": "ok", "q": "ok", "r.pdf": "unreadable"} and got["q"]["n_med"] + got["q"]["n_high"] == 1 and got["p"]["unchecked"]
    nothing = engine.run(slices, disabled=set(engine.RULES))
    assert nothing.findings.count() == 0 and set(nothing.skipped.values()) <= {"disabled", "opt-in, and not named"}


PAPER = "\\documentclass{a}\n\\begin{document}\nLiked (M = 4.13, N = 12), learning rate of 5e-4.\n% ignore bib/orphans -- none\n\\end{document}"


def run(*argv):
    from assaykit.__main__ import main

    return main([*argv])


def test_check_command(spark, tmp_path, capsys):
    src, repos = tmp_path / "in", tmp_path / "clones"
    for name in ("one", "two"):
        (src / name).mkdir(parents=True)
        (src / name / f"{name}.tex").write_text(PAPER)
        (repos / name).mkdir(parents=True)
    (src / "one" / "x.bib").write_text("@article{k, title={T}}")
    (src / "bad.pdf").write_bytes(b"%PDF-1")
    (repos / "one" / "conf.yaml").write_text("learning_rate: 1e-4\n")
    (repos / "two" / "conf.yaml").write_text("learning_rate: 5e-4\n")
    assert run("check", str(src), "--repo", str(repos), "--format", "json", "--records", str(tmp_path / "records")) == 1
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    found = [(r["rule"], r["subject"].rsplit("/", 1)[-1]) for r in rows if r["kind"] == "finding"]
    assert sorted(found) == [("bib/orphans", "one.tex"), ("repro/hparam-drift", "one.tex"), ("stats/grim", "one.tex"), ("stats/grim", "two.tex")]
    assert rows[-1]["kind"] == "summary" and rows[-1]["counts"]["high"] == 1 and rows[-1]["skipped"]["claim/overreach"] == "needs model answers"
    assert any(r["kind"] == "unchecked" and r["what"] == "1 unread: pdf" for r in rows) and any(r["kind"] == "note" and "line 4" in r["what"] for r in rows)
    kept = spark.read.json(str(tmp_path / "records"))
    assert kept.count() == 3
    (tmp_path / config.NAMES[0]).write_text("suppress:\n  - rule: stats/grim\n    reason: halves\n  - rule: repro/hparam-drift\n    reason: tuned\n  - rule: bib/orphans\n    reason: past\n    expires: 2020-01-01\n")
    assert run("check", str(src), "--repo", str(repos)) == 0
    said = capsys.readouterr().out
    assert "(waived: halves)" in said and "a waiver has run out" in said and "skipped:" in said and "unchecked:" in said
    assert run("check", str(src), "--no-config", "--format", "sarif", "--fail-on", "none") == 0
    log = json.loads(capsys.readouterr().out)["runs"][0]
    assert {r["id"] for r in log["tool"]["driver"]["rules"]} == {"stats/grim", "bib/orphans"} == {r["ruleId"] for r in log["results"]}
    grim = next(r for r in log["results"] if r["ruleId"] == "stats/grim")
    assert grim["locations"][0]["physicalLocation"]["region"]["charOffset"] == PAPER.index("4.13") and grim["relatedLocations"][0]["id"] == 1
    assert any("pdf" in n["message"]["text"] for n in log["invocations"][0]["toolExecutionNotifications"])
    orphan = next(r for r in log["results"] if r["ruleId"] == "bib/orphans")
    assert orphan["properties"]["absentFrom"] == "the citations"
    (tmp_path / "ids").write_text("# some\ntwo\n")
    assert run("check", str(src), "--no-config", "--ids", str(tmp_path / "ids"), "--format", "json", "--fail-on", "high") == 0
    assert {json.loads(x).get("subject", "").rsplit("/", 1)[-1] for x in capsys.readouterr().out.splitlines() if '"finding"' in x} == {"two.tex"}
    (tmp_path / config.NAMES[0]).write_text("suppress:\n  - rule: stats/grim\n")
    assert run("check", str(src)) == 2 and run("check", str(tmp_path / "nowhere")) == 2 and "no reason" in capsys.readouterr().err


def test_init_and_rules_commands(tmp_path, capsys):
    assert run("init", str(tmp_path)) == 0 and run("init", str(tmp_path)) == 2
    assert config.discover(str(tmp_path)).waivers == []
    capsys.readouterr()
    assert run("rules", "--tier", "model", "--format", "json") == 0
    assert {r["id"].split("/")[0] for r in json.loads(capsys.readouterr().out)} == {"bib", "claim", "eval"}
    assert run("rules", "--family", "bib") == 0 and capsys.readouterr().out.count("cannot detect") == 6


def test_public_names():
    import assaykit

    assert assaykit.rule.__name__ == "rule" and callable(assaykit.check) and callable(assaykit.read_papers)
    with pytest.raises(AttributeError):
        assaykit.nothing


def test_refused_inputs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.tex").write_bytes(b"x\x00y")
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "d.tex").write_bytes(b"\\documentclass{a}")
    got = {r["doc_id"].rsplit("/", 1)[-1]: r["status"] for r in archives.refused(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.pdf", "b.tex", "c.zip"} and got["a.pdf"] == "pdf" and got["b.tex"] == "binary"


def test_yaml_defaults():
    got, _ = repositories.read_yaml("defaults:\n  - model: resnet # deep\n  - _self_\n  - 'db'\nlr: 3\nx:\n  - y\n", 30)
    assert [(c["raw_name"], c["value"]) for c in got] == [("defaults", "resnet"), ("defaults", "db"), ("lr", "3")]


@pytest.fixture(scope="module")
def service():
    """A service on this machine: an index, a model, a text, and one that is busy at first."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code, body, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_GET(self):
            seen.append(self.path)
            if self.path == "/busy" and seen.count("/busy") < 3:
                return self.reply(429, b"Please retry in 0.5s.")
            if self.path.startswith("/eprint"):
                return self.reply(200, b"\\documentclass{a}\\begin{document}One.\n\nTwo.\\end{document}")
            if "gone" in self.path:
                return self.reply(404, {})
            if "broken" in self.path:
                return self.reply(500, b"no")
            self.reply(200, {"message": {"title": ["A Title"], "DOI": "10.1/x"}})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][1]["content"]
            said = "```json\n{\"verdict\": \"supported\"}\n```" if text == "claim" else "not JSON"
            seen.append((asked["model"], self.headers.get("Authorization")))
            self.reply(200, {"choices": [{"message": {"content": said}}]})

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_connectors(spark, service, tmp_path):
    from assaykit.sources import connectors

    at, seen = service
    index = connectors.Index(at + "/works/{doi}", ("message",))
    assert index.ask({"doi": "10.1/x y"})["DOI"] == "10.1/x" and seen[-1] == "/works/10.1%2Fx%20y" and index.ask({"doi": "gone"}) is None
    chat = connectors.Chat(at, "m", "k")
    assert chat.ask({"system": "s", "user": "claim"}) == {"verdict": "supported"} and chat.ask({"user": "x"}) is None and seen[-1] == ("m", "Bearer k")
    text = connectors.FullText(eprints=at + "/eprint/{arxiv_id}")
    assert text.ask({"arxiv_id": "1"}) == {"text": "One.\n\nTwo."} and text.ask({}) is None
    waits = []

    class Busy:
        def ask(self, request):
            return {"n": len(connectors.fetch(at + "/busy"))}

    assert connectors.Patient(Busy(), sleep=waits.append).ask({})["n"] > 2 and waits == [1.0, 1.0]
    now = [0.0]
    spaced = connectors.Spaced(connectors.Remembered(index), 3.0, lambda: now[0], waits.append)
    spaced.ask({"doi": "a"}), spaced.ask({"doi": "a"})
    assert waits[-1] == 3.0
    with pytest.raises(connectors.Stalled):
        seen.clear()
        connectors.Patient(Busy(), first=50, longest=90, stall=0.1, sleep=waits.append).ask({})
    store = f"file://{tmp_path}/answers"
    asked = lambda *dois: spark.createDataFrame([(d, d) for d in dois], "key string, doi string")
    build = lambda: connectors.Index(at + "/works/{doi}", ("message",))
    got = {r["key"]: r for r in connectors.answers(asked("a", "a", "gone", "broken"), "key", build, "index", store).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "found", "gone": "not-found", "broken": "unknown"} and "HTTPError" in got["broken"]["error"]
    before = len(seen)
    again = connectors.answers(asked("a", "gone", "broken", "b"), "key", build, "index", store).collect()
    assert {r["key"]: r["status"] for r in again} == {"a": "found", "gone": "not-found", "broken": "unknown", "b": "found"} and len(seen) == before + 2
    offline = connectors.answers(asked("z"), "key", connectors.Nothing, "none").collect()
    assert [r["status"] for r in offline] == ["unknown"]
    record = spark.createDataFrame([(got["a"]["answer"],)], "j string").select(records.index_record("crossref", F.col("j")).alias("r")).first()["r"]
    assert record["title"] == "A Title"


def test_rules_are_discovered(tmp_path, monkeypatch):
    from assaykit.plans import rules

    (tmp_path / "own_rules" / "more").mkdir(parents=True)
    (tmp_path / "own_rules" / "__init__.py").write_text("")
    (tmp_path / "own_rules" / "more" / "__init__.py").write_text("")
    (tmp_path / "own_rules" / "more" / "one.py").write_text("from assaykit.plans.rules import rule\n@rule('mine/one', 'low', 'text', 'Most things.')\ndef one(s):\n    return s['text'].limit(0), None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        assert rules.discover("own_rules") == ["mine/one"] and rules.discover("own_rules") == []
    finally:
        rules.RULES.pop("mine/one", None)
