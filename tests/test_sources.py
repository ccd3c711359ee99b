"""Markup, archives, repositories, sinks and sweeps."""

import gzip
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from assaykit.plans import engine
from assaykit.sources import archives, markup, papers, repositories, sinks
from assaykit.streaming import sweep


def test_every_character_knows_its_place():
    raw = "\\documentclass{x}\\begin{document}\\section{A \\emph{b}}Text with \\textbf{bold} 5\\% and $\\chi^2(1) = 3$ % gone\n\nNext~line \\cite{k}.\\end{document}"
    doc = markup.latex(raw)
    assert len(doc.text) == len(doc.offsets) and doc.offsets == sorted(doc.offsets)
    assert "gone" not in doc.text and "cite" not in doc.text and "bold 5% and chi^2(1) = 3" in doc.text
    at = doc.text.index("bold")
    assert raw[slice(*doc.span(at, at + 4))] == "bold" and doc.section_at(at) == "A b"
    assert doc.text[doc.body_start() :].startswith("Text")


def test_scanners_take_any_text():
    rng = random.Random(11)
    bits = ["\\", "{", "}", "%", "$", "\\begin{", "\\end{", "figure", "}", "[", "]", "<", ">", "<sec>", "</sec>", "<title>", "&amp;", "&", "\n", "a", "\\cite{", "\\section{", "@x{", "=", '"', ",", "\\newcommand{\\a}{", "\\\\", "\\multicolumn{2}{c}{"]
    for _ in range(3000):
        raw = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        for doc in (markup.latex(raw), markup.jats(raw)):
            assert len(doc.text) == len(doc.offsets)
        papers.facts(raw, raw)
        papers.facts("<article article-type='x'><front>" + raw, None)


def test_jats_and_latex_give_the_same_facts():
    xml = '<article article-type="r"><front><article-title>T</article-title></front><body><sec><title>Results</title><p>It held (M = 3.20, N = 10), t(9) = 2.1, p = .06 <xref ref-type="bibr" rid="a b">1</xref>.</p></sec></body></article>'
    tex = "\\begin{document}\\section{Results}It held (M = 3.20, N = 10), t(9) = 2.1, p = .06 \\cite{a,b}.\\end{document}"
    a, b = papers.facts(xml, None), papers.facts(tex, None)
    drop = lambda rows: [{k: v for k, v in r.items() if k not in ("start", "end", "sentence", "section", "command")} for r in rows]
    for k in ("tests", "means", "sizes", "citations"):
        assert drop(a[k]) == drop(b[k])
    assert [s["name"] for s in a["sections"]] == [s["name"] for s in b["sections"]] == ["Results"]


def test_formatted_bibliographies():
    bbl = "\\begin{thebibliography}{9}\\bibitem[Li(2020)]{li} A. Li and B. Wu.\n\\newblock A study of nothing much, 2020.\n\\newblock \\emph{J. Void}, 3:1, 2020. doi 10.1234/ab.\\bibitem{x} Z.\\end{thebibliography}"
    first, second = papers.bbl(bbl)
    assert first["fields"]["title"] == "A study of nothing much" and first["fields"]["doi"] == "10.1234/ab" and first["fields"]["year"] == "2020" and second["key"] == "x"


def tar_of(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    files = {"main.tex": b"\\documentclass{a}\\begin{document}\\input{sec/a}\\input{sec/a}end\\end{document}", "sec/a.tex": b"part \\input{main} \xe9", "refs.bib": b"@article{k, title={T}}", "fig.pdf": b"%PDF"}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("bomb.tex", b"0" * 5_000_000)
    (tmp_path / "a.tar.gz").write_bytes(tar_of(files))
    (tmp_path / "b.zip").write_bytes(z.getvalue())
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"\\documentclass{a} single"))
    (tmp_path / "d.tar").write_bytes(tar_of({"../x.tex": b"x"}, "w"))
    (tmp_path / "e.tex").write_bytes(b"%PDF-1.4 not really")
    (tmp_path / "f.tex").write_bytes(b"\\documentclass{a} loose")
    got = {r["path"].rsplit("/", 1)[-1]: r["s"] for r in archives.scan(spark, str(tmp_path)).select("path", archives.status(F.col("content")).alias("s")).collect()}
    assert got == {"a.tar.gz": "archive", "b.zip": "archive", "c.gz": "archive", "d.tar": "archive", "e.tex": "pdf", "f.tex": "text"}
    inside = archives.members(archives.scan(spark, str(tmp_path)).filter(archives.status(F.col("content")) == "archive"))
    refused = {r["path"].rsplit("/", 1)[-1]: r["refused"] for r in inside.filter("refused IS NOT NULL").collect()}
    assert "ratio" in refused["b.zip"] and "folder" in refused["d.tar"] and len(refused) == 2
    read = {r["doc_id"].rsplit("/", 1)[-1]: r for r in archives.papers(spark, str(tmp_path)).collect()}
    assert set(read) == {"a.tar.gz", "c.gz", "f.tex"} and read["a.tar.gz"]["bibliography"].startswith("@article")
    raw = read["a.tar.gz"]["raw"]
    assert raw.count("part") == 1 and "é" in raw
    for r in read["a.tar.gz"]["regions"]:
        assert raw[r["start"] : r["end"]] == archives.decode(files[r["name"]])[r["base"] : r["base"] + r["end"] - r["start"]]


def test_repository_readers():
    configs, unchecked = repositories.read_yaml("a: 1\nb:\n  c: 'x' # no\n  d:\n    e: 2.5\nf: [1]\n", 30)
    assert [(c["origin"], c["value"]) for c in configs] == [("a", "1"), ("b.c", "x"), ("b.d.e", "2.5")] and not unchecked
    assert repositories.read_yaml("a: &x 1\nb: *x", 30)[1]
    assert repositories.read_json("{", 30)[1] and repositories.read_python("def (")[3]
    configs, seeds, symbols, unchecked = repositories.read_python("LR = 3e-4\nclass A:\n  def f(self):\n    for i in range(3):\n      torch.manual_seed(i)\nset_seed(1)\nmodel.seed(3)\np.add_argument('-b', '--batch', default=-2)\np.add_argument('--w', default=g())\n")
    assert {(c["raw_name"], c["value"], c["binding"]) for c in configs} == {("LR", "3e-4", 10), ("batch", "-2", 20)}
    assert [(s["argument"], s["varies"]) for s in seeds] == [(None, True), ("1", False)] and symbols == ["A", "f"] and len(unchecked) == 1


def test_answer_store(spark, tmp_path):
    path = f"file://{tmp_path}/answers"
    rows = lambda x: spark.createDataFrame(x, "key string, status string, v int")
    assert sinks.latest(spark, path) is None
    sinks.upsert(spark, path, rows([("a", "found", 1), ("b", "unknown", 2)]), "key")
    sinks.upsert(spark, path, rows([("a", "found", 3), ("c", "not-found", 4)]), "key")
    assert sorted(tuple(r) for r in sinks.latest(spark, path).collect()) == [("a", "found", 3), ("c", "not-found", 4)]


def test_report_formats(spark):
    docs = spark.createDataFrame([("p", "\\begin{document}Liked (M = 4.13, N = 12).\\end{document}", None)], "doc_id string, raw string, bibliography string")
    found = engine.run(engine.slices_of(papers.read_papers(docs))).findings.withColumnRenamed("doc_id", "subject")
    assert "stats/grim" in sinks.render(found) and "4.13" in sinks.render(found)
    (one,) = sinks.sarif_results(found).collect()
    assert '"ruleId":"stats/grim"' in one["result"] and "suppressions" not in one["result"]


def test_sweep_resumes(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    add([(1, "a"), (2, "b"), (3, "a")])
    sweep.sweep(spark, src, schema, out, state)
    add([(4, "b"), (5, "c")])
    sweep.sweep(spark, src, schema, out, state)
    sweep.sweep(spark, src, schema, out, state)
    assert sorted((r["doc_id"], r["text"]) for r in sweep.results(spark, out).collect()) == [(1, "a"), (2, "b"), (5, "c")]


def test_rules_command(capsys):
    from assaykit.__main__ import main

    assert main(["rules"]) == 0 and capsys.readouterr().out.count("cannot detect") == 21
