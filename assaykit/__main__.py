"""``python -m assaykit check PATH [--repo DIR]``, ``rules``, ``init``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

OK, FOUND, USAGE = 0, 1, 2


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assaykit")
    sub = p.add_subparsers(dest="what", required=True)
    check = sub.add_parser("check", help="check the papers under a path")
    check.add_argument("path")
    check.add_argument("--repo", help="a folder of the paper's code; for several papers a folder of clones, each named like its paper")
    check.add_argument("--bib", help="the bibliography of papers that have none of their own")
    check.add_argument("--config", help="the configuration; the nearest one above the path if it isn't given")
    check.add_argument("--no-config", action="store_true")
    check.add_argument("--ids", help="a list of ids: only papers whose file is named by one are checked")
    check.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    check.add_argument("--min-severity", choices=("low", "med", "high"), default="low")
    check.add_argument("--fail-on", choices=("low", "med", "high", "none"), default="med")
    check.add_argument("--fail-on-model", action="store_true", help="findings that rest on a model's answers fail as well")
    check.add_argument("--today", default=None, help="the day that waivers are held against, today if it isn't given")
    check.add_argument("--disable", action="append", default=[])
    check.add_argument("--enable", action="append", default=[])
    check.add_argument("--records", help="a folder to which a record for each paper is appended")
    rules = sub.add_parser("rules", help="list the rules and what they cannot detect")
    rules.add_argument("--tier")
    rules.add_argument("--family")
    rules.add_argument("--format", choices=("text", "json"), default="text")
    init = sub.add_parser("init", help="write an empty configuration")
    init.add_argument("folder", nargs="?", default=".")
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    return {"rules": _rules, "init": _init, "check": _check}[a.what](a)


def _rules(a: argparse.Namespace) -> int:
    from assaykit.plans.engine import REPO_SLICES
    from assaykit.plans.rules import RULES

    chosen = [r for r in RULES.values() if a.tier in (None, r.tier) and a.family in (None, r.id.split("/")[0])]
    if a.format == "json":
        print(json.dumps([{"id": r.id, "severity": r.severity, "tier": r.tier, "opt_in": r.opt_in, "requires": list(r.requires), "needs_repo": bool(set(r.requires) & set(REPO_SLICES)), "cannot_detect": r.cannot_detect} for r in chosen], indent=2))
    else:
        for r in chosen:
            print(f"{r.id}  {r.severity}  {r.tier}{'  opt-in' if r.opt_in else ''}\n  cannot detect: {r.cannot_detect}")
    return OK


def _init(a: argparse.Namespace) -> int:
    from assaykit.sources import config

    path = os.path.join(a.folder, config.NAMES[0])
    if os.path.exists(path):
        print(f"assaykit: {path} is there already", file=sys.stderr)
        return USAGE
    with open(path, "w", encoding="utf-8") as f:
        f.write(config.EMPTY)
    print(path)
    return OK


def _check(a: argparse.Namespace) -> int:
    from datetime import date

    from assaykit import __version__
    from assaykit.operators import findings as fd
    from assaykit.operators.scale import written
    from assaykit.plans import engine
    from assaykit.plans.rules import RULES
    from assaykit.sources import archives, config, papers, records, sinks

    local = "://" not in a.path
    if local and not os.path.exists(a.path):
        print(f"assaykit: no such file: {a.path}", file=sys.stderr)
        return USAGE
    try:
        conf = config.Config() if a.no_config else config.read(a.config) if a.config else config.discover(a.path) if local else config.Config()
    except (config.ConfigError, OSError) as e:
        print(f"assaykit: {e}", file=sys.stderr)
        return USAGE

    spark = SparkSession.builder.appName("assaykit").getOrCreate()
    docs = archives.papers(spark, a.path)
    if a.ids:
        docs = records.named(docs, records.read_ids(spark.read.text(a.ids), ["value"]), "doc_id")
    if a.bib:
        given = spark.read.text(a.bib, wholetext=True).select(F.col("value").alias("given_"))  # one row
        docs = docs.join(F.broadcast(given.limit(1)), how="left").withColumn("bibliography", F.coalesce("bibliography", "given_")).drop("given_")
    # one pass of Python for each document; everything after it reads its facts from here
    read = written(papers.read_papers(docs), "papers")
    files = None
    if a.repo:
        raw = archives.scan(spark, a.repo).select("path", "content")
        ids = read.select(F.col("doc_id").cast("string").alias("doc_id"))
        if ids.limit(2).count() == 1:
            files = raw.withColumn("repo_id", F.lit(ids.first()["doc_id"])).select("repo_id", "path", "content")
        else:
            named = records.clones(raw, a.repo).withColumnRenamed("repo_id", "stem_")
            files = named.join(ids.select(F.col("doc_id").alias("repo_id"), records.stem(F.col("doc_id")).alias("stem_")), "stem_").drop("stem_")
    slices = engine.slices_of(read, files)
    slices["refused"] = archives.refused(spark, a.path)
    waivers = conf.waiver_rows(spark) if conf.waivers else None
    report = engine.run(slices, waivers, today=a.today or date.today().isoformat(), disabled=set(a.disable) | conf.disabled, enabled=set(a.enable) | conf.enabled, floor=a.min_severity)
    found = written(report.findings.withColumnRenamed("doc_id", "subject"), "findings")
    if a.records:
        kept = engine.Report(found.withColumnRenamed("subject", "doc_id"), report.abstentions, report.skipped)
        sinks.write_json(engine.paper_records(slices, kept), a.records)
    if a.format == "text":
        print(sinks.render(found, abstentions=report.abstentions, notes=report.notes, skipped=report.skipped))
    elif a.format == "sarif":
        for piece in sinks.sarif_run(found, report.abstentions, report.notes, RULES, __version__):
            print(piece)
    else:
        for line in sinks.report_rows(found, report.abstentions, report.notes, report.skipped, a.path, __version__):
            print(line)
    if a.fail_on == "none":
        return OK
    model = [r.id for r in RULES.values() if r.tier == "model"]
    counted = found if a.fail_on_model else found.filter(~F.col("rule").isin(*model))
    return sinks.exit_code(fd.severity_counts(counted, ["subject"], a.fail_on))


if __name__ == "__main__":
    sys.exit(main())
