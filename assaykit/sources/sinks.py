"""Where findings go: JSON lines, SARIF, plain text, answer stores."""

from __future__ import annotations

import json
import textwrap
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"high": "error", "med": "warning", "low": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule, subject, result: a SARIF result as JSON; the first anchor is the location, the others are related, numbered from 1; an anchor's part after
    the last @ is its offset in the source, given as the region's. What something is absent from stands in the properties. Nulls are left out."""
    level = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])[F.col("severity")]
    offset = lambda a: F.when(F.contains(a, F.lit("@")), F.struct(F.substring_index(a, "@", -1).try_cast("int").alias("charOffset")))
    place = lambda a: F.struct(F.struct(F.struct(a.alias("uri")).alias("artifactLocation"), offset(a).alias("region")).alias("physicalLocation"))
    rest = F.slice("anchors", F.lit(2), F.greatest(F.size("anchors") - 1, F.lit(0)))
    related = F.when(F.size("anchors") > 1, F.transform(rest, lambda a, i: F.struct((i + 1).alias("id"), place(a)["physicalLocation"].alias("physicalLocation"))))
    waiver = F.when(F.col("suppressed_by").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.col("suppressed_by").alias("justification"))))
    result = F.struct(
        F.col("rule").alias("ruleId"),
        level.alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place(F.element_at("anchors", 1))).alias("locations"),
        related.alias("relatedLocations"),
        F.struct(F.col("fingerprint").alias("v1")).alias("partialFingerprints"),
        waiver.alias("suppressions"),
        F.when(F.col("absent_from").isNotNull(), F.struct(F.col("absent_from").alias("absentFrom"))).alias("properties"),
    )
    return findings.select("rule", "subject", F.to_json(result).alias("result"))


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON object a line, appended."""
    findings.write.mode("append").json(path)


def upsert(spark, path: str, new: DataFrame, key: str) -> None:
    """Adds answers to a store, replacing those with the same key; unknown ones are never stored. The store is written anew
    beside itself and read back from there, so a failure leaves the old one."""
    settled = new.filter("status <> 'unknown'")
    versions = sorted(int(r) for r in _versions(spark, path))
    if versions:
        old = spark.read.parquet(f"{path}/v={versions[-1]}")
        settled = old.join(settled.select(key), key, "left_anti").unionByName(settled)
    settled.write.parquet(f"{path}/v={versions[-1] + 1 if versions else 1}")


def latest(spark, path: str) -> DataFrame | None:
    versions = sorted(int(r) for r in _versions(spark, path))
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def _versions(spark, path: str) -> list[str]:
    """Versions whose write was finished."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    out = []
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(name[2:])
    return out


def exit_code(counts: DataFrame) -> int:
    """1 if any group's findings reach the floor, else 0."""
    return int(counts.agg(F.coalesce(F.max("exit_code"), F.lit(0))).first()[0])


def skip_reasons(skipped: dict[str, str]) -> list[tuple[str, int]]:
    """Why rules were skipped, and how many for each reason."""
    return sorted(Counter(skipped.values()).items())


def render(findings: DataFrame, width: int = 74, most: int = 200, abstentions: DataFrame | None = None, notes: DataFrame | None = None, skipped: dict[str, str] | None = None) -> str:
    """A report to read, worst first, of at most ``most`` findings; says how many it leaves out. Abstentions are counted by what they say, skipped rules
    by their reason."""
    from assaykit.operators.findings import report_order

    rows = findings.orderBy(*report_order(findings)).limit(most).collect()
    left = findings.count() - len(rows) if len(rows) == most else 0
    out = []
    for r in rows:
        waived = f"  (waived: {r['suppressed_by']})" if r["suppressed_by"] else ""
        out += [f"{r['severity'].upper():5}{r['rule']}  [{r['fingerprint']}]{waived}", *textwrap.wrap(r["message"], width, initial_indent="  ", subsequent_indent="  ")]
        out.append("  at " + " <-> ".join([*dict.fromkeys(r["anchors"])][:2]) + (f" <-> {r['absent_from']} (absent)" if r["absent_from"] else ""))
    if left:
        out.append(f"... and {left} more")
    if not rows:
        out.append("No findings.")
    for table, word, key in ((abstentions, "unchecked", "rule"), (notes, "note", "about")):
        if table is not None:
            said = table.groupBy(key, "what").agg(F.count("*").alias("n")).orderBy(key, "what").limit(most).collect()
            out += [f"{word}: {r[key]}: {r['what']}" + (f" ({r['n']} times)" if r["n"] > 1 else "") for r in said]
    out += [f"skipped: {n} rule{'s' * (n > 1)}, {why}" for why, n in skip_reasons(skipped or {})]
    return "\n".join(out)


def report_rows(findings: DataFrame, abstentions: DataFrame, notes: DataFrame, skipped: dict[str, str], target: str, version: str) -> Iterator[str]:
    """A report as JSON lines, a row at a time, so that none is gathered: findings (kind finding), unchecked, note, then one summary with the version, the
    target, skipped rules and counts by severity."""
    from assaykit.operators.findings import report_order

    for kind, table in (("finding", findings.orderBy(*report_order(findings))), ("unchecked", abstentions.orderBy("rule", "doc_id", "what")), ("note", notes.orderBy("about", "what"))):
        for r in table.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *table.columns)).alias("j")).toLocalIterator():
            yield r["j"]
    counts = {r["severity"]: r["n"] for r in findings.filter("suppressed_by IS NULL").groupBy("severity").agg(F.count("*").alias("n")).collect()}
    yield json.dumps({"kind": "summary", "version": version, "target": target, "skipped": skipped, "counts": {s: counts.get(s, 0) for s in ("high", "med", "low")}}, sort_keys=True)


def sarif_run(findings: DataFrame, abstentions: DataFrame, notes: DataFrame, rules: dict, version: str) -> Iterator[str]:
    """A SARIF 2.1.0 log in pieces: the rules that fired only, with what they cannot detect; results one by one; what couldn't be checked, and notes, as
    notifications."""
    fired = [r["rule"] for r in findings.select("rule").distinct().orderBy("rule").collect()]  # at most as many as there are rules
    described = [{"id": i, "shortDescription": {"text": i}, "help": {"text": f"Cannot detect: {rules[i].cannot_detect}"}, "defaultConfiguration": {"level": LEVELS[rules[i].severity]}, "properties": {"tier": rules[i].tier}} for i in fired if i in rules]
    driver = json.dumps({"name": "assaykit", "version": version, "rules": described})
    yield '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + driver + '},"results":['
    for k, r in enumerate(sarif_results(findings).orderBy("rule", "subject", "result").toLocalIterator()):
        yield ("," if k else "") + r["result"]
    yield '],"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":['
    said = abstentions.select(F.concat_ws(": ", "rule", "doc_id", "what").alias("t")).union(notes.select(F.concat_ws(": ", "about", "what"))).orderBy("t")
    for k, r in enumerate(said.toLocalIterator()):
        yield ("," if k else "") + json.dumps({"level": "note", "message": {"text": r["t"]}})
    yield "]}]}]}"
