"""Findings: the row that checks converge on, suppression, order, counts, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.text import fingerprint
from assaykit.operators.scale import by_range, ranked

SEVERITIES = ("low", "med", "high")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int")


def finding(rows: DataFrame, rule: str, severity: Column, subject: Column, message: Column, anchors: Column, absent_from: Column | None = None) -> DataFrame:
    """Rows as findings. A finding has two anchors at least, or one and what it is absent from; anything else is an error."""
    absent = F.lit(None).cast("string") if absent_from is None else absent_from
    out = rows.select(F.lit(rule).alias("rule"), severity.alias("severity"), subject.cast("string").alias("subject"), message.alias("message"), anchors.alias("anchors"), absent.alias("absent_from"))
    valid = (F.size("anchors") >= 2) | (F.col("absent_from").isNotNull() & (F.size("anchors") >= 1))
    checked = F.when(valid, F.col("message")).otherwise(F.raise_error(F.concat(F.lit(f"{rule}: a finding needs two anchors, or one and what it is absent from: "), "message")).cast("string"))
    return out.withColumn("message", checked).withColumn("fingerprint", fingerprint(F.col("rule"), F.col("message")))


def _with_waivers(findings: DataFrame, waivers: DataFrame) -> tuple[DataFrame, Column]:
    """Findings with all waivers of their rule beside them (a configuration: one row a rule), and the first (by seq) whose match is null or part of the
    message, as a struct (seq, match, reason); null if there is none."""
    own = waivers.groupBy(F.col("rule").alias("w_rule")).agg(F.array_sort(F.collect_list(F.struct("seq", "match", "reason"))).alias("waivers_"))
    both = findings.join(own, F.col("rule") == F.col("w_rule"), "left")
    hits = F.filter("waivers_", lambda w: w["match"].isNull() | F.contains(F.col("message"), w["match"]))
    return both, F.try_element_at(hits, F.lit(1))


def suppress(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Adds ``suppressed_by``: the reason of the first waiver (by seq) of the finding's rule whose match is null or part of the message. Equal
    findings stay as many as they are."""
    both, first = _with_waivers(findings, waivers)
    return both.withColumn("suppressed_by", first["reason"]).drop("w_rule", "waivers_")


def unused_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Waivers that are the first to match no finding."""
    both, first = _with_waivers(findings, waivers)
    return waivers.join(both.select(first["seq"].alias("seq")).filter("seq IS NOT NULL").distinct(), "seq", "left_anti")


def directed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Adds ``directive``: the reason of the first directive of the same document and rule on the line of the finding or the one before."""
    spots = directives.select("doc_id", "rule", "reason", F.col("line").alias("d_line"), F.explode(F.array("line", F.col("line") + 1)).alias("line"))
    best = spots.groupBy("doc_id", "rule", "line").agg(F.min_by("reason", "d_line").alias("directive"))
    return findings.join(best, ["doc_id", "rule", "line"], "left")


def report_order(findings: DataFrame) -> list[Column]:
    """Severity first, then rule and first anchor; the rest breaks ties."""
    return [severity_rank(F.col("severity")).desc(), F.col("rule"), F.element_at("anchors", 1), F.col("subject"), F.col("message")]


def severity_counts(findings: DataFrame, by: list[str], floor: str = "med") -> DataFrame:
    """Counts by severity of what isn't suppressed, and the exit code: 1 if anything reaches the floor."""
    live = F.col("suppressed_by").isNull()
    counts = [F.count_if((F.col("severity") == s) & live).alias(f"n_{s}") for s in reversed(SEVERITIES)]
    over = F.coalesce(F.bool_or(live & (severity_rank(F.col("severity")) >= severity_rank(F.lit(floor)))), F.lit(False))
    return findings.groupBy(*by).agg(*counts, F.count_if(~live).alias("n_suppressed"), over.cast("int").alias("exit_code"))


def anchor_problems(anchors: DataFrame, text: str, start: str, end: str, line: str | None = None) -> DataFrame:
    """Adds ``problem``: why a span doesn't hold, or null. With ``line``, the line that the anchor claims to begin on (from 1) is held against the text too."""
    got = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
    before = F.substring(F.col(text), F.lit(1), F.col(start))
    problem = (
        F.when(F.col(text).isNull(), "missing-source")
        .when((F.col(start) < 0) | (F.col(end) > F.length(text)) | (F.col(start) > F.col(end)), "out-of-bounds")
        .when(F.col(start) == F.col(end), "empty")
        .when(F.trim(F.translate(got, "\n\t\r", "   ")) == "", "whitespace")
    )
    if line:
        problem = problem.when(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1 != F.col(line), "wrong-line")
    return anchors.withColumn("problem", problem)


def audit(checked: DataFrame, by: str, order: list[str], shown: int = 20) -> DataFrame:
    """n_checked, n_failed, n_missing and the first failures of each group of anchors with their ``problem``: a source that isn't at hand is missing,
    not a failure. Failures are cut to the first ones before they are gathered; their number isn't cut."""
    bad = F.col("problem").isNotNull() & (F.col("problem") != "missing-source")
    counts = checked.groupBy(by).agg(F.count_if(F.col("problem").isNull() | bad).alias("n_checked"), F.count_if(bad).alias("n_failed"), F.count_if(F.col("problem") == "missing-source").alias("n_missing"))
    first = checked.filter(bad).withColumn("k_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("k_") <= shown)
    return counts.join(first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "problem"))).alias("failures")), by, "left")


def interleaved(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``turn``: rows of each source in turn, from 1. The overall order is (turn, source). A source of any size is dealt over
    ranges of the order; none is ranked in one task."""
    dealt = by_range(rows, [order], "range_", "interleave")
    out = ranked(dealt, source, "range_", [order], "turn_", "n_")
    return out.withColumn("turn", F.col("turn_") + 1).drop("range_", "turn_", "n_")
