"""Records of sweeps, lists of ids, labels, records of indexes: what tools beside the engine write, read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions import text as tx

SCHEMA = 1
FINDING = "schema int, rule string, severity string, subject string, message string, anchors array<string>, absent_from string, fingerprint string, suppressed_by string"
# What a paper's file name ends with.
SUFFIXES = (".tar.gz", ".tgz", ".zip", ".nxml", ".xml", ".tex")
_LABEL = "fingerprint string, rule string, correct boolean, paper string, why string"


def stem(path: Column) -> Column:
    """A file's name without its folder and its ending: a paper's id, and the name of its clone."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    out = name
    for suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; fields that the schema doesn't have are passed over. A file's last line may have been cut off by an interrupted
    run, and is left out; a malformed line anywhere else is an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_"), F.col("value").alias("line_")).filter(F.trim("line_") != "")
    parsed = lines.withColumn("r_", F.from_json("line_", f"{schema}, broken_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"}))
    broken = parsed.filter("r_ IS NULL OR r_.broken_ IS NOT NULL").select("file_", "line_").limit(1000).collect()
    files = {r["file_"] for r in broken}
    if len(broken) > len(files):
        raise ValueError(f"more than one malformed line in {sorted(files)[0]}: {broken[0]['line_'][:80]}")
    for r in broken:
        end = spark.read.format("binaryFile").load(r["file_"]).select(F.substring("content", -len(r["line_"].encode()) - 4, len(r["line_"].encode()) + 4).cast("string").alias("end")).first()["end"]
        if not end.strip("\r\n").endswith(r["line_"].strip("\r\n")):
            raise ValueError(f"malformed line in {r['file_']}: {r['line_'][:80]}")
    return parsed.filter("r_ IS NOT NULL AND r_.broken_ IS NULL").select("r_.*").drop("broken_")


def read_ids(lines: DataFrame, order: list[str], line: str = "value") -> DataFrame:
    """id, place: the ids of a list, a line each, without comments, blanks and repeats, in the order of first mention. ``order`` names the columns that
    order the lines."""
    ids = lines.withColumn("id", F.trim(F.substring_index(line, "#", 1))).filter("id <> ''")
    return ids.groupBy("id").agg(F.min(F.struct(*order)).alias("place"))


def named(papers: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """Papers whose file is named by an id."""
    return papers.withColumn("stem_", stem(F.col(path))).join(ids.select(F.col("id").alias("stem_")).distinct(), "stem_", "left_semi").drop("stem_")


def clones(files: DataFrame, root: str) -> DataFrame:
    """repo_id, path, content of the files (path, content) of all clones under a folder: the first folder below it is the clone, named like its paper."""
    below = F.regexp_replace(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "^/+", "")
    return files.withColumn("path", below).filter(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("repo_id"), F.expr("substring(path, instr(path, '/') + 1)").alias("path"), "content")


def findings_to_json(findings: DataFrame) -> DataFrame:
    """finding: each finding as JSON, with the number of its schema."""
    return findings.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), *[F.col(x.split()[0]) for x in FINDING.split(", ")[1:]])).alias("finding"))


def findings_from_json(rows: DataFrame, column: str = "finding") -> DataFrame:
    """Findings as they were written. One of a newer schema, without two anchors (or one and what it is absent from), or suppressed without a reason
    is an error, not a finding."""
    f = rows.select(F.from_json(column, FINDING).alias("f")).select("f.*")
    valid = (F.size("anchors") >= 2) | (F.col("absent_from").isNotNull() & (F.size("anchors") >= 1))
    wrong = F.when(F.col("rule").isNull(), "no rule").when(F.coalesce("schema", F.lit(SCHEMA)) > SCHEMA, "written by a newer version").when(~F.coalesce(valid, F.lit(False)), "needs two anchors, or one and what it is absent from").when(F.trim("suppressed_by") == "", "suppressed without a reason")
    return f.withColumn("message", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.coalesce("rule", F.lit("?")), F.lit(": "), wrong)).cast("string")).otherwise(F.col("message"))).drop("schema")


def add_labels(spark: SparkSession, path: str, labels: DataFrame) -> None:
    """Puts labels (fingerprint, rule, correct, paper, why) into a store; a later label of a finding replaces the earlier one. An unsure reviewer's
    (correct null) counts against the rule, and says so."""
    from assaykit.sources.sinks import upsert

    sure = labels.withColumn("why", F.when(F.col("correct").isNull(), "ambiguous").otherwise(F.col("why"))).withColumn("correct", F.coalesce("correct", F.lit(False)))
    upsert(spark, path, sure.select(*[x.split()[0] for x in _LABEL.split(", ")], F.lit("found").alias("status")), "fingerprint")


def request_key(system: Column, user: Column, schema: Column, version: Column, model: Column) -> Column:
    """The identity of a question to a model: everything that may change its answer, nulls told from empty texts."""
    parts = {"model": model, "schema": schema, "system": system, "user": user, "version": version}
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in parts.items()])), 256)


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


# How each index writes a record.
INDEXES = {
    "crossref": "struct<title: array<string>, author: array<struct<family: string, given: string>>, `published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>, DOI: string>",
    "openalex": "struct<display_name: string, publication_year: int, doi: string, authorships: array<struct<author: struct<display_name: string>>>, primary_location: struct<source: struct<display_name: string>>, locations: array<struct<landing_page_url: string>>, ids: struct<pmcid: string>>",
    "csl": "struct<title: string, author: array<struct<family: string, given: string>>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: string, DOI: string>",
    "dblp": "struct<info: struct<title: string, year: string, venue: string, doi: string, authors: struct<author: array<struct<text: string>>>>>",
}


def index_record(index: str, body: Column) -> Column:
    """struct(source, title, year, authors, venue, doi, arxiv_id, pmcid) of a record's JSON as one of INDEXES writes it; null where it isn't JSON. What the
    index doesn't say is empty."""
    r = F.from_json(body, INDEXES[index])
    first = lambda x: F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))
    family = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<struct<family:string,given:string>>")), lambda p: F.when(p["family"].isNotNull(), F.rtrim(F.concat(p["family"], F.lit(", "), F.coalesce(p["given"], F.lit(""))), F.lit(", ")))), lambda n: n.isNotNull())
    parts = lambda d: F.try_element_at(F.try_element_at(d["date-parts"], F.lit(1)), F.lit(1)).cast("string")
    none = F.lit("")
    if index == "crossref":
        title, year, authors = first(r["title"]), F.coalesce(parts(r["published-print"]), parts(r["published-online"]), parts(r["issued"]), none), family(r["author"])
        venue, doi, arxiv, pmcid = first(r["container-title"]), r["DOI"], none, none
    elif index == "openalex":
        title, year = r["display_name"], F.coalesce(r["publication_year"].cast("string"), none)
        authors = F.filter(F.transform(F.coalesce(r["authorships"], F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
        pages = F.filter(F.transform(F.coalesce(r["locations"], F.array().cast("array<struct<landing_page_url:string>>")), lambda x: x["landing_page_url"]), lambda u: F.contains(F.lower(u), F.lit("arxiv.org")))
        venue, doi, arxiv, pmcid = r["primary_location"]["source"]["display_name"], r["doi"], F.coalesce(tx.arxiv_id(first(pages)), none), F.upper(F.regexp_extract(F.coalesce(r["ids"]["pmcid"], none), r"(?i)\b(PMC\d{4,})\b", 1))
    elif index == "csl":
        title, year, authors, venue, doi, arxiv, pmcid = r["title"], F.coalesce(parts(r["issued"]), none), family(r["author"]), r["container-title"], r["DOI"], none, none
    else:
        info = r["info"]
        names = F.transform(F.coalesce(info["authors"]["author"], F.array().cast("array<struct<text:string>>")), lambda a: F.regexp_replace(a["text"], r" \d{4}$", ""))
        title, year, authors, venue, doi, arxiv, pmcid = F.regexp_replace(info["title"], r"\.$", ""), info["year"], names, info["venue"], info["doi"], none, none
    made = F.struct(
        F.lit(index).alias("source"), _squeezed(title).alias("title"), F.coalesce(year, none).alias("year"), authors.alias("authors"), F.coalesce(venue, none).alias("venue"),
        tx.normalize_doi(F.coalesce(doi, none)).alias("doi"), arxiv.alias("arxiv_id"), pmcid.alias("pmcid"),
    )
    return F.when(r.isNotNull(), made)


def retry_after(attempt: Column, header: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait before a question is asked again: what the service says, or else twice as long each time, up to ``most``."""
    return F.least(F.coalesce(header.try_cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt)), F.lit(most))


def paced(requests: DataFrame, index: str, order: list[str], intervals: dict[str, float], other: float = 0.05) -> DataFrame:
    """Adds ``at``: the earliest second at which each request may be sent, so that each index gets its own spacing. Requests are a bounded list (a cap
    of fetches), ranked within their index."""
    spacing = F.create_map(*[F.lit(x) for p in intervals.items() for x in p])
    k = F.row_number().over(Window.partitionBy(index).orderBy(*order)) - 1
    return requests.withColumn("at", k * F.coalesce(F.try_element_at(spacing, F.col(index)), F.lit(other)))
