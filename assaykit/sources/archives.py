"""Papers as files: scans, archives, the root document, includes, the bibliography beside it."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Guards on archives, and names of files that aren't the paper.
MOST_PACKED, MOST_UNPACKED, MOST_MEMBERS, MOST_RATIO = 80 << 20, 512 << 20, 20_000, 200
NOT_THE_PAPER = ("supplement", "appendix", "response", "cover", "letter", "rebuttal", "readme", "makefile")
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex", "article.tex")
GLOBS = ("*.tex", "*.tar.gz", "*.tgz", "*.zip", "*.nxml", "*.xml")
INCLUDE_DEPTH = 6


class Refused(ValueError):
    """An input that isn't read, with the reason."""


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, content of the files under a folder, but for those in code repositories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.filter(~F.contains("path", F.lit("/repo/"))).select("path", "length", "content")


def status(content: Column) -> Column:
    """What content says it is: extensions aren't believed."""
    head = F.substring(content, 1, 4096)
    return (
        F.when(F.length(content) == 0, "empty")
        .when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf")
        .when(F.substring(content, 1, 2).isin(F.lit(b"\x1f\x8b"), F.lit(b"BZ"), F.lit(b"PK")), "archive")
        .when(F.substring(content, 258, 5) == F.lit(b"ustar"), "archive")
        .when(F.contains(head, F.lit(b"\x00")), "binary")
        .otherwise("text")
    )


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _bounded(f, most: int) -> bytes:
    out = f.read(most + 1)
    if len(out) > most:
        raise Refused("too large when unpacked")
    return out


def unpack(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The regular members of an archive, or a single compressed file; refuses what expands beyond the guards or leaves its folder."""
    if len(data) > MOST_PACKED:
        raise Refused("archive is too large")
    left, n = MOST_UNPACKED, 0

    def checked(name: str, size: int) -> None:
        nonlocal n, left
        n += 1
        left -= size
        if n > MOST_MEMBERS:
            raise Refused("too many members")
        if left < 0:
            raise Refused("too large when unpacked")
        if name.startswith("/") or ".." in name.split("/"):
            raise Refused("a member leaves its folder")

    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                checked(info.filename, info.file_size)
                if info.file_size > MOST_RATIO * max(1, info.compress_size):
                    raise Refused("compression ratio is too high")
                with z.open(info) as f:
                    yield info.filename, _bounded(f, info.file_size)
        return
    if data[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(data)) as f:
            data = _bounded(f, MOST_UNPACKED)
    elif data[:3] == b"BZh":
        with bz2.open(io.BytesIO(data)) as f:
            data = _bounded(f, MOST_UNPACKED)
    if data[257:262] != b"ustar":
        yield "main.tex", data
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                checked(m.name, m.size)
                yield m.name, t.extractfile(m).read()


def members(archives: DataFrame) -> DataFrame:
    """path, member, text, refused of the text members of each archive (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    for name, data in unpack(content.as_py() or b""):
                        if name.lower().endswith((".tex", ".ltx", ".bib", ".bbl", ".xml", ".nxml")) and b"\x00" not in data[:4096]:
                            rows.append((path, name, decode(data), None))
                except (Refused, OSError, EOFError, tarfile.TarError, zipfile.BadZipFile) as e:
                    rows = [(path, None, None, str(e)[:200])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, names=["path", "member", "text", "refused"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, text string, refused string")


def root_score(member: Column, text: Column) -> Column:
    """How likely a file is the paper itself."""
    name = F.lower(F.substring_index(member, "/", -1))
    score = 4 * F.contains(text, F.lit("\\documentclass")).cast("int") + 4 * F.contains(text, F.lit("\\begin{document}")).cast("int")
    score = score + 2 * (F.contains(text, F.lit("\\title")) | F.contains(text, F.lit("\\maketitle"))).cast("int") + 3 * name.isin(*MAIN_NAMES).cast("int")
    return score - 6 * F.exists(F.array(*map(F.lit, NOT_THE_PAPER)), lambda w: F.contains(name, w)).cast("int")


def roots(files: DataFrame) -> DataFrame:
    """path, root: of each archive the member that is most likely the paper, the longest of those."""
    tex = files.filter(F.lower("member").rlike("[.](tex|ltx)$"))
    best = F.struct(root_score(F.col("member"), F.col("text")).alias("s"), F.length("text").alias("n"), "member")
    return tex.groupBy("path").agg(F.max(best).alias("b")).select("path", F.col("b.member").alias("root"))


def bibliographies(files: DataFrame) -> DataFrame:
    """path, bibliography: the longest .bib of each archive, or else the longest .bbl."""
    rank = F.when(F.lower("member").endswith(".bib"), 2).when(F.lower("member").endswith(".bbl"), 1)
    own = files.withColumn("r_", rank).filter("r_ IS NOT NULL")
    return own.groupBy("path").agg(F.max_by("text", F.struct("r_", F.length("text").alias("n"), "member")).alias("bibliography"))


_INPUT = re.compile(r"\\(?:input|include)\s*\{([^}]+)\}|\\input\s+([^\s{}]+)")


def splice(root: str, files: dict[str, str]) -> tuple[str, list[tuple[int, int, str, int]]]:
    """The root with its includes in place, each file once, and which range came from where: (start, end, file, start there)."""
    out: list[str] = []
    regions: list[tuple[int, int, str, int]] = []
    seen, length = set(), 0

    def find(name: str) -> str | None:
        name = name.strip().removeprefix("./")
        return next((f for f in (name, f"{name}.tex") if f in files), next((f for f in sorted(files) if f.split("/")[-1] in (name.split("/")[-1], name.split("/")[-1] + ".tex")), None))

    def add(name: str, a: int, b: int) -> None:
        nonlocal length
        if b > a:
            out.append(files[name][a:b])
            regions.append((length, length + b - a, name, a))
            length += b - a

    def walk(name: str, depth: int) -> None:
        seen.add(name)
        text, at = files[name], 0
        for m in _INPUT.finditer(text):
            if "%" in text[text.rfind("\n", 0, m.start()) + 1 : m.start()]:
                continue
            other = find(m[1] or m[2])
            if other and other not in seen and depth < INCLUDE_DEPTH:
                add(name, at, m.start())
                walk(other, depth + 1)
                at = m.end()
        add(name, at, len(text))

    walk(root, 0)
    return "".join(out), regions


def loose_bibliographies(loose: DataFrame) -> DataFrame:
    """folder, bibliography: the single .bib beside loose papers, or else the single .bbl; where there are several, none is taken."""
    kind = F.lower(F.regexp_extract("member", r"[.](bib|bbl)$", 1))
    own = loose.withColumns({"kind_": kind, "folder": F.regexp_replace("path", "[^/]*$", "")}).filter("kind_ <> ''")
    per = own.groupBy("folder", "kind_").agg(F.count("*").alias("n_"), F.min("text").alias("text_")).filter("n_ = 1")
    return per.groupBy("folder").agg(F.min_by("text_", "kind_").alias("loose_bibliography"))


def refused(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, status of what stands under a folder as a paper and can't be read: why is said for each."""
    files = scan(spark, root).withColumn("status", status(F.col("content")))
    wanted = F.lower("path").rlike("[.](tex|ltx|xml|nxml|pdf|zip|tar|tgz|gz|bz2)$")
    bad = files.filter(wanted & ~F.col("status").isin("text", "archive")).select(F.col("path").alias("doc_id"), "path", "status")
    inside = members(files.filter("status = 'archive'"))
    broken = inside.filter("refused IS NOT NULL").select(F.col("path").alias("doc_id"), "path", F.col("refused").alias("status"))
    held = inside.filter("refused IS NULL").select("path").distinct()
    empty = files.filter("status = 'archive'").select("path").join(held, "path", "left_anti").join(broken.select("path"), "path", "left_anti").select(F.col("path").alias("doc_id"), "path", F.lit("no .tex in the archive").alias("status"))
    return bad.unionByName(broken).unionByName(empty)


def papers(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, raw, bibliography, regions of every paper under a folder; a paper's files are those of one archive, or one file with the bibliography
    beside it. What can't be read is in ``refused``."""
    files = scan(spark, root).withColumn("status", status(F.col("content")))
    loose = files.filter("status = 'text'").select("path", F.substring_index("path", "/", -1).alias("member"), F.col("content").cast("string").alias("text"))
    inside = members(files.filter("status = 'archive'")).filter("refused IS NULL").select("path", "member", "text")
    every = inside.unionByName(loose.filter(F.lower("member").rlike("[.](tex|ltx|xml|nxml)$")))
    picked = every.join(roots(every).unionByName(loose.filter(F.lower("member").rlike("xml$")).select("path", F.col("member").alias("root"))), "path")

    @F.pandas_udf("struct<raw: string, regions: array<struct<start: int, end: int, name: string, base: int>>>")
    def joined(root_name, names, texts):
        import pandas as pd

        out = []
        for r, n, t in zip(root_name, names, texts):
            text, regions = splice(r, dict(zip(n, t)))
            out.append({"raw": text, "regions": [dict(zip(("start", "end", "name", "base"), x)) for x in regions]})
        return pd.DataFrame(out, columns=["raw", "regions"])

    # the files of one archive, bounded by its guards
    grouped = picked.groupBy("path", "root").agg(F.collect_list("member").alias("names"), F.collect_list("text").alias("texts"))
    out = grouped.select("path", joined("root", "names", "texts").alias("j")).join(bibliographies(inside), "path", "left")
    beside = loose.filter(F.lower("member").rlike("[.](tex|ltx)$")).select("path", F.regexp_replace("path", "[^/]*$", "").alias("folder")).join(loose_bibliographies(loose), "folder")
    out = out.join(beside.select("path", "loose_bibliography"), "path", "left")
    return out.select(F.col("path").alias("doc_id"), "j.raw", F.coalesce("bibliography", "loose_bibliography").alias("bibliography"), "j.regions")
