"""Facts of code repositories: configuration values, seeds, symbols, dependencies, entry points, links."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How strongly a value binds, what sets seeds, folders and sizes that aren't read.
CONSTANT, ARGPARSE, CONFIG_FILE, CONFIG_OVERRIDE = 10, 20, 30, 40
OVERRIDE_HINTS = ("override", "experiment", "exp_", "local", "custom")
SEED_FUNCTIONS = {"seed": "random", "manual_seed": "torch", "manual_seed_all": "torch.cuda", "set_seed": "transformers", "seed_everything": "lightning", "set_random_seed": "framework", "PRNGKey": "jax"}
SEED_ROOTS = frozenset(("random", "np", "numpy", "torch", "cuda", "tf", "jax"))
SKIPPED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox", ".eggs", "build", "dist", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "wandb", "outputs", "logs", "checkpoints")
MOST_FILES, MOST_BYTES = 4000, 512 << 10
SCHEMA = "struct<configs: array<struct<raw_name: string, value: string, binding: int, origin: string, start: int>>, seeds: array<struct<library: string, argument: string, varies: boolean, start: int>>, symbols: array<string>, unchecked: array<string>>"


def walk(files: DataFrame) -> DataFrame:
    """``files`` (repo_id, path, content) without skipped folders and files that are too large, the first by path of each repository; the
    status of the others says why they aren't read."""
    inside = F.concat(F.lit("/"), "path")
    skipped = F.exists(F.array(*[F.lit(f"/{s}/") for s in SKIPPED]), lambda s: F.contains(inside, s))
    seen = files.filter(~skipped).withColumn("k_", F.row_number().over(Window.partitionBy("repo_id").orderBy("path")))
    return seen.withColumn("status", F.when(F.col("k_") > MOST_FILES, "over the file limit").when(F.length("content") > MOST_BYTES, "too large").otherwise("read")).drop("k_")


def read_yaml(text: str, binding: int) -> tuple[list[dict], list[str]]:
    """Scalar leaves under dotted names by indentation, and what a ``defaults`` list composes, an entry each; documents that need more of YAML
    aren't read."""
    if re.search(r"(^|\s)[&*][A-Za-z]|^---.*\S.*^---", text, re.M | re.S):
        return [], ["yaml: anchors or several documents"]
    out, stack, at, composing = [], [], 0, -1
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        item = re.match(r"^(\s*)- +([^#]*?)\s*(?:#.*)?$", line)
        if item and 0 <= composing <= len(item[1]):
            name = item[2].rpartition(":")[2].strip().strip("'\"")
            if name and not name.startswith("_"):
                out.append({"raw_name": "defaults", "value": name, "binding": binding, "origin": "defaults", "start": begin + item.start(2)})
            continue
        m = re.match(r"^(\s*)([\w.-]+)\s*:\s*(.*?)\s*$", line.split(" #")[0])
        if line.lstrip().startswith(("#", "-")) or not m:
            continue
        depth = len(m[1])
        composing = depth if m[2] == "defaults" and not m[3] else -1
        while stack and stack[-1][0] >= depth:
            stack.pop()
        value = m[3].strip("'\"")
        if value and not value.startswith(("[", "{", "|", ">")):
            out.append({"raw_name": m[2], "value": value, "binding": binding, "origin": ".".join([*(n for _, n in stack), m[2]]), "start": begin + m.start(3)})
        elif not m[3]:
            stack.append((depth, m[2]))
    return out, []


def read_json(text: str, binding: int) -> tuple[list[dict], list[str]]:
    try:
        data = json.loads(text, parse_int=str, parse_float=str)
    except ValueError:
        return [], ["json: not readable"]
    out = []

    def leaves(x, path: list[str]) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                leaves(v, [*path, str(k)])
        elif path and isinstance(x, (str, bool)):
            out.append({"raw_name": path[-1], "value": str(x).lower() if isinstance(x, bool) else x, "binding": binding, "origin": ".".join(path), "start": max(0, text.find(f'"{path[-1]}"'))})

    leaves(data, [])
    return out, []


def read_python(text: str) -> tuple[list[dict], list[dict], list[str], list[str]]:
    """Defaults of arguments and literal constants, calls that set seeds, names defined; what can't be read from source is said."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], [], [], ["python: syntax error"]
    begins = [0]
    for line in text.split("\n"):
        begins.append(begins[-1] + len(line) + 1)
    at = lambda node: begins[node.lineno - 1] + node.col_offset
    configs, seeds, symbols, unchecked = [], [], [], []

    def literal(node) -> str | None:
        return ast.get_source_segment(text, node) if isinstance(node, ast.Constant) or (isinstance(node, ast.UnaryOp) and isinstance(node.operand, ast.Constant)) else None

    def visit(node, in_loop: bool) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            symbols.append(node.name)
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if name == "add_argument" and node.args and isinstance(node.args[-1], ast.Constant):
                flag = str(max((a.value for a in node.args if isinstance(a, ast.Constant)), key=lambda v: len(str(v))))
                for k in node.keywords:
                    if k.arg == "default":
                        value = literal(k.value)
                        if value is None:
                            unchecked.append(f"argument {flag} has a computed default")
                        elif value != "None":
                            configs.append({"raw_name": flag.lstrip("-"), "value": value.strip("'\""), "binding": ARGPARSE, "origin": "argparse", "start": at(k.value)})
            base = node.func
            while isinstance(base, ast.Attribute):
                base = base.value
            rooted = isinstance(node.func, ast.Name) or getattr(base, "id", "") in SEED_ROOTS or name in ("seed_everything", "set_seed")
            if name in SEED_FUNCTIONS and rooted:
                value = literal(node.args[0]) if node.args else None
                seeds.append({"library": SEED_FUNCTIONS[name], "argument": value, "varies": in_loop or value is None, "start": at(node)})
        loop = in_loop or isinstance(node, (ast.For, ast.While, ast.AsyncFor, ast.comprehension))
        for child in ast.iter_child_nodes(node):
            visit(child, loop)

    for node in root.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            value = literal(node.value)
            if value is not None:
                configs.append({"raw_name": node.targets[0].id, "value": value.strip("'\""), "binding": CONSTANT, "origin": "constant", "start": at(node.value)})
        visit(node, False)
    return configs, seeds, symbols, unchecked


def read_files(files: DataFrame) -> DataFrame:
    """repo_id, path, configs, seeds, symbols, unchecked of each file of ``files`` (repo_id, path, content)."""

    @F.pandas_udf(SCHEMA)
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for path, text in zip(paths, contents):
            text, low = text or "", path.lower()
            binding = CONFIG_OVERRIDE if any(h in low for h in OVERRIDE_HINTS) else CONFIG_FILE
            configs, seeds, symbols, unchecked = [], [], [], []
            if low.endswith((".yaml", ".yml")):
                configs, unchecked = read_yaml(text, binding)
            elif low.endswith(".json"):
                configs, unchecked = read_json(text, binding)
            elif low.endswith(".py"):
                configs, seeds, symbols, unchecked = read_python(text)
            out.append((configs, seeds, symbols, unchecked))
        return pd.DataFrame(out, columns=["configs", "seeds", "symbols", "unchecked"])

    return files.select("repo_id", "path", run("path", "content").alias("f")).select("repo_id", "path", "f.*")


def dependencies(files: DataFrame) -> DataFrame:
    """repo_id, name, constraint, pinned of each line of a requirements file."""
    lines = files.filter(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("repo_id", F.explode(F.split("content", "\n")).alias("line"))
    rx = r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|@)\s*[^\s;#]+)?"
    out = lines.filter(~F.col("line").rlike(r"^\s*(#|-|$)")).select("repo_id", F.regexp_extract("line", rx, 1).alias("name"), F.regexp_extract("line", rx, 2).alias("constraint"))
    return out.filter("name <> ''").withColumn("pinned", F.col("constraint").startswith("==") | F.col("constraint").startswith("@"))


def entrypoints(files: DataFrame) -> DataFrame:
    """repo_id, target, exists of each command of a README, once. A file's path and all its ends are derived, so an equality join finds targets."""
    rx = r"(?:^|\s)(?:python3?|torchrun|accelerate\s+launch|bash|sh|make)\s+(?:-m\s+([\w.]+)|([\w./-]+\.(?:py|sh)))"
    readme = files.filter(F.lower("path").rlike(r"(^|/)readme[^/]*$"))
    modules, scripts = F.regexp_extract_all("content", F.lit(rx), 1), F.regexp_extract_all("content", F.lit(rx), 2)
    targets = readme.select("repo_id", F.explode(F.zip_with(modules, scripts, lambda m, s: F.when(m != "", F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py"))).otherwise(s))).alias("target"))
    parts = F.split("path", "/")
    ends = files.select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("target"))
    package = ends.filter(F.col("target").endswith("/__init__.py")).select("repo_id", F.regexp_replace("target", "/__init__[.]py$", ".py").alias("target"))
    known = ends.union(package).distinct().withColumn("found_", F.lit(True))
    clean = targets.withColumn("target", F.regexp_replace("target", r"^\./", "")).distinct()
    return clean.join(known, ["repo_id", "target"], "left").select("repo_id", "target", F.coalesce("found_", F.lit(False)).alias("exists"))


# Owners whose repositories are tools that papers link, not their own code; endings of names that are no repository.
TOOL_OWNERS = ("pytorch", "tensorflow", "huggingface", "scikit-learn", "numpy", "scipy", "pandas", "matplotlib", "openai", "google", "google-research", "facebookresearch", "microsoft", "nvidia", "apache", "python", "jupyter", "conda-forge", "pypa", "actions", "docker")
NO_REPOSITORY = (".sty", ".cls", ".bib", ".tex", ".png", ".pdf", ".svg")


def own_repository(papers: DataFrame, doc: str = "doc_id", text: str = "raw") -> DataFrame:
    """doc, url, slug: the first repository that a paper links and that may be its own code, one for each paper."""
    found = F.regexp_extract_all(text, F.lit(r"(?:github|gitlab)[.]com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"), 0)
    parts = papers.select(doc, F.posexplode(found).alias("k", "found")).select(doc, "k", F.split("found", "/").alias("p"))
    name = F.regexp_replace(F.rtrim(F.col("p")[2], F.lit(".")), "(?i)[.]git$", "")
    named = parts.select(doc, "k", F.col("p")[0].alias("host"), F.col("p")[1].alias("owner"), name.alias("name"))
    ends = F.exists(F.array(*map(F.lit, NO_REPOSITORY)), lambda e: F.endswith(F.lower("name"), e))
    own = named.filter(~F.lower("owner").isin(*TOOL_OWNERS) & ~ends & (F.col("name") != ""))
    first = own.groupBy(doc).agg(F.min_by(F.struct("host", "owner", "name"), "k").alias("r"))
    return first.select(doc, F.concat_ws("/", F.lit("https:/"), "r.host", "r.owner", "r.name").alias("url"), F.concat_ws("/", "r.owner", "r.name").alias("slug"))


def links(files: DataFrame) -> DataFrame:
    """repo_id, link, kind of the addresses in documents."""
    docs = files.filter(F.lower("path").rlike(r"\.(md|txt|rst)$"))
    raw = docs.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r"https?://[^\s<>\"')\]},]+"), 0)).alias("raw"))
    link = F.regexp_replace("raw", "[.,;:]+$", "")
    kind = F.when(F.lower(link).rlike("ckpt|checkpoint|weights|models"), "checkpoint").when(F.contains(F.lower(link), F.lit("dataset")), "dataset").otherwise("link")
    return raw.select("repo_id", link.alias("link"), kind.alias("kind")).distinct()
