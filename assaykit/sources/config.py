"""The configuration beside a paper: waivers with their reasons, rules switched on or off, the model's settings.

A file has three sections, ``suppress`` (a list of mappings: rule, reason, and perhaps match, expires), ``rules`` (rule: on or off) and ``model``
(name: value). A waiver without a reason is refused: the file is the record of every judgement in it."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

NAMES = (".assay.yml", ".assay.yaml")
# Words that switch a rule off, and on.
OFF, ON = ("off", "false", "no", "disabled"), ("on", "true", "yes", "enabled")
WAIVER = "seq int, rule string, reason string, match string, expires date"
EMPTY = "# suppress:\n#   - rule: family/name\n#     reason: why the finding stands\n#     match: part of its message\n#     expires: 2030-01-31\nsuppress:\nrules:\nmodel:\n"


class ConfigError(ValueError):
    """A configuration that can't be honoured as it is written."""


@dataclass
class Config:
    waivers: list[dict] = field(default_factory=list)
    disabled: set[str] = field(default_factory=set)
    enabled: set[str] = field(default_factory=set)
    model: dict[str, str] = field(default_factory=dict)
    path: str | None = None

    def waiver_rows(self, spark: SparkSession) -> DataFrame:
        """seq, rule, reason, match, expires, in the file's order."""
        return spark.createDataFrame([(i + 1, w["rule"], w["reason"], w.get("match"), w.get("expires")) for i, w in enumerate(self.waivers)], WAIVER)


def _content(line: str) -> str:
    """A line without its comment; a # within quotes isn't one."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i].rstrip()
    return line.rstrip()


def _pair(item: str) -> tuple[str, str] | None:
    name, colon, value = item.partition(":")
    value = value.strip()
    if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
        value = value[1:-1]
    return (name.strip(), value) if colon and name.strip() else None


def parse(text: str, path: str | None = None) -> Config:
    out, section = Config(path=path), ""
    for line in map(_content, text.splitlines()):
        body = line.strip()
        if not body:
            continue
        if line[0] not in " \t-":
            head = _pair(body)
            section = head[0] if head else ""
            continue
        begins = body.startswith("- ")
        pair = _pair(body[2:] if begins else body)
        if section == "suppress":
            if begins:
                out.waivers.append({})
            if pair and out.waivers:
                out.waivers[-1][pair[0]] = pair[1]
        elif section == "rules" and pair:
            state = pair[1].lower()
            if state in OFF:
                out.disabled.add(pair[0])
            elif state in ON:
                out.enabled.add(pair[0])
        elif section == "model" and pair:
            out.model[pair[0]] = pair[1]
    for i, waiver in enumerate(out.waivers):
        if not waiver.get("rule"):
            raise ConfigError(f"waiver {i + 1} names no rule")
        if not waiver.get("reason", "").strip():
            raise ConfigError(f"waiver {i + 1}, of {waiver['rule']}, has no reason")
        waiver["match"] = waiver.get("match") or None
        until = waiver.get("expires")
        try:
            waiver["expires"] = datetime.date.fromisoformat(until) if until else None
        except ValueError as e:
            raise ConfigError(f"waiver {i + 1}, of {waiver['rule']}: {e}") from e
    return out


def read(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), path)


def discover(start: str) -> Config:
    """The nearest configuration in the folder of ``start`` or above it; an empty one if there is none. It is read on the driver, beside the papers
    of a user; papers in other stores have theirs named."""
    folder = os.path.abspath(start if os.path.isdir(start) else os.path.dirname(start))
    while True:
        for name in NAMES:
            if os.path.isfile(os.path.join(folder, name)):
                return read(os.path.join(folder, name))
        above = os.path.dirname(folder)
        if above == folder:
            return Config()
        folder = above
