"""LaTeX and JATS as plain text that knows where every character came from.

Scanners are sequential, so they run in Python, once for each document; everything after them is relational."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Commands by what becomes of them and their argument.
KEEP_ARG = frozenset("textbf textit textrm textsf texttt textsc textnormal emph underline text mathrm mathbf mathit operatorname paragraph title caption".split())
HEADINGS = frozenset(("section", "subsection", "subsubsection"))
DROP_ARG = frozenset("label ref eqref pageref includegraphics usepackage documentclass bibliographystyle bibliography input include hspace vspace setlength color textcolor footnote cite citep citet citeauthor citeyear citealp nocite autoref cref Cref url href includepdf".split())
DEFINE = frozenset(("newcommand", "renewcommand", "providecommand", "def", "DeclareMathOperator"))
DROP_ENV = frozenset(("figure", "figure*", "thebibliography", "lstlisting", "verbatim", "comment"))
SYMBOLS = {"chi": "chi", "alpha": "alpha", "beta": "beta", "mu": "mu", "sigma": "sigma", "leq": "<=", "geq": ">=", "neq": "!=", "approx": "~", "times": "x", "pm": "+/-", "ldots": "...", "cdot": ".", "%": "%", "&": "&", "_": "_", "#": "#", "$": "$", "{": "{", "}": "}"}
# JATS elements that hold prose, and those dropped wherever they are.
JATS_PROSE = ("article-title", "abstract", "body")
JATS_SKIP = frozenset("table-wrap ref-list fn-group front-stub graphic inline-graphic media supplementary-material disp-formula inline-formula tex-math mml:math math".split())
JATS_BLOCKS = frozenset(("p", "title", "sec", "abstract", "body", "article-title", "list-item", "caption"))

_COMMAND = re.compile(r"\\([A-Za-z@]+\*?|.)", re.S)
_SPECIAL = re.compile(r"[\\%~&{}$\s]")
_TAG = re.compile(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>|<!\[CDATA\[(?P<data>.*?)\]\]>|<(?P<close>/?)(?P<name>[A-Za-z_][\w.:-]*)(?P<attrs>[^<>]*?)(?P<empty>/?)>", re.S)


@dataclass
class Section:
    name: str
    start: int
    end: int


@dataclass
class Plain:
    """text, the place in the source of each of its characters, and sections over the text."""

    raw: str
    text: str
    offsets: list[int]
    sections: list[Section] = field(default_factory=list)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """A range of the text as a range of the source."""
        if start >= end or not self.offsets:
            return (self.offsets[min(start, len(self.offsets) - 1)] if self.offsets else 0,) * 2
        return self.offsets[start], self.offsets[end - 1] + 1

    def section_at(self, at: int) -> str:
        return next((s.name for s in self.sections if s.start <= at < s.end), "")

    def body_start(self) -> int:
        """The first character that stands after the document has begun."""
        k = self.raw.find("\\begin{document}")
        return bisect_right(self.offsets, k) if k >= 0 else 0


def line_of(raw: str, at: int) -> int:
    return raw.count("\n", 0, at) + 1


def group_end(s: str, at: int, brackets: str = "{}") -> int:
    """Past the bracket that closes the one at ``at``; the end of the text if none does."""
    depth, i = 0, at
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        depth += (c == brackets[0]) - (c == brackets[1])
        i += 1
        if not depth:
            return i
    return len(s)


def uncomment(raw: str) -> str:
    """Comments as blanks, so that places stay what they were."""
    return re.sub(r"(?<!\\)%[^\n]*", lambda m: " " * len(m[0]), raw)


def _macros(raw: str) -> dict[str, str]:
    out = {}
    for m in re.finditer(r"\\(?:re|provide)?newcommand\*?\s*\{?\\([A-Za-z@]+)\}?\s*(\[\d\])?\s*\{", raw):
        body = raw[m.end() : group_end(raw, m.end() - 1) - 1]
        if not m[2] and "\\" not in body and len(body) < 200:
            out[m[1]] = body
    return out


class _Writer:
    def __init__(self) -> None:
        self.chars: list[str] = []
        self.at: list[int] = []

    def put(self, s: str, at: int, step: int = 0) -> None:
        for k, c in enumerate(s):
            self.chars.append(c)
            self.at.append(at + k * step)

    def run(self, s: str, at: int) -> None:
        """Characters as they stand in the source from ``at`` on."""
        self.chars.extend(s)
        self.at.extend(range(at, at + len(s)))

    def space(self, at: int, c: str = " ") -> None:
        """White space collapses; a newline wins over a space."""
        if self.chars and self.chars[-1] in " \n":
            if c == "\n":
                self.chars[-1] = c
        elif self.chars:
            self.put(c, at)


def latex(raw: str) -> Plain:
    w, i, macros, heads = _Writer(), 0, _macros(raw), []
    while i < len(raw):
        c = raw[i]
        if c == "%":
            end = raw.find("\n", i)
            i = len(raw) if end < 0 else end + 1
        elif c == "\\":
            m = _COMMAND.match(raw, i)
            if not m:
                break
            name, after = m[1].rstrip("*"), m.end()
            if m[1] in ("\\", "newline"):
                w.space(i, "\n")
            elif name in ("begin", "end") and raw[after : after + 1] == "{":
                close = group_end(raw, after)
                env = raw[after + 1 : close - 1]
                after = close
                if name == "begin" and env in DROP_ENV:
                    stop = raw.find("\\end{" + env + "}", close)
                    after = len(raw) if stop < 0 else stop + len(env) + 6
                elif name == "begin":  # arguments of the environment, as a table's columns
                    while raw[after : after + 1] in ("[", "{") and raw[after : after + 1]:
                        after = group_end(raw, after, "[]" if raw[after] == "[" else "{}")
                w.space(i, "\n")
            elif name in HEADINGS:
                at = raw.find("{", after)
                close = group_end(raw, at) if 0 <= at <= after + 200 else after
                heads.append((latex(raw[at + 1 : close - 1]).text.strip() if at >= 0 else "", len(w.chars)))
                w.space(i, "\n")
                after = close
            elif name in DEFINE:
                while after < len(raw) and raw[after] in " \t\n*":
                    after += 1
                if raw[after : after + 1] == "\\":
                    after = _COMMAND.match(raw, after).end()
                while raw[after : after + 1] in ("{", "[") and raw[after : after + 1]:
                    after = group_end(raw, after, "[]" if raw[after] == "[" else "{}")
                    while raw[after : after + 1] in (" ", "\t"):
                        after += 1
            elif name in DROP_ARG or name.lower().startswith("cite"):
                while raw[after : after + 1] in ("[", "{") and raw[after : after + 1]:
                    after = group_end(raw, after, "[]" if raw[after] == "[" else "{}")
            elif name in SYMBOLS:
                w.put(SYMBOLS[name], i)
            elif name in macros:
                w.put(macros[name], i)
            elif name in KEEP_ARG and raw[after : after + 1] == "[":
                after = group_end(raw, after, "[]")
            elif m[1] in (",", ";", ":", " ", "quad", "qquad"):
                w.space(i)
            i = after
        elif c.isspace():
            end = i
            while end < len(raw) and raw[end].isspace():
                end += 1
            w.space(i, "\n" if raw.count("\n", i, end) > 1 else " ")
            i = end
        elif c in "~&":
            w.space(i)
            i += 1
        elif c in "{}$":
            i += 1
        else:
            end = _SPECIAL.search(raw, i)
            end = end.start() if end else len(raw)
            w.run(raw[i:end], i)
            i = end
    n = len(w.chars)
    sections = [Section(name, start, heads[k + 1][1] if k + 1 < len(heads) else n) for k, (name, start) in enumerate(heads)]
    return Plain(raw, "".join(w.chars), w.at, sections)


def jats(raw: str) -> Plain:
    w, stack, sections, opened = _Writer(), [], [], []
    prose = skip = 0
    title: list[int] = []
    seen_title = False

    def text(start: int, end: int, plain: bool = False) -> None:
        if not prose or skip:
            return
        i = start
        while i < end:
            c = raw[i]
            m = None if plain or c != "&" else re.compile(r"&(#\d+|#x[0-9A-Fa-f]+|\w+);").match(raw, i, end)
            if m:
                w.put(html.unescape(m[0]), i)
                i = m.end()
            elif c.isspace():
                w.space(i)
                i += 1
            else:
                stop = re.compile(r"[&\s]").search(raw, i + 1, end)
                stop = stop.start() if stop else end
                w.run(raw[i:stop], i)
                i = stop

    last = 0
    for m in _TAG.finditer(raw):
        text(last, m.start())
        last = m.end()
        if m["data"] is not None:
            text(*m.span("data"), plain=True)
        name = m["name"]
        if not name or m["empty"]:
            continue
        if not m["close"]:
            stack.append(name)
            if name == "article-title" and seen_title and "front" not in stack:
                skip += 1
                continue
            prose += name in JATS_PROSE
            skip += name in JATS_SKIP
            if name == "sec":
                opened.append([None, len(w.chars)])
            if name == "title" and opened and opened[-1][0] is None:
                title.append(len(w.chars))
        elif name in stack:
            while stack:
                top = stack.pop()
                if top == "article-title" and seen_title and "front" not in stack:
                    skip -= 1
                else:
                    prose -= top in JATS_PROSE
                    skip -= top in JATS_SKIP
                    seen_title |= top == "article-title"
                if top == "title" and title and opened:
                    opened[-1][0] = "".join(w.chars[title.pop() :]).strip()
                if top == "sec" and opened:
                    own = opened.pop()
                    sections.append(Section(own[0] or "", own[1], len(w.chars)))
                if top in JATS_BLOCKS and prose >= 0:
                    w.space(m.start(), "\n")
                if top == name:
                    break
    text(last, len(raw))
    return Plain(raw, "".join(w.chars), w.at, sorted(sections, key=lambda s: s.start))


def is_jats(raw: str) -> bool:
    head = raw[:4000].lower()
    return "<article" in head and any(x in head for x in ("jats", "article-type", "<front", "<journal-meta", "dtd-version"))


def is_bbl(text: str) -> bool:
    return "\\bibitem" in text


def read(raw: str) -> Plain:
    return jats(raw) if is_jats(raw) else latex(raw)


def prose(raw: str) -> str:
    """A text as paragraphs with blank lines between them, for retrieval: places don't matter here, paragraphs do. Blank lines part LaTeX, the p elements of
    abstract and body part JATS; XML that can't be read gives nothing."""
    if not is_jats(raw):
        blocks = (" ".join(latex(block).text.split()) for block in re.split(r"\n[ \t]*\n", raw))
        return "\n\n".join(b for b in blocks if b)
    import xml.etree.ElementTree as tree

    try:
        root = tree.fromstring(raw)
    except tree.ParseError:
        return ""
    paragraphs = (" ".join("".join(p.itertext()).split()) for tag in ("abstract", "body") for part in root.iter(tag) for p in part.iter("p"))
    return "\n\n".join(p for p in paragraphs if p)


def jats_title(raw: str) -> str:
    """The first article title; empty if there is none."""
    m = re.search(r"<article-title\b[^>]*>(.*?)</article-title>", raw, re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", m[1])).split()) if m else ""
