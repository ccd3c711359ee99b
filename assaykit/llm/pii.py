"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds (``email ip card phone``) follow fixed rules and always count. Further kinds are proposed by
an expression, confirmed where a checksum exists (mod 97 for IBANs, Luhn for short card numbers), and
kept where their score, raised by context words nearby and lowered by words that deny it, reaches ``accept``.

All searches are linear in the text, also in long runs of one character. Offsets are code points.

Odd input: a null text is an empty one and has no span; its digest is that of the empty string. Spans of
further kinds that overlap an accepted span are dropped, the earlier kind in ``EXTRA_KINDS`` and then the earlier start going first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "card_short", "national_id")
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long, min_score double"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does, and takes whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SHORT_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Country code and length of its IBANs, for all of the IBAN registry.
_IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29,
    PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
    YE=30,
)
# Words near a span that raise or lower its score.
_CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "card_short": ("card", "amex", "credit", "payment", "karte", "tarjeta", "carte"),
    "national_id": ("ssn", "social", "security", "national", "identity"),
}
_DENY = ("example", "sample", "version", "isbn", "part", "serial")
_START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "card_short": 0.4, "national_id": 0.4}


@dataclass(frozen=True)
class PiiParams:
    accept: float = 0.6
    window: int = 48
    raise_by: float = 0.25
    lower_by: float = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, but from each @ back
    to where its run begins, so no run is read twice."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 64 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def score(text: str, kind: str, start: int, end: int, p: PiiParams) -> float:
    near = re.findall(r"[a-z]+", (text[max(0, start - p.window) : start] + " " + text[end : end + p.window // 2]).lower())
    s = _START[kind]
    s += p.raise_by * any(w.startswith(c) if len(c) > 3 else w == c for w in near for c in _CONTEXT[kind])
    s -= p.lower_by * any(w in _DENY for w in near)
    return min(1.0, max(0.0, s))


def extra_spans(text: str, taken: list[tuple[int, int]], p: PiiParams) -> list[tuple[str, int, int, float]]:
    out: list[tuple[str, int, int, float]] = []
    for kind in EXTRA_KINDS:
        for m in {"iban": _IBAN, "card_short": _SHORT_CARD, "national_id": _NATIONAL}[kind].finditer(text):
            start, end = m.span()
            if kind == "iban":
                # the expression may run on into a following word; the country's length decides
                length, seen, cut = _IBAN_LENGTHS.get(m[0][:2]), 0, None
                for i, c in enumerate(m[0]):
                    seen += c != " "
                    if seen == length:
                        cut = i + 1
                        break
                if cut is None or text[start + cut : start + cut + 1].isalnum() or not mod97(m[0][:cut].replace(" ", "")):
                    continue
                end = start + cut
            if kind == "card_short" and not luhn(_digits(m[0])):
                continue
            s = score(text, kind, start, end, p)
            if s >= p.accept and not any(a < end and start < b for a, b in taken):
                out.append((kind, start, end, s))
                taken.append((start, end))
    return out


def find(text: str, p: PiiParams = PiiParams()) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    base = base_spans(text) if any(c in text for c in "@0123456789") else {k: [] for k in BASE_KINDS}
    taken = [s for v in base.values() for s in v]
    return base, extra_spans(text, taken, p) if any(c in text for c in "0123456789") else []


def redact(text: str, p: PiiParams = PiiParams()) -> str:
    """The text with every span replaced by its kind in brackets. Of spans that overlap, the first stays whole
    and the rest of the other is covered as well."""
    base, extra = find(text, p)
    spans = sorted([(a, b, k) for k, v in base.items() for a, b in v] + [(a, b, k) for k, a, b, _ in extra])
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if spans else text


def detect(text: Column, params: PiiParams = PiiParams()) -> Column:
    """struct with counts and digest of the base spans, and all spans, of a text column."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t if isinstance(t, str) else ""
            base, extra = find(t, params)
            own = [f"{k}:{a}:{b}" for k in BASE_KINDS for a, b in base[k]]
            scores = [score(t, k, a, b, params) for k in BASE_KINDS for a, b in base[k]] + [s for *_, s in extra]
            more = [f"{k}:{a}:{b}" for k, a, b, _ in extra]
            rows.append((*(len(base[k]) for k in BASE_KINDS), hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + more), len(more), min(scores, default=None)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return run(text)


def personal_data(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id and what ``detect`` finds in every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", detect(F.col("text"), params).alias("p")).select("doc_id", "p.*")


def redacted(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with all its columns, personal data in ``text`` replaced, ``n_chars`` counted anew
    where the text changed. A null text stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, params) if isinstance(t, str) else None for t in texts], dtype=object)

    out = docs.withColumn("text", run(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
