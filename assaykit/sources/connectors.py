"""Live answers, where they are wanted: indexes, full texts and models, asked outside of any deterministic plan.

A connector has ``ask(request) -> answer``, both plain dicts; what it can't answer is null, and what goes wrong is its exception. ``answers`` asks one for each
question of a table, within Spark's tasks: the client is built once in each worker from a function that travels, questions answered before come from
the store, and a failure is an answer as well (status unknown), never the end of a job. The engine only ever reads the table that comes out."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.sources import sinks

ANSWER = "key string, status string, answer string, error string"


class Connector(Protocol):
    """What may be plugged in: an index, a source of texts, a model."""

    def ask(self, request: dict) -> dict | None: ...


@dataclass
class Nothing:
    """Answers nothing, as offline runs do."""

    def ask(self, request: dict) -> dict | None:
        raise ConnectionError("offline")


@dataclass
class Remembered:
    """A connector that is asked each thing once; what failed may be asked again."""

    inner: Connector
    known: dict = field(default_factory=dict)

    def ask(self, request: dict) -> dict | None:
        key = json.dumps(request, sort_keys=True)
        if key not in self.known:
            self.known[key] = self.inner.ask(request)
        return self.known[key]


@dataclass
class Spaced:
    """A connector that is asked no sooner than ``every`` seconds after the last time. ``clock`` and ``sleep`` can be replaced in tests."""

    inner: Connector
    every: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def ask(self, request: dict) -> dict | None:
        now = self.clock()
        wait = 0.0 if self.last is None else max(0.0, self.last + self.every - now)
        self.last = now + wait
        if wait:
            self.sleep(wait)
        return self.inner.ask(request)


class Stalled(TimeoutError):
    """Nothing has come back for too long."""


@dataclass
class Patient:
    """A connector that is asked again when a service is busy: after what it says (a header, or seconds in its message), or else after twice as long each
    time, up to ``longest``. After ``tries``, or ``stall`` seconds in all, it gives up."""

    inner: Connector
    tries: int = 4
    first: float = 2.0
    longest: float = 30.0
    stall: float = 120.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def wait_for(self, e: urllib.error.HTTPError, attempt: int) -> float:
        said = (e.headers or {}).get("Retry-After") or ""
        body = re.search(r"([0-9.]+) ?s(?:ec)?", getattr(e, "said", "")) if not said else None
        for text, more in ((said, 0.0), (body[1] if body else "", 0.5)):
            try:
                return min(float(text) + more, self.longest)
            except ValueError:
                continue
        return min(self.first * 2**attempt, self.longest)

    def ask(self, request: dict) -> dict | None:
        began = self.clock()
        for attempt in range(self.tries):
            try:
                return self.inner.ask(request)
            except urllib.error.HTTPError as e:
                if e.code not in (429, 502, 503, 504) or attempt + 1 == self.tries:
                    raise
                wait = self.wait_for(e, attempt)
                if self.clock() + wait - began > self.stall:
                    raise Stalled(f"no answer within {self.stall:g} s") from e
                self.sleep(wait)
        return None


def fetch(url: str, body: dict | None = None, headers: dict[str, str] | None = None, timeout: float = 20.0, most: int = 8 << 20) -> bytes:
    """The content of an address, ``most`` bytes of it at most; a 404 is an HTTPError like others, with what the service said in ``said``."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data=data, headers={"User-Agent": "assaykit", **({"Content-Type": "application/json"} if data else {}), **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read(most)
    except urllib.error.HTTPError as e:
        e.said = e.read(4096).decode("utf-8", "replace")
        raise


@dataclass
class Index:
    """An index of works: ``address`` has {doi} and {title}, and gives JSON; ``found`` names the way to the record, or to a list whose first entry it is. The record
    is read by ``records.index_record``. A 404 is an answer: the index doesn't hold the work."""

    address: str
    found: tuple[str, ...] = ()
    timeout: float = 5.0

    def ask(self, request: dict) -> dict | None:
        url = self.address.format(**{k: urllib.parse.quote(str(request.get(k) or ""), safe="") for k in ("doi", "title")})
        try:
            body = json.loads(fetch(url, timeout=self.timeout))
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise
        for name in self.found:
            body = (body or {}).get(name)
        body = body[0] if isinstance(body, list) and body else body
        return body or None


# Where the public indexes answer, and the way to the record.
INDEXES = {
    "crossref": ("https://api.crossref.org/works/{doi}", ("message",)),
    "openalex": ("https://api.openalex.org/works?filter=doi:{doi}", ("results",)),
    "csl": ("https://data.crosscite.org/application/vnd.citationstyles.csl+json/{doi}", ()),
    "dblp": ("https://dblp.org/search/publ/api?format=json&q={title}", ("result", "hits", "hit")),
}


@dataclass
class FullText:
    """The text of a cited work as paragraphs: an e-print archive by arxiv_id, or JATS by pmcid; ``most`` characters of it."""

    eprints: str = "https://export.arxiv.org/e-print/{arxiv_id}"
    articles: str = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pmc&id={pmcid}"
    most: int = 400_000
    timeout: float = 40.0

    def ask(self, request: dict) -> dict | None:
        from assaykit.sources import archives, markup

        if request.get("arxiv_id"):
            data = fetch(self.eprints.format(arxiv_id=request["arxiv_id"]), timeout=self.timeout, most=archives.MOST_PACKED)
            texts = [archives.decode(b) for name, b in archives.unpack(data) if name.endswith(".tex")]
            raw = max(texts, key=lambda t: ("\\begin{document}" in t, len(t)), default="")
        elif request.get("pmcid"):
            raw = archives.decode(fetch(self.articles.format(pmcid=request["pmcid"].removeprefix("PMC")), timeout=self.timeout, most=archives.MOST_PACKED))
        else:
            return None
        text = markup.prose(raw)[: self.most]
        return {"text": text} if text else None


@dataclass
class Chat:
    """A model behind an address that speaks the usual chat completions: it gets system and user and is asked for a JSON object. An answer that isn't one is none."""

    address: str
    model: str
    key: str = ""
    max_tokens: int = 4096
    timeout: float = 60.0

    def ask(self, request: dict) -> dict | None:
        body = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": request.get("system", "")}, {"role": "user", "content": request.get("user", "")}]}
        said = json.loads(fetch(f"{self.address.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else None, self.timeout))
        content = ((said.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        content = re.sub(r"^\s*```(?:json)?|```\s*$", "", content)
        try:
            out = json.loads(content)
        except ValueError:
            return None
        return out if isinstance(out, dict) else None


_BUILT: dict[str, Connector] = {}


def answers(questions: DataFrame, key: str, build: Callable[[], Connector], name: str, store: str | None = None, lanes: int = 4) -> DataFrame:
    """key, status (found, not-found, unknown), answer (JSON), error of each question: a row of its key and whatever the connector reads. ``build`` makes the connector,
    once in each worker, where it is kept under ``name``. ``lanes`` is how many ask at the same time. With a store, what it knows isn't asked, and what
    is settled is added to it; unknown answers are asked again next time."""
    spark = questions.sparkSession
    known = sinks.latest(spark, store) if store else None
    fields = [c for c in questions.columns if c != key]
    open_ = questions if known is None else questions.join(known.select(F.col("key").alias(key)), key, "left_anti")
    one = open_.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("request")).dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _BUILT:
            _BUILT[name] = build()
        for batch in batches:
            rows = []
            for k, request in zip(batch["key"], batch["request"]):
                try:
                    got = _BUILT[name].ask(json.loads(request))
                    rows.append((k, "not-found" if got is None else "found", None if got is None else json.dumps(got, sort_keys=True), None))
                except Exception as e:  # whatever a service does, the question stays open
                    rows.append((k, "unknown", None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    out = one.repartition(lanes).mapInPandas(run, ANSWER)
    if store is None:
        return out
    from assaykit.operators.scale import written

    new = written(out, "answers")
    sinks.upsert(spark, store, new, "key")
    old = spark.createDataFrame([], ANSWER) if known is None else known.join(questions.select(F.col(key).cast("string").alias("key")).distinct(), "key", "left_semi").select(*new.columns)
    return new.unionByName(old)
