"""WARC archives: a writer, and a reader that salvages what damage leaves.

An archive is a gzip file with one member for each record (``WARC/1.1``, records ``response`` and ``revisit``). Of records
with equal payloads of at least 100 bytes the one with the smallest id is the response, the others are revisits
that refer to it. Spark's own text writer puts the members into the shared folder: each row is one member, and the
line separator is an empty member, so that the file is valid gzip, any file system works, and a task that is
run again replaces its file. The archives of one call hold about ``archive_bytes`` of payload each.

The reader takes archives as whole binary values, gzip, plain or both in turn. Where a member fails to inflate or its checksum is
wrong, where a version line, length or end of a record is wrong, or a payload doesn't match its digest, it looks for the
next member header or version line, whichever comes first, from which a record can be read, goes on there, and reports the bytes between as
a quarantined gap. What a broken member gave before it failed is read as well; its records carry the failure as their reason. Every byte of an archive is in a record, in an empty member, or in a gap.

A digest is held against the algorithm it names (md5 and the SHA family, hex or base32), a payload digest of an HTTP message against its
body; one of an unknown algorithm confirms nothing and condemns nothing. Sound records of other types (``warcinfo``, ``request``,
``metadata`` and the rest of WARC 1.1) are stepped over. A revisit that doesn't state its payload's length has a null one.

Odd input: a null html is an empty payload, always a response; a null url is written as an empty target; a null page_id is
written as ``null`` and read back as null, after all ids; repeated rows get a record each, and equal payloads under one id refer to that
id: of rows that share the smallest id all are responses. An empty table writes no record. Control characters of a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import lookup, scratch, written

LEAST_SHARED = 100
_NO_ID = (1 << 63) - 1
#: A gzip member of no bytes; also the separator of rows in an archive.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_END = b"\r\n\r\n"
# The record types of WARC 1.1.
_TYPES = frozenset((b"response", b"revisit", b"warcinfo", b"request", b"metadata", b"resource", b"conversion", b"continuation"))
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})(?:;[^\r\n]*)?\r\n")
FOUND = "kind string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, start long, end long, reason string"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _safe(url: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "replace"))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to set) has no block, but the payload's digest and length."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {_safe(url)}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _page(urn: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:x-page:(-?[0-9]+)>", urn or b"")
    return int(m[1]) if m else None


_SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


def agrees(stated: bytes, *contents: bytes) -> bool | None:
    """Whether a digest (``algorithm:value`` in hex or base32; a bare value of 64 hex digits is SHA-256) is that of one of the contents;
    null where its algorithm or form isn't known, so nothing can be said."""
    name, sep, value = stated.decode("ascii", "replace").rpartition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = _SIZES.get(name if sep else "sha256")
    if size is None:
        return None
    try:
        want = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        want = b""
    if len(want) != size:
        return False if sep else None
    return any(hashlib.new(name or "sha256", x).digest() == want for x in contents)


def _unchunked(body: bytes) -> bytes | None:
    """The content of an HTTP body in chunks; null if it isn't one."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        if body[m.end() + size : m.end() + size + 2] != b"\r\n":
            return None
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return None


def payloads(block: bytes, content_type: bytes) -> list[bytes]:
    """What may be meant by a block's payload, the likeliest first: of an HTTP message its body, as sent or with its chunks joined, else the block."""
    head, sep, body = block.partition(_END)
    if not content_type.lower().startswith(b"application/http") or not sep:
        return [block]
    joined = _unchunked(body) if re.search(rb"(?mi)^transfer-encoding:.*chunked", head) else None
    return [body, *([] if joined is None else [joined]), block]


def parse_record(data: bytes, at: int) -> tuple[dict | None, int] | str:
    """The record that begins at ``at`` (null: a sound one of another type than response or revisit) and its end, or what is wrong there."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    cut = data.find(_END, m.end())
    if cut < 0:
        return "header has no end"
    fields, name = {}, b""
    for line in data[m.end() : cut].split(b"\r\n"):
        if line[:1] in b" \t" and name:
            fields[name] += b" " + line.strip()
            continue
        name, sep, value = line.partition(b":")
        if not sep:
            return "bad header line"
        name = name.strip().lower()
        fields[name] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return "bad content length"
    start, end = cut + 4, cut + 4 + int(length)
    if data[end : end + 4] != _END:
        return "record has no end"
    kind, stated = fields.get(b"warc-type"), fields.get(b"warc-payload-digest", b"")
    if kind not in _TYPES:
        return "unknown record type"
    block = data[start:end]
    confirmed = agrees(fields[b"warc-block-digest"], block) if b"warc-block-digest" in fields else None
    if confirmed is False:
        return "block digest differs"
    if kind == b"response":
        may_be = payloads(block, fields.get(b"content-type", b""))
        payload = may_be[0]
        if stated and not confirmed:
            confirmed = agrees(stated, *may_be)
            if confirmed is False:
                return "payload digest differs"
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    elif kind == b"revisit":
        length = fields.get(b"x-payload-length")
        if length is not None and not length.isdigit():
            return "bad payload length"
        n, digest = None if length is None else int(length), stated.removeprefix(b"sha256:").decode("ascii", "replace")
    else:
        return None, end + 4
    row = {"kind": "record", "page_id": _page(fields.get(b"warc-record-id")), "record_type": kind.decode(), "refers_to": _page(fields.get(b"warc-refers-to")) if kind == b"revisit" else None, "payload_bytes": n, "payload_digest": digest, "url": fields.get(b"warc-target-uri", b"").decode("ascii", "replace"), "reason": None, "confirmed": bool(confirmed)}
    return row, end + 4


@dataclass
class Inflated:
    """What a gzip member gave: its content, where in the archive it ends, and what is wrong with it (null: nothing). A cut-off one ends with
    the archive."""

    content: bytes
    end: int
    why: str | None = None
    cut_off: bool = False


def inflate(data: bytes, at: int, step: int = 1 << 15) -> Inflated:
    """The content of the gzip member at ``at``, or of a broken one as far as it inflates. What is fed goes up in steps, as
    what is left over after a member's end is copied."""
    d, out, start = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not d.eof:
        if at >= len(data):
            return Inflated(b"".join(out), at, "member is cut off", True)
        try:
            out.append(d.decompress(view[at : at + step]))
        except zlib.error as e:
            if step > 1:
                # a step that fails gives nothing, so its bytes are fed again one by one
                d = zlib.decompressobj(31)
                out, step = [d.decompress(view[start:at])], 1
                continue
            return Inflated(b"".join(out), at, f"member: {str(e)[:60]}")
        at = min(at + step, len(data))
    return Inflated(b"".join(out), at - len(d.unused_data))


def _gap(start: int, end: int, reason: str) -> dict:
    return {"kind": "gap", "start": start, "end": end, "reason": reason}


def _parts(content: bytes) -> Iterator[dict | str]:
    """The records of a member's content, and what is wrong between them: records before damage stand, and so do those after it."""
    at = 0
    while at < len(content):
        one = parse_record(content, at)
        if isinstance(one, str):
            yield one
            more = _VERSION.search(content, at + 1)
            at = more.start() if more else len(content)
        else:
            if one[0] is not None:
                yield one[0]
            at = one[1]


def _rest(got: Inflated, at: int) -> list[dict]:
    """The records of a broken member, with what is wrong with it as their reason. But for a member that is only cut off, one that no payload
    digest confirms stands only where a confirmed one follows."""
    rows = [one for one in _parts(got.content) if not isinstance(one, str)]
    if not got.cut_off:
        rows = rows[: max((i + 1 for i, row in enumerate(rows) if row["confirmed"]), default=0)]
    return [row | {"start": at, "end": got.end, "reason": got.why} for row in rows]


class _Starts:
    """Where the next gzip magic or version line is; neither is searched again before its last find is passed."""

    def __init__(self, data: bytes):
        self.data, self.magic, self.version = data, -1, -1

    def after(self, at: int, versions_from: int) -> int:
        """The first magic after ``at`` or version line after that and from ``versions_from`` on; the archive's end if there is neither."""
        if self.magic <= at:
            found = self.data.find(_MAGIC, at + 1)
            self.magic = found if found >= 0 else len(self.data)
        if self.version < (least := max(at + 1, versions_from)):
            m = _VERSION.search(self.data, least)
            self.version = m.start() if m else len(self.data)
        return min(self.magic, self.version)


def salvage(data: bytes) -> Iterator[dict]:
    """The records of one archive and its gaps, as rows of FOUND, in order. For a record in a gzip member start and end are the member's."""
    at, bad, why, n, inside = 0, None, "", len(data), 0
    starts = _Starts(data)
    while at < n:
        rows: list[dict] | None = None
        kept: list[dict] = []
        if data.startswith(_MAGIC, at):
            got = inflate(data, at)
            if got.why is None:
                end = got.end
                rows = [_gap(at, end, one) if isinstance(one, str) else one | {"start": at, "end": end} for one in _parts(got.content)]
            else:
                failed, kept = got.why, _rest(got, at)
                # stored bytes of a member that gave records aren't read again as plain ones
                inside = got.end if kept else inside
        else:
            one = parse_record(data, at)
            if isinstance(one, str):
                failed = one
            else:
                rows, end = [one[0] | {"start": at, "end": one[1]}] if one[0] is not None else [], one[1]
        if bad is not None and (rows is not None or kept):
            yield _gap(bad, at, why)
            bad = None
        if rows is not None:
            yield from rows
            at = end
            continue
        yield from kept
        if bad is None:
            bad, why = at, failed
        at = starts.after(at, inside)
    if bad is not None:
        yield _gap(bad, n, why)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for page_id, url, html, digest, n, refers in zip(*(batch.column(i).to_pylist() for i in range(6))):
            out.append(gzip_member(record(page_id, url or "", (html or "").encode("utf-8", "replace"), n, digest, refers)))
            held += len(out[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write(pages: DataFrame, path: str, archive_bytes: int = 32 << 20) -> int:
    """Writes a record for each row of ``pages`` (page_id, url, html) into archives under ``path``; returns how many rows there are."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select("page_id", "url", "html").withColumns({"payload_digest": F.sha2(payload, 256), "payload_bytes": F.octet_length(payload).cast("long"), "own_id": F.coalesce("page_id", F.lit(_NO_ID))})
    n_rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    shared = slim.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(F.min("own_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    dealt = lookup(slim, "payload_digest", shared, "first_id", "n", n_rows, F.col("page_id"))
    refers = F.when((F.col("payload_bytes") >= LEAST_SHARED) & (F.col("own_id") > F.col("first_id")), F.col("first_id"))
    out = dealt.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", "refers_to")
    # rows a file may hold, so that a file holds about archive_bytes at the mean size
    most = max(1, int(archive_bytes / max(1.0, total / max(1, n_rows) + 256)))
    members = out.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(path)
    return n_rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (FOUND, with the archive's path) of all archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", *(x.split()[0] for x in FOUND.split(", "))]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                for row in salvage(content.as_py()):
                    rows.append({k: row.get(k) for k in names} | {"path": name})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    long, text = pa.int64(), pa.string()
    kinds = {"string": text, "long": long}
    schema = pa.schema([("path", text), *((a, kinds[b]) for a, b in (x.split() for x in FOUND.split(", ")))])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {FOUND}")


def recovered(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The records of all archives under ``path``; the gaps between them are written as JSON lines under ``log``: path, start, end, reason."""
    found = written(read(spark, path), "warc-found")
    found.filter("kind = 'gap'").select("path", "start", "end", "reason").write.mode("overwrite").json(log)
    return found.filter("kind = 'record'")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every row of ``pages``, from archives
    written to the shared folder and read back. Gaps are logged beside them; a record too few or too many is an error."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    n_written = write(pages, path)
    records = recovered(spark, path, f"{path}-gaps")
    n_read = records.count()
    if n_read != n_written:
        raise RuntimeError(f"{n_written} records were written and {n_read} read back; what is wrong is in {path}-gaps")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
