"""Web-archive derivatives: response records become linked metadata and plain-text conversion records.

A record is a row: kind (WARC-Type), record_id, date, target_uri, refers_to, content_type, headers (all named fields, in
order) and block (bytes). ``responses`` makes response records from pages, ``read`` parses archive files (plain, or one
gzip member per record, as ``write`` makes them), and ``derive`` builds, for each response,

* a ``metadata`` record: ``application/warc-fields`` with the source's record id, digests, content type and length, every
  HTTP header of the source, the title and the links of the page;
* a ``conversion`` record: the page's text as ``text/plain``, UTF-8.

Both carry WARC-Refers-To (the response's id, unchanged), WARC-Refers-To-Target-URI, WARC-Refers-To-Date, the
response's WARC-Warcinfo-ID where it has one, their own block and payload digests, and the id of the other in
WARC-Concurrent-To. Ids are derived from the source id and the kind, so that a retried task writes the same records.

Markup is read in one pass, whose time is proportional to the page's length whatever stands in it: a tag is ``<``, a name
and all up to the next ``>`` without another ``<``; an element without an end that is silent (a script, a comment) lasts
until the page's end. Links are those of ``a`` elements outside of such.

Defined cases: a null html is an empty payload, a null url leaves WARC-Target-URI out (and the columns null); equal rows
are the same capture and get equal ids; records other than responses pass ``derive`` by; a response whose HTTP head is
broken has no HTTP headers and its whole block as payload; a response without a record id gets its ids from its URI, date
and block; a null block is empty; unknown character sets are read as UTF-8, wrong bytes become U+FFFD; what a damaged
archive holds instead of a record (a header without an end, a length that is no number, a block that is cut off, a broken
gzip member) becomes a record of kind ``damaged`` that says why, and reading goes on at the next record, or ends with the
broken member; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tables

DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, kind string, record_id string, date string, target_uri string, refers_to string, content_type string, headers array<struct<name: string, value: string>>, block binary"
KINDS = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("kind", "record_id", "date", "target_uri", "refers_to", "content_type")), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])
NAMESPACE = uuid.UUID("6f1c2a54-5a0e-4c5b-9a52-3c0d1de0a7c1")
#: Bytes of a record's block, at most; the columns of Arrow end at 2 GB.
LARGEST = 1 << 30
#: Encodings that Python has and the web has not.
_NO_CHARSETS = {"unicode_escape", "raw_unicode_escape", "punycode", "idna", "undefined"}
#: Elements whose content is no text, and elements that end a line.
_SILENT = set("script style noscript template head".split())
_LINE = set("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
_MARK = re.compile(r"<(?:!--|[!?][^<>]*>|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^a-zA-Z0-9<>][^<>]*)?)>)")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")
_HREF = re.compile(r"""(?i)[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in (*_SILENT, "title")}


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def content(page: str) -> tuple[str, str | None, list[str]]:
    """The page's text (no scripts, styles, head or comments, a line for each block element, entities decoded), its title,
    and its distinct links in order."""
    out, links, title, at, sought = [], {}, None, 0, False
    while m := _MARK.search(page, at):
        out.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif name in _SILENT and not m[1]:
            end = _END[name].search(page, at)
            if name == "head" and title is None:
                title = _title(page, at, end.start() if end else len(page))
            at = end.end() if end else len(page)
            out.append(" ")
        elif name in _LINE:
            out.append("\n")
        elif name == "title" and not m[1] and title is None and not sought:
            title, sought = _title(page, m.start(), len(page)), True  # looked for to the page's end, so once
        elif name == "a" and not m[1] and (href := _HREF.search(m[3])):
            links[html.unescape(next(x for x in href.groups() if x is not None)).strip()] = None
    out.append(page[at:])
    text = _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip()
    return text, title, [x for x in links if x]


def _title(page: str, first: int, last: int) -> str | None:
    """What stands in the first title element between two places."""
    at = first
    while (m := _MARK.search(page, at, last)) and not ((m[2] or "").lower() == "title" and not m[1]):
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at, last)
            at = last if end < 0 else end + 3
    end = _END["title"].search(page, m.end(), last) if m else None
    return _BLANKS.sub(" ", html.unescape(page[m.end() : end.start()])).strip() if end else None


def make(kind: str, record_id: str, date: str, uri: str | None, content_type: str, block: bytes, payload: bytes, more: list[tuple[str, str | None]] = (), page_id: int | None = None) -> dict:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), *more, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    fields = [{"name": k, "value": v} for k, v in fields if v is not None]
    return {"page_id": page_id, "kind": kind, "record_id": record_id, "date": date, "target_uri": uri, "refers_to": dict(more).get("WARC-Refers-To"), "content_type": content_type, "headers": fields, "block": block}


def name_of(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> dict:
    payload = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return make("response", name_of("response", page_id, url, hashlib.sha1(payload).hexdigest()), date, url, "application/http; msgtype=response", head + payload, payload, page_id=page_id)


def http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers and payload of a response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return [], block
    fields = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
    fields = [(k.strip(), v.strip()) for k, colon, v in fields if colon]
    known = {k.lower(): v.lower() for k, v in fields}
    if known.get("transfer-encoding") == "chunked":
        payload = _unchunked(payload)
    if known.get("content-encoding") == "gzip":
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError, zlib.error):
            pass  # stays as it is
    return fields, payload


def _unchunked(payload: bytes) -> bytes:
    """A chunked body as a whole; as it is where the chunks don't add up."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at, at + 32)
        size = re.fullmatch(rb"([0-9a-fA-F]{1,8})\s*(?:;.*)?", payload[at:end]) if end >= 0 else None
        if not size or end + 2 + (n := int(size[1], 16)) > len(payload):
            return payload
        if n == 0:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response row."""
    fields, payload = http(r["block"] or b"")
    own = {x["name"].lower(): x["value"] for x in r["headers"] or ()}
    charset = next((m[1] for k, v in fields if k.lower() == "content-type" and (m := re.search(r"(?i)charset=[\"']?([\w.:-]+)", v))), "utf-8")
    try:
        page = payload.decode("utf-8" if charset.lower().replace("-", "_") in _NO_CHARSETS else charset, "replace")
    except (LookupError, ValueError):
        page = payload.decode("utf-8", "replace")
    text, title, links = content(page)
    text = text.encode("utf-8", "replace")
    line = lambda x: re.sub(r"[\r\n]+", " ", x)
    about = [("source-record-id", r["record_id"]), ("source-payload-digest", own.get("warc-payload-digest")), ("source-block-digest", own.get("warc-block-digest")), ("source-content-type", r["content_type"]), ("source-content-length", own.get("content-length"))]
    about += [(f"http-{k.lower()}", v) for k, v in fields] + [("title", title)] + [("outlink", x) for x in links]
    meta = "".join(f"{k}: {line(v)}\r\n" for k, v in about if v is not None).encode("utf-8", "replace")
    source = r["record_id"] if r["record_id"] is not None else f"{r['target_uri']} {r['date']} {digest(r['block'] or b'')}"
    ids = {k: name_of(k, source) for k in ("metadata", "conversion")}
    linked = lambda other: [("WARC-Refers-To", r["record_id"]), ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["date"]), ("WARC-Concurrent-To", ids[other]), ("WARC-Warcinfo-ID", own.get("warc-warcinfo-id"))]
    return [
        make("metadata", ids["metadata"], r["date"], r["target_uri"], "application/warc-fields", meta, meta, linked("conversion"), r["page_id"]),
        make("conversion", ids["conversion"], r["date"], r["target_uri"], "text/plain; charset=utf-8", text, text, linked("metadata"), r["page_id"]),
    ]


def _batches(rows: Iterator[dict], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["block"])
        if size > limit or len(held) >= 1024:
            yield pa.RecordBatch.from_pylist(held, KINDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, KINDS)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(response(*x, date) for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(over, SCHEMA)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among ``records``."""
    small_batches(records.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(x for r in b.to_pylist() for x in derivatives(r))

    return records.where("kind = 'response'").mapInArrow(over, SCHEMA)


def serialize(r: dict) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{x['name']}: {x['value']}\r\n" for x in r["headers"]).encode() + b"\r\n" + r["block"] + b"\r\n\r\n"


class Members(io.RawIOBase):
    """What the gzip members of a stream hold, in the pieces that they give, so that a broken one loses no earlier record."""

    def __init__(self, stream):
        self.stream, self.left, self.raw, self.member, self.ended = stream, b"", b"", None, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left and not self.ended:
            self.raw = self.raw or self.stream.read(1 << 16)
            if self.member is None:
                self.raw = self.raw.lstrip(b"\0")
            if not self.raw and self.member is not None:
                raise EOFError("a gzip member is cut off")
            if not self.raw:
                self.ended = not self.stream.peek(1)
                continue
            self.member = self.member or zlib.decompressobj(31)
            self.left = self.member.decompress(self.raw, 1 << 20)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse(stream) -> Iterator[dict]:
    """Records of an open archive, gzipped or not, one after another: no more than a record is held."""
    f = io.BufferedReader(stream, 1 << 20) if not hasattr(stream, "peek") else stream
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(Members(f), 1 << 20)
    try:
        yield from _records(f)
    except (OSError, EOFError, zlib.error) as e:
        yield _damaged(f"{type(e).__name__}: {e}")


def _damaged(why: str) -> dict:
    return dict.fromkeys(KINDS.names) | {"kind": "damaged", "headers": [{"name": "reason", "value": why}], "block": b""}


def _records(f) -> Iterator[dict]:
    line, why = f.readline(LARGEST), None
    while line:
        if not line.startswith(b"WARC/1."):
            if line.strip() and why is None:
                why = "no record where one should begin"
            line = f.readline(LARGEST)
            continue
        if why is not None:
            yield _damaged(why)
            why = None
        fields: list[list[str]] = []
        while (line := f.readline(LARGEST)) not in (b"", b"\n", b"\r\n") and not line.startswith(b"WARC/1."):
            said = line.decode("utf-8", "replace").rstrip("\r\n")
            if said[:1] in " \t" and fields:
                fields[-1][1] += " " + said.strip()  # goes on
            elif ":" in said:
                fields.append([x.strip() for x in said.split(":", 1)])
        if line not in (b"\n", b"\r\n"):
            yield _damaged("a header without an end")
            continue
        own = {k.lower(): v for k, v in fields}
        size = own.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size) or int(size) > LARGEST:
            yield _damaged(f"no length of a block: {size[:100]}")
            line, why = f.readline(LARGEST), None
            while line and not line.startswith(b"WARC/1."):
                line = f.readline(LARGEST)
            continue
        block = f.read(int(size))
        if len(block) < int(size):
            yield _damaged(f"{len(block)} of {size} bytes of a block")
            return
        yield {
            "page_id": None, "kind": own.get("warc-type"), "record_id": own.get("warc-record-id"), "date": own.get("warc-date"), "target_uri": own.get("warc-target-uri"), "refers_to": own.get("warc-refers-to"),
            "content_type": own.get("content-type"), "headers": [{"name": k, "value": v} for k, v in fields], "block": block,
        }
        line = f.readline(LARGEST)
    if why is not None:
        yield _damaged(why)


def write(records: DataFrame, out: str, level: int = 6) -> DataFrame:
    """Write records as ``part-*.warc.gz`` under ``out``, a gzip member each; (file, n_records) of the files written."""
    small_batches(records.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, stream, n, name = TaskContext.get(), None, 0, None
        fs, folder = pafs.FileSystem.from_uri(out) if ":/" in out else (pafs.LocalFileSystem(), out)
        for t in tables(batches, "block"):
            for r in t.to_pylist():
                if stream is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                    stream = fs.open_output_stream(f"{folder}/{name}", compression=None)
                stream.write(gzip.compress(serialize(r), level, mtime=0))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}])

    return records.mapInArrow(over, "file string, n_records long")


def read(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Records of archive files under ``path``, each file streamed by its task. Without ``stream`` the files come through
    Spark's own reader, for stores that only Spark can open; a file is a row then, and 2 GB at most."""
    small_batches(spark)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column(0).to_pylist():
                if stream:
                    fs, name = pafs.FileSystem.from_uri(one)
                    with fs.open_input_stream(name, compression=None) as f:
                        yield from _batches(parse(f))
                else:
                    yield from _batches(parse(io.BytesIO(one)))

    files = spark.read.format("binaryFile").load(path)
    return files.select("path" if stream else "content").mapInArrow(over, SCHEMA)


def run(pages: DataFrame) -> DataFrame:
    """(page_id, kind, record_id, refers_to, target_uri, date, content_type, n_bytes, block_digest, payload_digest,
    source_digest, n_outlinks): the derivatives of ``pages``, without their blocks."""
    made = derive(responses(pages))
    field = lambda name: F.filter("headers", lambda x: x["name"] == name)[0]["value"]
    said = F.decode("block", "utf-8")
    return made.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("n_bytes"), field("WARC-Block-Digest").alias("block_digest"), field("WARC-Payload-Digest").alias("payload_digest"),
        F.when(F.col("kind") == "metadata", F.regexp_extract(said, "source-payload-digest: (\\S+)", 1)).alias("source_digest"), F.when(F.col("kind") == "metadata", F.regexp_count(said, F.lit("(?m)^outlink: "))).alias("n_outlinks"),
    )
