"""WARC derivatives: response records become a metadata record (links, headers, digests) and a plain-text conversion record.

A record is a row: ``record_type, record_id, refers_to, target_uri, date, headers (map), block (binary)`` and its digests. A derivative names its
response in WARC-Refers-To, repeats the response's target, date and WARC-Payload-Digest, and has a digest of its own block. The metadata record's block is JSON
with the response's HTTP status and headers, its digests and the links of the page in order, each with the element and its text. The conversion record's
block is the visible text, a line per block element.

``serialize`` writes a record as WARC/1.1 bytes and ``parse`` reads a file of them back; ``write_files`` writes shards (each record its own
gzip member, as archives do) and ``read_files`` reads them through Spark.

Ids are urn:uuid of a hash of (target, date, payload digest, record type), so a repeated run gives the same ids.

Edge cases: a null page body is an empty one; a null url gives an empty target. A response without a header end has an empty body. Broken HTML is read as far
as it goes; bytes that aren't of the named charset become U+FFFD in the text; an unknown charset is read as UTF-8. Repeated pages give repeated records. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import materialize

DDL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, block_digest string, headers map<string,string>, block binary"
SCHEMA = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
CRAWL_DATE = "2024-01-01T00:00:00Z"
# What stands in a tag: quoted values may hold ">". A tag ends at the next "<" too, so that a broken one costs no search to the end of the page.
_IN = r"""(?>[^<>"']+|"[^"<]*"|'[^'<]*'|["'])*+"""
_HIDDEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b{_IN}>.*?(?:</\1\s*>|\Z)")
_INSIDE = re.compile(rf"(?is)<(?:!--.*?(?:-->|\Z)|(script|style|template)\b({_IN}>).*?(?:</\1\s*>|\Z))")
# The end tag of a head may lack; then the head ends where the body begins, or has no end that could be seen.
_HEAD, _HEAD_END = re.compile(rf"(?i)<head\b{_IN}>"), re.compile(r"(?i)</head\s*>|(?=<body\b)")
_BLOCKS = re.compile(rf"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|blockquote|pre|title)|br|hr)\b{_IN}>")
_TAG, _SPACE = re.compile(rf"<[/!?a-zA-Z]{_IN}>"), re.compile(r"[ \t\r\f\v\n]{2,}|[\t\r\f\v\n]")  # a single blank stays
_LINK = re.compile(rf"(?is)<(?:(a)\b({_IN})>([^<]*(?:<(?!/?a\b)[^<]*)*)|(link|img|script|iframe|area)\b({_IN})>)")
_ATTR = re.compile(r"""(?is)(?:^|\s)(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    if (head := _HEAD.search(page)) and (end := _HEAD_END.search(page, head.end())):
        page = page[: head.start()] + " " + page[end.end() :]
    text = _TAG.sub("", _BLOCKS.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (_SPACE.sub(" ", html.unescape(line)).strip() for line in text.split("\n") if line)
    return "\n".join(line for line in lines if line)


def links(page: str) -> list[dict[str, str]]:
    """Links in the order of the page; none from within comments, scripts, styles and templates."""
    out = []
    for m in _LINK.finditer(_INSIDE.sub(lambda m: f"<{m[1]}{m[2]}" if m[1] else "", page)):
        element, attributes = m[1] or m[4], m[2] if m[1] else m[5]
        for name, *values in _ATTR.findall(attributes):
            entry = {"path": f"{element.upper()}@/{name.lower()}", "url": html.unescape(next((v for v in values if v), ""))}
            if m[1]:
                entry["text"] = _SPACE.sub(" ", html.unescape(_TAG.sub("", m[3]))).strip()
            out.append(entry)
    return out


def _record(page_id, kind: str, target: str, date: str, payload_digest: str, block: bytes, content_type: str, refers_to: str | None) -> dict:
    rid, own = record_id(target, date, payload_digest, kind), digest(block)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target)]
    headers += [("WARC-Refers-To", refers_to)] if refers_to else []
    headers += [("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", own), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"page_id": page_id, "record_type": kind, "record_id": rid, "refers_to": refers_to, "target_uri": target, "date": date, "payload_digest": payload_digest, "block_digest": own, "headers": headers, "block": block}


def response(page_id: int | None, url: str | None, body: str | None, date: str = CRAWL_DATE) -> dict:
    data = (body or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    return _record(page_id, "response", url or "", date, digest(data), http + data, "application/http; msgtype=response", None)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order (repeated ones too) and body as sent."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return "", [], b""
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The body's text: chunks joined, content encoding undone as far as it can be read, characters as Content-Type names them (else UTF-8)."""
    named = {k.lower(): v for k, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        whole, rest = [], body
        while m := re.match(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n", rest):
            n = int(m[1], 16)
            if not n:
                break
            whole.append(rest[m.end() : m.end() + n])
            rest = rest[m.end() + n + 2 :]
        body = b"".join(whole) or body
    for coding in reversed(named.get("content-encoding", "").lower().replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):  # gzip or zlib by its header; bare deflate
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no such charset, or one that isn't of text
        return body.decode("utf-8", "replace")


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response record (a row as a dict)."""
    status, headers, body = split_http(r["block"] or b"")
    page = decoded(headers, body)
    about = {"status": status, "headers": headers, "payload_digest": r["payload_digest"], "block_digest": r["block_digest"], "links": links(page)}
    own = [r["page_id"]], (r["target_uri"], r["date"], r["payload_digest"])
    meta = _record(*own[0], "metadata", *own[1], json.dumps(about, ensure_ascii=False).encode("utf-8", "surrogatepass"), "application/json", r["record_id"])
    text = _record(*own[0], "conversion", *own[1], plain_text(page).encode("utf-8", "surrogatepass"), "text/plain; charset=utf-8", r["record_id"])
    return [meta, text]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in SCHEMA], schema=SCHEMA)


def _some(rows: Iterator[dict], size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Response records of crawled pages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _some(response(i, u.as_py(), h.as_py()) for b in batches for i, u, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True))

    return pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(body_col)).mapInArrow(task, DDL)


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among ``responses``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = ("page_id", "target_uri", "date", "payload_digest", "block_digest", "record_id", "block")

        def rows() -> Iterator[dict]:
            for b in batches:
                for i in range(0, b.num_rows, 100):  # blocks are whole pages
                    for values in zip(*(b.column(n).slice(i, 100).to_pylist() for n in needed), strict=True):
                        yield from derivatives(dict(zip(needed, values, strict=True)))

        yield from _some(rows())

    return responses.filter("record_type = 'response'").select(*SCHEMA.names).mapInArrow(task, DDL)


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            headers[k.strip()] = v.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]) or ("WARC-Block-Digest" in headers and digest(block) != headers["WARC-Block-Digest"]):
            raise ValueError(f"cut or changed record {headers.get('WARC-Record-ID')}")
        yield headers, block


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Writes records to ``path`` (a folder all executors share), a .warc.gz file a partition; returns the stored list of ``(file, n_records)``."""
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name, n = f"{TaskContext.get().partitionId():06d}.warc.gz", 0
        own = f"{base}/{name}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(own, compression=None) as out:
            while first is not None:
                for h, b in zip(first.column("headers"), first.column("block"), strict=True):
                    out.write(gzip.compress(serialize(h.as_py(), b.as_py()), 6, mtime=0))
                    n += 1
                first = next((b for b in batches if b.num_rows), None)
        store.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}], schema=schema)

    return materialize(records.select(*SCHEMA.names).mapInArrow(task, "file string, n_records long"), "warc-files")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """``(headers, block)`` of the records in the listed files."""
    schema = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.open(io.BufferedReader(raw)) as f:
                    for h, block in parse(f):
                        yield pa.RecordBatch.from_arrays([pa.array([list(h.items())], schema.field(0).type), pa.array([block], pa.binary())], schema=schema)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(task, "headers map<string,string>, block binary")
