"""Operator 7: WARC derivative builder.

From `response` records it derives, as the WARC/1.1 standard describes them, one
`metadata` record (links, title, source headers) and one `conversion` record (plain
text) each.  Both name the response in WARC-Refers-To, keep its target URI and date, and
carry block digests of their own; the metadata record keeps the source's WARC and HTTP
headers and its payload digest: the one that the source states, and the computed one
beside it.  Record ids are derived from the response's id, so a rerun gives the same
records.

A response is a row (record_id, target_uri, date, http_headers, body), e.g. from
`responses_of_pages` or `read_responses`, which adds warc_headers (lines) and payload (the
bytes of the HTTP body as they are stored); both are optional.  A null body counts as empty
and gives records with an empty text; null headers give none; a null URI or date leaves its
header out; a null record id gets one from the URI and payload.  Repeated rows give repeated
records.  Invalid UTF-8 in a text becomes U+FFFD.  Other columns are ignored.  Bodies are converted whole, row by row, without a
shuffle, in time linear in the page; what HTML's grammar doesn't know, as `<![foo[`, is a
comment up to the next `>`.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import markup
from quillon.llm.textbytes import as_texts

VERSION = "WARC/1.1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")
#: Elements whose text isn't shown, and those that break a line.
HIDDEN = frozenset("script style noscript template head svg iframe object canvas".split())
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "form": "action"}

RECORD = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("content_length", T.LongType()), T.StructField("block_digest", T.StringType()),
    T.StructField("source_digest", T.StringType()), T.StructField("block", T.StringType()), T.StructField("record", T.StringType()),
])
_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in RECORD])


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def convert(html: str) -> tuple[str, str, list[tuple[str, str]], str | None]:
    """(text, title, links as (source, raw URI), base URI) of a page; blank runs and empty lines are folded."""
    parts: list[str] = []
    title: list[str] = []
    links: list[tuple[str, str]] = []
    base, hidden, in_title = None, 0, False
    for kind, value, inside in markup.tokens(html):
        if kind == "text":
            if in_title:
                title.append(value)
            elif not hidden:
                parts.append(value)
            continue
        if kind == "open":
            if value in LINKS or value == "base":
                found = markup.attributes(inside)
                if value == "base":
                    base = found.get("href") or base
                elif found.get(LINKS[value]):
                    links.append((f"{value}@{LINKS[value]}", found[LINKS[value]].strip()))
            single = inside.endswith("/")
            if value == "title":
                in_title = not single
            elif value == "body":
                hidden = 0  # an unclosed head ends where the body begins
            elif value in HIDDEN:
                hidden += not single
            elif value in BREAKS:
                parts.append("\n")
        elif value == "title":
            in_title = False
        elif value in HIDDEN:
            hidden = max(0, hidden - 1)
        elif value in BREAKS:
            parts.append("\n")
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line), " ".join("".join(title).split()), links, base


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def absolute(base: str, uri: str) -> str:
    try:
        return urljoin(base, uri)
    except ValueError:
        return uri


def header(lines: str | None, name: str) -> str | None:
    """The value of the first header of that name."""
    found = re.search(rf"^{re.escape(name)}:[ \t]*(.*?)[ \t]*\r?$", lines or "", re.I | re.M)
    return found[1] if found else None


def derive_one(record_id: str | None, target_uri: str | None, date: str | None, http_headers: str | None, body: str | None, warc_headers: str | None = None, payload: bytes | None = None) -> list[tuple]:
    """The metadata and conversion records of one response, as rows of RECORD."""
    if payload is None:
        payload = (body or "").encode("utf-8", "surrogatepass")
    computed = digest(payload)
    stated = header(warc_headers, "WARC-Payload-Digest")
    source = record_id or f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{target_uri}\n{computed}')}>"
    text, title, links, base = convert(body or "")
    own_base = absolute(target_uri or "", base) if base else (target_uri or "")
    fields = [("title", title)] if title else []
    fields += [("sourcePayloadDigest", stated or computed), ("sourcePayloadLength", str(len(payload)))]
    fields += [("computedPayloadDigest", computed)] if stated else []
    fields += [("sourceBlockDigest", block)] if (block := header(warc_headers, "WARC-Block-Digest")) else []
    fields += [("sourceWarcHeader", _line(h)) for h in (warc_headers or "").splitlines() if h.strip()]
    fields += [("sourceHeader", _line(h)) for h in (http_headers or "").splitlines() if h.strip()]
    fields += [("outlink", f"{_line(absolute(own_base, uri))} {where}") for where, uri in links]
    blocks = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", text),
    )
    rows = []
    for kind, content_type, block in blocks:
        data = block.encode("utf-8", "surrogatepass")
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}\n{source}')}>"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        headers += [("WARC-Target-URI", _line(target_uri))] if target_uri else []
        headers += [("WARC-Date", _line(date))] if date else []
        headers += [("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        record = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"\r\n{block}\r\n\r\n"
        rows.append((source, kind, own, source, target_uri, date, content_type, len(data), digest(data), stated or computed, block, record))
    return rows


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response, with the columns of RECORD; `record` is the whole record as written to a file."""
    columns = ("record_id", "target_uri", "date", "http_headers", "body", "warc_headers", "payload")
    kinds = ("string",) * 6 + ("binary",)
    source = responses.select(*((F.col(c) if c in responses.columns else F.lit(None)).cast(kind).alias(c) for c, kind in zip(columns, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for one in zip(*map(as_texts, batch.columns[:-1]), batch.columns[-1].to_pylist()) for row in derive_one(*one)]
            out = [pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW)]
            yield pa.RecordBatch.from_arrays(out, schema=_ARROW)

    return source.mapInArrow(run, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Responses from a table of pages; the record id is a name-based UUID of the page's id and URL."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))), 256)
    part = lambda a, n: F.substring(h, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    size = F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    return pages.select(record_id.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), F.col(html_col).alias("body"))


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records as WARC files, one per partition; gzip makes one member of a file, `none` leaves them plain."""
    # a record ends with two line ends, of which the writer adds the second
    records.select(F.expr("left(record, length(record) - 2)").alias("record")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bool]]:
    """(headers, block, complete) of every record of a WARC file, plain or gzipped by record or whole.

    A block has as many bytes as Content-Length says.  It isn't complete if the file ends within it;
    a record without a length has its block up to the next record, or the file's end, and isn't complete.
    """
    file: io.BufferedIOBase = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)

    def line() -> bytes:
        try:
            return file.readline()
        except (EOFError, zlib.error, gzip.BadGzipFile):  # a torn file ends where its last whole member does
            return b""

    def read(n: int) -> bytes:
        parts = []
        while n > 0:
            try:
                part = file.read(min(n, 1 << 20))
            except (EOFError, zlib.error, gzip.BadGzipFile):
                break
            if not part:
                break
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    now = line()
    while now:
        if not re.match(rb"WARC/\d+\.\d+\s*$", now):
            now = line()
            continue
        headers: list[tuple[str, str]] = []
        while (now := line()).strip():
            text = now.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip(), value.strip()))
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if length.isascii() and length.isdigit():
            block = read(int(length))
            yield headers, block, len(block) == int(length)
            now = line()
            continue
        lines = []
        while (now := line()) and not re.match(rb"WARC/\d+\.\d+\s*$", now):
            lines.append(now)
        yield headers, re.sub(rb"\r?\n\r?\n\Z", b"", b"".join(lines)), False


def _unchunked(payload: bytes) -> bytes:
    """The body of a chunked transfer; as it is if it isn't one."""
    parts, at = [], 0
    while match := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(payload, at):
        size = int(match[1], 16)
        parts.append(payload[match.end() : match.end() + size])
        at = match.end() + size
        at += 2 if payload[at : at + 2] == b"\r\n" else 1 if payload[at : at + 1] == b"\n" else 0
        if not size:
            return b"".join(parts)
    return payload


def body_of(http_headers: str, payload: bytes) -> str:
    """The text of an HTTP body: transfer and content coding undone, decoded by its charset (UTF-8 without a known one)."""
    if (header(http_headers, "Transfer-Encoding") or "").lower() == "chunked":
        payload = _unchunked(payload)
    coding = (header(http_headers, "Content-Encoding") or "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # with a gzip or zlib header, or a raw stream; a torn one gives what is there
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                pass
    charset = re.search(r"charset=[\"']?([\w.:-]+)", header(http_headers, "Content-Type") or "", re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


RESPONSE = "record_id string, target_uri string, date string, http_headers string, body string, warc_headers string, payload binary, complete boolean"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response rows of WARC files, plain or gzipped; one task per file, which it reads whole (up to 2 GB).

    Records are told apart by Content-Length; `complete` is false where a record is shorter than it says or says nothing.
    A block that isn't HTTP has no HTTP headers and is the payload itself.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [pa.string()] * 6 + [pa.binary(), pa.bool_()]
    names = ["record_id", "target_uri", "date", "http_headers", "body", "warc_headers", "payload", "complete"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block, complete in records_of(content.as_py() or b""):
                    named = {k.lower(): v for k, v in reversed(headers)}
                    if named.get("warc-type") != "response":
                        continue
                    http, payload = "", block
                    if block.startswith(b"HTTP/"):
                        end = re.search(rb"\r?\n\r?\n", block)
                        http, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
                        http = http.decode("utf-8", "replace")
                    lines = "\r\n".join(f"{k}: {v}" for k, v in headers)
                    rows.append((named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), http, body_of(http, payload), lines, payload, complete))
                    size += 3 * len(block)
                    if size > 16_000_000:  # batches of bounded size
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, RESPONSE)
