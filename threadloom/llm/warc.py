"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A conversion record holds the visible text of a response's HTML; a metadata record holds the source's record and
HTTP headers. Both refer to the response by WARC-Refers-To, its target and its date, and name each other
by WARC-Concurrent-To. Chunked and compressed payloads are decoded first. Digests are kept from the source where it has them, and made where not.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORD = "record_id string, warc_type string, headers array<struct<name:string,value:string>>, block binary"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
DERIVED = (
    "source_id string, record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, payload_digest string, block_digest string, content_length long, headers string, block string"
)
_DERIVED_NAMES = [x.split()[0] for x in DERIVED.split(", ")]
# Elements without visible text, and elements that begin a line.
_LINE_TAGS = "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
# A head ends at its end tag, which may be left out, or before the first text or element that belongs to the body.
_IN_HEAD = (
    r"<!--.*?(?:-->|\Z)|<(?P<inner>script|style|noscript|template)\b[^>]*>.*?(?:</(?P=inner)\s*>|\Z)|<title\b[^>]*>.*?(?:</title\s*>|(?=<body\b)|\Z)"
    r"|</?(?:base|basefont|bgsound|link|meta|noframes|noscript|script|style|template|title)\b[^>]*>?|<[!?][^>]*>?|\s+"
)
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<head(?=[\s/>])[^>]*>(?:" + _IN_HEAD + r")*+(?:</head\s*>)?"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)",
    re.S | re.I,
)
_LINE = re.compile(r"</?(?:" + _LINE_TAGS + r")\b[^>]*>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^>]*>?")
_GAP = re.compile(rb"\r?\n\r?\n")


def digest(data: bytes) -> str:
    """A labelled digest in the customary form."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    """An identifier that is the same whenever the same source is derived again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def plain_text(source: str) -> str:
    """Visible text, a line per block, white space inside a line as one space."""
    text = html.unescape(_TAG.sub("", _LINE.sub("\n", _HIDDEN.sub("\n", re.sub(r"\s+", " ", source)))))
    return "\n".join(line for raw in text.split("\n") if (line := " ".join(raw.split())))


# -- record syntax ------------------------------------------------------------------------------------------------


def fields(text: str) -> list[tuple[str, str]]:
    """Named fields, continued lines joined."""
    out: list[tuple[str, str]] = []
    for line in re.split(r"\r?\n", text):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def field(named: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in named if n.lower() == name.lower()), None)


def serialise(headers: list[tuple[str, str]], block: bytes, compress: bool = False) -> bytes:
    head = "".join(f"{n}: {v}{CRLF}" for n, v in headers if n.lower() != "content-length")
    data = f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; gzip members are opened. A record cut off at the end gives what there is of its block."""
    if data[:2] == b"\x1f\x8b":
        out = io.BytesIO()
        while data:
            one = zlib.decompressobj(31)
            try:
                out.write(one.decompress(data) + one.flush())
            except zlib.error:
                break
            data = one.unused_data
        data = out.getvalue()
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = _GAP.search(data, at)
        if not end:
            return
        named = fields(data[at : end.start()].decode("utf-8", "replace"))
        size = field(named, "Content-Length") or "0"
        stop = end.end() + (int(size) if size.isdigit() else 0)
        yield named, data[end.end() : stop]
        at = stop


#: What stands between the records of a file; the first record begins with the end of it.
_BETWEEN = "\r\n\r\nWARC/1."


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at a path, as RECORD, read as a stream: a task holds a record at a time, whatever the file's size.

    Spark's text source opens gzip members one after another and cuts the stream where a record begins; a block that holds such a place
    itself is put together again by its Content-Length. Uncompressed files are read in splits; there a block that holds the beginning of
    a record just at the border of a split is cut short. A record that is cut off at the end of a file gives what there
    is of its block; headers without a length have an empty block; an empty file gives no record.
    """
    lines = spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("value").cast("binary").alias("part"), F.input_file_name().alias("file"))

    def batch(found: list[tuple[list[tuple[str, str]], bytes]]) -> pa.RecordBatch:
        rows = [(field(n, "WARC-Record-ID"), field(n, "WARC-Type"), [{"name": k, "value": v} for k, v in n], block) for n, block in found]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), _HEADERS, pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["record_id", "warc_type", "headers", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = b"", None
        for some in batches:
            for part, file in zip(some.column(0), some.column(1).to_pylist(), strict=True):
                data = part.as_py() or b""
                if held and file == of:
                    held += _BETWEEN.encode() + data
                else:
                    if held:
                        yield from map(lambda r: batch([r]), parse(held))
                    held, of = data if data.startswith(b"WARC/") else b"WARC/1." + data, file
                if whole(held):
                    yield from map(lambda r: batch([r]), parse(held))
                    held = b""
        if held:
            yield from map(lambda r: batch([r]), parse(held))

    return lines.mapInArrow(work, RECORD)


def whole(data: bytes) -> bool:
    """Whether the one record that this begins with has all of its block."""
    end = _GAP.search(data)
    size = field(fields(data[: end.start()].decode("utf-8", "replace")), "Content-Length") or "0" if end else "0"
    return not end or not size.isdigit() or len(data) - end.end() >= int(size)


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records, as RECORD, of a table of pages, which has no capture dates: all get ``date``.

    A null page is an empty payload; a null url leaves the record without a target.
    """
    url, body = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    payload = F.encode(body, "utf-8")
    mark = F.md5(F.concat_ws("\n", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(mark, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    def header(n: str, v: Column) -> Column:
        return F.struct(F.lit(n).alias("name"), v.alias("value"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
    )
    headers = F.array(
        header("WARC-Type", F.lit("response")),
        header("WARC-Record-ID", name),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", url),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
    )
    return pages.select(
        name.alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"),
        F.concat(F.encode(http, "utf-8"), payload).alias("block"),
    )


# -- derivatives ----------------------------------------------------------------------------------------------------


def unchunked(data: bytes) -> bytes:
    """A body without its chunk sizes. What doesn't follow the syntax ends it; a body that doesn't begin with a size is taken as it is."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
        if data[at : at + 2] == b"\r\n":
            at += 2
    return b"".join(out) if out or _CHUNK.match(data) else data


_CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")


def inflated(data: bytes, bits: int) -> bytes:
    """All members of compressed data; what follows the last of them isn't data."""
    out: list[bytes] = []
    while data:
        one = zlib.decompressobj(bits)
        try:
            out.append(one.decompress(data) + one.flush())
        except zlib.error:
            if not out:
                raise
            break
        if bits < 0 and not (out[0] or one.eof):  # without a head anything may pass for a beginning
            raise zlib.error
        data = one.unused_data if bits > 0 else b""
    return b"".join(out)


def not_decoded(http: list[tuple[str, str]]) -> str | None:
    """The content codings of a payload that ``decoded`` can't undo."""
    named = (c.strip() for c in (field(http, "Content-Encoding") or "").lower().split(","))
    return ", ".join(c for c in named if c not in ("", "identity", "gzip", "x-gzip", "deflate")) or None


def charset_of(kind: str, payload: bytes) -> str:
    """By the content type, else by a meta element in the first 1024 bytes of a payload of HTML or of no type, else UTF-8."""
    if named := re.search(r"charset=[\"']?([\w.:-]+)", kind):
        return named[1]
    if not kind or "html" in kind.lower():
        meta = _META.search(payload[:1024])
        if meta and not meta[1].lower().startswith(b"utf-16"):  # such a document couldn't say so in single bytes
            return meta[1].decode()
    return "utf-8"


_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decoded(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The payload without transfer and content coding (chunked; gzip of any number of members, deflate). Bodies that are cut off give
    what can be read of them, those that aren't coded as their headers say, and other codings, are taken as they are."""
    if "chunked" in (field(http, "Transfer-Encoding") or "").lower():
        payload = unchunked(payload)
    for coding in reversed((field(http, "Content-Encoding") or "").lower().split(",")):
        coding = coding.strip()
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15) if coding == "deflate" else (47,):  # gzip or zlib by their heads; bare deflate
                try:
                    payload = inflated(payload, bits)
                    break
                except zlib.error:
                    continue
    return payload


def derive_one(headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """Metadata and conversion record of one response, as rows of DERIVED. The payload digest is of the stored form, codings included."""
    source = field(headers, "WARC-Record-ID") or f"<urn:sha1:{hashlib.sha1(block).hexdigest()}>"
    target, date = field(headers, "WARC-Target-URI"), field(headers, "WARC-Date")
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, payload = (b"", block) if not block.startswith(b"HTTP/") else (block, b"")
    status, _, rest = head.decode("utf-8", "replace").partition(CRLF)
    http = fields(rest)
    kind = field(http, "Content-Type") or ""
    stored, payload = payload, decoded(payload, http)
    try:
        text = payload.decode(charset_of(kind, payload), "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    is_html = "html" in kind.lower() or not kind and "<" in text
    unread = not_decoded(http)
    lines = "" if unread else plain_text(text) if is_html else text if kind.startswith("text/") or not kind else ""
    payload_digest = field(headers, "WARC-Payload-Digest") or digest(stored)
    ids = {k: derived_id(source, k) for k in ("metadata", "conversion")}
    about = [("source-" + n.lower(), v) for n, v in headers] + ([("http-status", status)] if status else []) + [("http-" + n.lower(), v) for n, v in http]
    about += [("content-coding-not-decoded", unread)] if unread else []
    bodies = {"metadata": ("application/warc-fields", "".join(f"{n}: {v}{CRLF}" for n, v in about)), "conversion": ("text/plain; charset=utf-8", lines)}
    out = []
    for name, other in (("metadata", "conversion"), ("conversion", "metadata")):
        content_type, body = bodies[name]
        data = body.encode("utf-8", "replace")
        named = [
            ("WARC-Type", name),
            ("WARC-Record-ID", ids[name]),
            ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", ids[other]),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("WARC-Source-Payload-Digest", payload_digest),
            ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(data))),
        ]
        text_headers = "".join(f"{n}: {v}{CRLF}" for n, v in named if v is not None)
        out.append((source, ids[name], name, source, ids[other], target, date, content_type, payload_digest, digest(data), len(data), text_headers, body))
    return out


def derive(records: DataFrame) -> DataFrame:
    """DERIVED: two rows, metadata and conversion, for each response among ``records`` (as RECORD).

    Other record types give none. A null block counts as empty, null headers as none; a response without an id is
    named by the digest of its block; a payload that is neither HTML nor text, or in a coding that isn't known (``br``), converts to
    an empty text, and the metadata say so of the latter; repeated
    responses give repeated rows; an empty table gives an empty result; further columns are not read.
    """
    types = [pa.string()] * 10 + [pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out: list[tuple] = []
                for headers, block in zip(part.column(0), part.column(1), strict=True):
                    out += derive_one([(h["name"] or "", h["value"] or "") for h in headers.as_py() or []], block.as_py() or b"")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], _DERIVED_NAMES)

    return records.filter("warc_type = 'response'").select("headers", "block").mapInArrow(work, DERIVED)


def serialised(derived: DataFrame, compress: bool = True) -> DataFrame:
    """(source_id, record_id, record): each derived record in file syntax, a gzip member of its own; members in any order make a file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                serialise(fields(h), (b or "").encode("utf-8", "replace"), compress)
                for h, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["source_id", "record_id", "record"])

    return derived.select("source_id", "record_id", "headers", "block").mapInArrow(work, "source_id string, record_id string, record binary")
