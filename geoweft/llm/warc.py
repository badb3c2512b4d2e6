"""Derivatives of web archives: linked metadata and plain-text conversion records.

``responses`` turns fetched pages into WARC response records; ``derive`` makes of
each response a ``metadata`` record (its headers, title and links as JSON) and a
``conversion`` record (its visible text). Both name the response in
WARC-Refers-To and keep its target, date and digests, so that a derivative can be
traced and checked without the response. ``write`` and ``read`` are the file
format; each record is a gzip member of its own, so files can be cut anywhere
between records.

Ids are a function of url, page_id and kind, or of the record that a derivative
refers to: a task that runs twice writes the same records. A null html is an empty
page, a null url an empty target; repeated rows give repeated records; further
columns are ignored; an empty table gives none.

Archives come as they are: header names in any case, repeated and folded headers
(all kept, in order), bytes that aren't UTF-8 (read as ISO-8859-1), unknown
charsets (UTF-8 with replacements), chunked and compressed payloads (decoded; what
can't be is left as it is). A response without a date or id has derivatives
without them. Text is converted of HTML and of plain text; of other kinds there
is a metadata record only. Files are inflated and read record by record, so a task
holds a file as it is stored and one record at a time; a file may be up to 2 GB, as
large as Spark reads one.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm.common import map_columns, streamed
from geoweft.llm.htmltree import blocks, parse, title, visible

#: The date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
MAGIC = b"\x1f\x8b"
#: The media types of HTML.
HTML = ("text/html", "application/xhtml+xml")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs

RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block binary, headers string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, url: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {page_id} {url}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(kind: str, rid: str, target: str, date: str, content_type: str, block: bytes, **more: str) -> dict:
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": rid,
        "WARC-Target-URI": clean(target),
        "WARC-Date": date,
        **{k.replace("_", "-"): v for k, v in more.items()},
        "WARC-Block-Digest": digest(block),
        "Content-Type": content_type,
        "Content-Length": str(len(block)),
    }
    return {"headers": {k: v for k, v in headers.items() if v}, "block": block}


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> dict:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(
        "response", record_id("response", url or "", page_id), url or "", date, "application/http; msgtype=response", head + payload, WARC_Payload_Digest=digest(payload)
    )


def header(headers: dict, name: str, default: str | None = None) -> str | None:
    """The first value of a WARC header, its name in any case."""
    if name not in headers:
        name = next((k for k in headers if k.lower() == name.lower()), name)
    v = headers.get(name, default)
    return v[0] if isinstance(v, list) else v


def text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("iso-8859-1")


def fields(lines: list[bytes]) -> list[list[str]]:
    """[name, value] of header lines; a line that begins with white space continues the one before."""
    out: list[list[str]] = []
    for line in lines:
        x = text_of(line)
        if x[:1] in (" ", "\t") and out:
            out[-1][1] += " " + x.strip()
        else:
            k, _, v = x.partition(":")
            out.append([k.strip(), v.strip()])
    return out


def http_parts(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, found, payload = block.partition(b"\n\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.replace(b"\r\n", b"\n").split(b"\n")
    return text_of(lines[0]), fields(lines[1:]), payload


def first(headers: list[list[str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def dechunked(data: bytes) -> bytes:
    """The body of chunks; what isn't chunked stays as it is, and a body that breaks off ends there."""
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        size = data[at : max(end, at)].split(b";")[0].strip()
        try:
            n = int(size, 16) if size[:1] not in (b"-", b"+", b"_") else -1
        except ValueError:
            n = -1
        if n < 0 or end < 0:
            return b"".join(out) if at else data
        if n == 0:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return b"".join(out)


def unpacked(data: bytes, coding: str) -> bytes:
    """Without its content coding; data that isn't coded so, or by an unknown one, stays as it is."""
    for name in reversed([x.strip().lower() for x in coding.split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                data = b"".join(iter(_Members(data).read1, b"")) if data[:2] == MAGIC else data
            elif name == "deflate":
                d = zlib.decompressobj(-15 if data[:1] and data[0] & 15 != 8 else 15)
                data = d.decompress(data)
            elif name == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
        except (zlib.error, OSError, ValueError):
            return data
        except Exception as e:  # zstandard's error has no public base but this
            if type(e).__name__ != "ZstdError":
                raise
            return data
    return data


def decoded(payload: bytes, content_type: str) -> str:
    """The payload as text, by the charset that its headers name."""
    for part in content_type.split(";")[1:]:
        k, _, v = part.strip().partition("=")
        if k.strip().lower() == "charset":
            try:
                name = codecs.lookup(v.strip("\"' ")).name
                return payload.decode(name, "replace").encode("utf-8", "replace").decode()
            except (LookupError, UnicodeError, ValueError):
                break
    return payload.decode("utf-8", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and conversion records of a response record; none for other kinds."""
    h = source["headers"]
    if (header(h, "WARC-Type") or "").lower() != "response":
        return []
    status, http, raw = http_parts(source["block"])
    body = dechunked(raw) if "chunked" in first(http, "transfer-encoding").lower() else raw
    payload = unpacked(body, first(http, "content-encoding"))
    content_type = first(http, "content-type")
    kind = content_type.split(";")[0].strip().lower()
    is_html = kind in HTML or (not kind and payload.lstrip()[:1] == b"<")
    is_text = is_html or kind == "text/plain" or not kind
    page = decoded(payload, content_type) if is_text else ""
    tree = parse(page if is_html else "")
    links = []
    for tag, attrs in zip(tree.tag, tree.attrs):
        for name in ("href", "src", "action"):
            if name in attrs:
                links.append({"path": f"{tag.upper()}@/{name}", "url": attrs[name]})
    own = header(h, "WARC-Payload-Digest") or digest(body)
    about = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": h,
            "Block-Digest": header(h, "WARC-Block-Digest") or digest(source["block"]),
            "Payload-Metadata": {
                "Actual-Content-Type": "application/http; msgtype=response",
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": http,
                    "Entity-Length": len(body),
                    "Entity-Digest": own,
                    "HTML-Metadata": {"Head": {"Title": title(tree)}, "Links": links},
                },
            },
        }
    }
    rid, target, date = header(h, "WARC-Record-ID") or "", header(h, "WARC-Target-URI") or "", header(h, "WARC-Date") or ""
    same = dict(WARC_Refers_To=rid, WARC_Refers_To_Date=date, WARC_Source_Payload_Digest=own)
    name = rid or f"{target} {date} {digest(source['block'])}"
    make = lambda kind, content_type, data: record(kind, f"<urn:uuid:{uuid.uuid5(SPACE, kind + ' ' + name)}>", target, date, content_type, data, **same)
    out = [make("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass"))]
    if is_text:
        text = blocks(tree, visible(tree)) if is_html else page
        out.append(make("conversion", "text/plain", text.encode("utf-8", "surrogatepass")))
    return out


def write(records: Iterable[dict], compress: bool = True) -> bytes:
    out = []
    for r in records:
        pairs = [(k, x) for k, v in r["headers"].items() for x in (v if isinstance(v, list) else [v])]
        head = "".join(f"{k}: {v}\r\n" for k, v in pairs)
        data = f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + r["block"] + b"\r\n\r\n"
        out.append(gzip.compress(data, 6, mtime=0) if compress else data)
    return b"".join(out)


class _Members(io.RawIOBase):
    """Gzip members one after the other, inflated as they are read. A broken member ends the stream."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inflate = memoryview(data), 0, None

    def readable(self) -> bool:
        return True

    def read1(self, size: int = 1 << 20) -> bytes:
        while True:
            if self.inflate is None:
                if self.data[self.at : self.at + 2] != MAGIC:
                    return b""
                self.inflate = zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.data[self.at : self.at + 65536]
                self.at += len(raw)
            try:
                out = self.inflate.decompress(raw, size)
            except zlib.error:
                self.at, self.inflate = len(self.data), None
                return b""
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = None
            elif not out and not raw:
                return b""
            if out:
                return out

    def readinto(self, buffer) -> int:
        out = self.read1(len(buffer))
        buffer[: len(out)] = out
        return len(out)


def _taken(f: io.BufferedIOBase, n: int) -> bytes:
    """``n`` bytes, or as many as there are, however large ``n`` claims to be."""
    out = []
    while n > 0 and (part := f.read(min(n, 1 << 20))):
        out.append(part)
        n -= len(part)
    return b"".join(out)


def read(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped. A record that breaks off at the end is left out."""
    f = io.BufferedReader(_Members(data), 1 << 16) if data[:2] == MAGIC else io.BytesIO(data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines: list[bytes] = []
        while (line := f.readline()) and line.strip():
            lines.append(line.rstrip(b"\r\n"))
        headers: dict[str, str | list[str]] = {}
        names: dict[str, str] = {}
        for k, v in fields(lines):
            k = names.setdefault(k.lower(), k)
            headers[k] = v if k not in headers else [*(headers[k] if isinstance(headers[k], list) else [headers[k]]), v]
        length = header(headers, "Content-Length", "0")
        n = int(length) if length.isascii() and length.isdigit() else 0
        block = _taken(f, n)
        if len(block) == n:
            yield {"headers": headers, "block": block}


def _columns(records: list[dict]) -> dict[str, list]:
    get = lambda k: [header(r["headers"], k) for r in records]
    return {
        "record_type": get("WARC-Type"), "record_id": get("WARC-Record-ID"), "refers_to": get("WARC-Refers-To"), "target_uri": get("WARC-Target-URI"),
        "warc_date": get("WARC-Date"), "content_type": get("Content-Type"), "block": [r["block"] for r in records],
        "headers": [json.dumps(r["headers"], ensure_ascii=False) for r in records],
    }


def batched(records: Iterable[dict], rows: int, size: int) -> Iterator[list[dict]]:
    """Records in lists of at most ``rows``, a list ending where their blocks reach ``size`` bytes."""
    held, n = [], 0
    for r in records:
        held.append(r)
        n += len(r["block"])
        if len(held) >= rows or n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below a path, each file by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return streamed(files, lambda rows: (_columns(some) for (content,) in rows for some in batched(read(content), 256, 1 << 24)), RECORD)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html)."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"page_id": batch["page_id"], **_columns([response(*x) for x in zip(batch["page_id"], batch["url"], batch["html"])])}

    return map_columns(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, " + RECORD
    )


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of a table of records; page_id is carried along if there is one."""
    own = ["page_id"] if "page_id" in records.columns else []

    def run(batch: dict[str, list]) -> dict[str, list]:
        out, ids = [], []
        for k, (headers, block) in enumerate(zip(batch["headers"], batch["block"])):
            got = derive({"headers": json.loads(headers), "block": block})
            out += got
            ids += [batch["page_id"][k]] * len(got) if own else []
        return {**({"page_id": ids} if own else {}), **_columns(out)}

    return map_columns(records.select(*own, "headers", "block"), run, "page_id long, " * bool(own) + RECORD)


def files(records: DataFrame, rows_a_file: int = 20_000, bytes_a_file: int = 1 << 28) -> DataFrame:
    """(name, content): the records as gzipped WARC files, each of at most so many records and about so many bytes before compression."""

    def run(rows: Iterator[tuple]) -> Iterator[dict[str, list]]:
        for some in batched(({"headers": json.loads(h), "block": b} for h, b in rows), rows_a_file, bytes_a_file):
            data = write(some)
            yield {"name": [f"{hashlib.sha1(data).hexdigest()}.warc.gz"], "content": [data]}

    return streamed(records.select("headers", "block"), run, "name string, content binary")


def summary(records: DataFrame) -> DataFrame:
    """Records with their digests and sizes in place of their blocks."""
    own = lambda k: F.get_json_object("headers", f"$['{k}']")
    return records.select(
        *(["page_id"] if "page_id" in records.columns else []), "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
        own("WARC-Block-Digest").alias("block_digest"), own("WARC-Source-Payload-Digest").alias("source_digest"),
        F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )
