"""WARC derivatives: a metadata and a plain-text conversion record for each response.

A response record's HTTP message is parsed (transfer and content coding undone, the character set honoured), its markup
becomes text, and two records are written that refer to the response by ``WARC-Refers-To``. Their own identifiers are
version-5 UUIDs of the response's identifier, so a second run writes the same ones. The metadata record keeps the source's
named fields, HTTP headers and digests, with the page's title and outgoing links; the conversion record keeps the payload's
digest beside its own.

Null URLs and bodies count as empty; an empty body gives both records, the conversion with an empty block. Records that are
not responses give no derivative. Bytes that are no record, records cut short or without a length and damaged compressed
members each give a row with ``error`` set, and reading goes on at the next record that can be recognised, so nothing is lost
unseen. A page or record of any length is taken whole. Repeated rows each get their records, with the same identifiers; an
empty table gives none. Columns named in ``keep`` pass through; one that is named like a column of the result gives way to it.

A file is one row of Spark's ``binaryFile`` source, so it has at most 2 GB; what is compressed is undone record by record.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import FLUSH_BYTES, arrow_schema, kept_columns, map_rows, names_of, slices, utf8

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Elements whose content is no text of the page, and those that end a line.
SKIPPED = "script|style|noscript|template|svg|title"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
_SKIP = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BLOCKS})\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<(?:a|area|link)\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(rb"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


@dataclass
class Record:
    """A record's named fields, in order, and its block; ``error`` says what is wrong with it, or with bytes that are none."""

    fields: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""
    error: str = ""

    def get(self, name: str) -> str:
        return next((v for k, v in self.fields if k.lower() == name.lower()), "")

    def raw(self) -> bytes:
        if not self.fields:
            return self.block
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields)
        return f"{VERSION}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Named fields; a line that begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif b":" in line:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            out.append((k.strip(), v.strip()))
    return out


#: Bytes that are undone at once, and the most that a record's named fields may take.
CHUNK, MOST_HEAD = 1 << 18, 1 << 20
_GZIP = b"\x1f\x8b\x08"


def _undone(data: memoryview, problems: list[str]) -> Iterator[bytes | None]:
    """The bytes of a file, compressed members undone piece by piece. A damaged one is named in ``problems``, and null follows it."""
    if bytes(data[:3]) != _GZIP:
        yield from (bytes(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
        return
    at = 0
    while at < len(data):
        start, wrong = at, ""
        if bytes(data[at : at + 3]) != _GZIP:
            wrong, at = f"no compressed member at byte {at}", _next_member(data, at)
        else:
            member = zlib.decompressobj(31)
            try:
                while not member.eof and at < len(data):
                    piece = data[at : at + CHUNK]
                    at += len(piece)
                    yield member.decompress(piece)
                at -= len(member.unused_data)
                wrong = "" if member.eof else f"the compressed member at byte {start} ends early"
            except zlib.error as e:
                wrong, at = f"the compressed member at byte {start} is damaged: {e}", _next_member(data, start + 3)
        if wrong:
            problems.append(wrong)
            yield None


def _next_member(data: memoryview, at: int) -> int:
    """Where the next compressed member may begin."""
    while at < len(data):
        found = bytes(data[at : at + CHUNK + 2]).find(_GZIP)
        if found >= 0:
            return at + found
        at += CHUNK
    return len(data)


class _Reader:
    """Bytes that come in pieces. A null piece is a break, which no record crosses."""

    def __init__(self, pieces: Iterator[bytes | None]):
        self.pieces, self.held = pieces, bytearray()
        self.broken = self.ended = False

    def more(self) -> bool:
        """Whether another piece came before a break or the end."""
        if self.broken or self.ended:
            return False
        try:
            piece = next(self.pieces)
        except StopIteration:
            self.ended = True
            return False
        self.broken = piece is None
        self.held += piece or b""
        return not self.broken

    def taken(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as there are."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes, most: int) -> int:
        """Where ``mark`` stands; -1 if it is not in the next ``most`` bytes."""
        looked = 0
        while (at := self.held.find(mark, max(0, looked - len(mark)))) < 0 and len(self.held) < most:
            looked = len(self.held)
            if not self.more():
                return -1
        return at if at <= most else -1

    def lost(self, mark: bytes) -> bytes:
        """All up to the first byte of ``mark``, which stays with the rest, or up to a break."""
        out = bytearray()
        while (at := self.held.find(mark)) < 0:
            cut = max(0, len(self.held) - len(mark) + 1)
            out += self.held[:cut]
            del self.held[:cut]
            if not self.more():
                return bytes(out) + self.taken(len(self.held))
        return bytes(out) + self.taken(at)

    def blank(self) -> None:
        """Skip line ends."""
        while True:
            n = 0
            while n < len(self.held) and self.held[n] in b"\r\n":
                n += 1
            del self.held[:n]
            if self.held or not self.more():
                return


def records(data: bytes) -> Iterator[Record]:
    """The records of a file's bytes, compressed or not; what is no whole record is one with ``error``."""
    problems: list[str] = []
    reader = _Reader(_undone(memoryview(data), problems))
    while True:
        reader.blank()
        if not reader.held:
            yield from (Record(error=problems.pop(0)) for _ in range(len(problems)))
            if reader.ended:
                return
            reader.broken = False
            continue
        while len(reader.held) < 5 and reader.more():
            pass
        begun = reader.held.startswith(b"WARC/")
        end = reader.until(b"\r\n\r\n", MOST_HEAD) if begun else -1
        head = bytes(reader.held[: max(0, end)])
        if b"\nWARC/" in head:  # another record begins before the fields end
            end, head = -1, b""
        found = Record(fields(head.split(b"\r\n")[1:]))
        size = found.get("Content-Length")
        if size.isdigit():
            reader.taken(end + 4)
            found.block = reader.taken(int(size))
            if len(found.block) < int(size):
                found.error = f"cut short: {len(found.block)} of {size} bytes"
        else:
            # What lies before the next line that begins like a record is kept with the error.
            found.block = reader.lost(b"\nWARC/")
            found.error = "no record" if not begun else "a record without a length" if end >= 0 else "a record without an end of its fields"
        yield found


def response(url: str, body: bytes, content_type: str = "text/html; charset=utf-8", date: str = "1970-01-01T00:00:00Z") -> Record:
    """A response record for a fetched body; its identifier is a UUID of the URL and the body's digest."""
    url = "%20".join(url.split())
    message = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    name = uuid.uuid5(NAMESPACE, f"{url} {digest(body)}")
    return Record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", f"<urn:uuid:{name}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(body)),
            ("WARC-Block-Digest", digest(message)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(message))),
        ],
        message,
    )


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body with chunks joined and content coding undone as far as it can be."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    headers = fields(lines[1:])
    names = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in names.get("transfer-encoding", ""):
        out, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            try:
                n = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
            except ValueError:
                n = 0
            if not n:
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(out)
    coding = names.get("content-encoding", "")
    if "gzip" in coding or "deflate" in coding:
        body = _inflated(body)
    return lines[0].decode("latin-1"), headers, body


def _inflated(body: bytes) -> bytes:
    """What a compressed body holds, as far as it goes; a body that isn't compressed is itself."""
    for kind in (47, -15):  # with a header of either sort, or none
        undone = zlib.decompressobj(kind)
        out = []
        try:
            for at in range(0, len(body), CHUNK):
                out.append(undone.decompress(body[at : at + CHUNK]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return body


def decoded(body: bytes, content_type: str) -> str:
    found = _CHARSET.search(content_type.encode()) or _CHARSET.search(body[:2048])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(markup: str) -> str:
    """The text of a page: a line for each block element that has any, white space inside lines made single spaces."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _SKIP.sub(" ", markup))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def derivatives(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    status, headers, body = http(source.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    markup = decoded(body, kind)
    is_page = "html" in kind.lower() or not kind and "<" in markup[:512]
    text = plain_text(markup) if is_page else markup if kind.lower().startswith("text/") else ""
    title = _TITLE.search(markup) if is_page else None
    links = list(dict.fromkeys(html.unescape(next(filter(None, x), "")).strip() for x in _LINK.findall(markup))) if is_page else []
    ref, uri, date = source.get("WARC-Record-ID"), source.get("WARC-Target-URI"), source.get("WARC-Date")
    told = [("source-" + k, v) for k, v in source.fields] + [("http-status", status)] + [("http-" + k, v) for k, v in headers]
    told += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    told += [("outlink", x) for x in links if x]
    block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in told).encode()
    payload = source.get("WARC-Payload-Digest") or digest(body)

    def made(type_: str, content: str, data: bytes) -> Record:
        name = uuid.uuid5(NAMESPACE, f"{ref} {type_}")
        return Record(
            [
                ("WARC-Type", type_),
                ("WARC-Record-ID", f"<urn:uuid:{name}>"),
                ("WARC-Refers-To", ref),
                ("WARC-Refers-To-Target-URI", uri),
                ("WARC-Refers-To-Date", date),
                ("WARC-Target-URI", uri),
                ("WARC-Date", date),
                ("WARC-Source-Payload-Digest", payload),
                ("WARC-Source-Block-Digest", source.get("WARC-Block-Digest") or digest(source.block)),
                ("WARC-Block-Digest", digest(data)),
                ("Content-Type", content),
                ("Content-Length", str(len(data))),
            ],
            data,
        )

    return made("metadata", "application/warc-fields", block), made("conversion", "text/plain; charset=utf-8", text.encode())


RECORD_DDL = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, block string, record binary, error string"


def _row(r: Record, block: bool = True) -> tuple:
    size = r.get("Content-Length")
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
    digests = ("WARC-Block-Digest", "WARC-Source-Payload-Digest", "WARC-Source-Block-Digest")
    return (*(r.get(x) for x in names), int(size) if size.isdigit() else 0, *(r.get(x) for x in digests), r.block.decode("utf-8", "replace"), r.raw(), r.error or None)


def _mapped(df: DataFrame, content: str, keep: tuple[str, ...], make) -> DataFrame:
    keep = kept_columns(keep, names_of(RECORD_DDL))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    ddl = f"{kept}, {RECORD_DDL}" if kept else RECORD_DDL
    schema = arrow_schema(ddl)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__quire_content", FLUSH_BYTES // 4):
            row, rows, held = [], [], 0
            for i, data in enumerate(utf8(batch.column(len(keep)))):
                for r in make(data):
                    row.append(i)
                    rows.append(_row(r))
                    held += len(r.block)
                    if held >= FLUSH_BYTES:
                        yield made(batch, row, rows)
                        row, rows, held = [], [], 0
            if rows:
                yield made(batch, row, rows)

    def made(batch: pa.RecordBatch, row: list[int], rows: list[tuple]) -> pa.RecordBatch:
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[len(keep) :]))], schema=schema)

    return map_rows(df.select(*keep, F.col(content).cast("binary").alias("__quire_content")), ddl, out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files at ``path``, compressed or not, and a row with ``error`` for what is none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _mapped(files, "content", ("path",), records)


def derive(responses: DataFrame, content: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """The metadata and conversion records of the responses in ``content``, a column of WARC bytes (one record or more).

    Bytes that are no whole record give a row with ``error`` in place of derivatives.
    """

    def made(data: bytes) -> Iterator[Record]:
        for r in records(data):
            if r.error:
                yield r
            elif r.get("WARC-Type") == "response":
                yield from derivatives(r)

    return _mapped(responses, content, keep, made)


def page_responses(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", body: str = "html") -> DataFrame:
    """``keep`` and ``record``: each page as a response record."""
    keep = kept_columns(keep, ("record",))
    kept = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    ddl = f"{kept}record binary"
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__quire_body"):
            urls, bodies = batch.column(len(keep)).to_pylist(), utf8(batch.column(len(keep) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([response(u or "", b).raw() for u, b in zip(urls, bodies)], pa.binary())], schema=schema)

    return map_rows(pages.select(*keep, F.col(url).cast("string").alias("__quire_url"), F.col(body).cast("string").alias("__quire_body")), ddl, made)
