"""WARC archives: writing, reading back and transaction assembly.

A capture is three records: a request, a response (or a revisit of an equal payload) and metadata; the first
and last name the second by WARC-Concurrent-To. Archives are written and read by Spark's own file sources, so
any file system works, in gzipped files of FILE_BYTES and one capture at most; they are parsed record by record.
Equal payloads meet by digest only (SHA-1, as the format has it): the digests and ids are aggregated before
anything is shuffled, and a hot payload is a skewed join that Spark splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenscube.llm.common import map_rows, scratch
from lenscube.llm.components import components

# Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, record_id string, concurrent_to array<string>, refers_to string, uri string, payload_bytes long, payload_digest string, page_id long, payload string"
#: Bytes of captures after which an archive file ends, before compression; bytes that a parsed batch holds.
FILE_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
_SEPARATOR = (CRLF * 2).encode()


def _name(kind: str, *parts) -> str:
    """A record's id, a UUID made from what tells its capture from others."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(' '.join([kind, *map(str, parts)]).encode()).hexdigest())}>"


def _record(kind: str, record_id: str, block: bytes, content: str, *headers: str) -> bytes:
    """A whole record but for the two line ends after it."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", *headers, f"Content-Type: {content}", f"Content-Length: {len(block)}", CRLF]
    return CRLF.join(lines).encode("utf-8", "replace") + block


def originals(pages: DataFrame) -> DataFrame:
    """(sha, top, again): of each payload the largest page_id with its url's key, and whether rows repeat.

    Only digests and keys are shuffled, aggregated before.
    """
    keys = pages.groupBy("sha", "page_id", "url_key").agg(F.count("*").alias("n"))
    return keys.groupBy("sha").agg(F.max(F.struct("page_id", "url_key")).alias("top"), (F.max("n") > 1).alias("again"))


def _captures(batches, least: int) -> Iterator[bytes]:
    """A request, a response or revisit, and metadata for each row, joined by two line ends."""
    number = TaskContext.get().partitionId() << 40
    for b in batches:
        for page, url, key, html, sha, top, top_key, again in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            number += 1
            body, digest = html.encode("utf-8", "replace"), base64.b32encode(bytes.fromhex(sha)).decode()
            revisit = page is not None and top != page and len(body) >= least
            of = (page, key, sha, number if again else "")  # a row that another may repeat has a number in its ids
            capture = _name("capture", *of)
            target = "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")
            head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(body)}{CRLF * 2}".encode()
            named, http = (target, f"WARC-Payload-Digest: sha1:{digest}"), "application/http;msgtype="
            if revisit:
                # where rows repeat, their payload's original has no id that can be told from here
                refers = () if again else (f"WARC-Refers-To: {_name('capture', top, top_key, sha, '')}",)
                response = _record("revisit", capture, head, f"{http}response", *named, f"WARC-Profile: {PROFILE}", *refers)
            else:
                response = _record("response", capture, head + body, f"{http}response", *named)
            of_capture = (target, f"WARC-Concurrent-To: {capture}")
            fields = f"page-id: {'' if page is None else page}{CRLF}refers-to-page-id: {top if revisit else ''}{CRLF}"
            if "\r" in url or "\n" in url:
                escaped = url.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")
                fields += f"page-url: {escaped}{CRLF}"
            request = _record("request", _name("request", *of), f"GET / HTTP/1.1{CRLF * 2}".encode(), f"{http}request", *of_capture)
            metadata = _record("metadata", _name("metadata", *of), fields.encode("utf-8", "replace"), "application/warc-fields", *of_capture)
            yield _SEPARATOR.join((request, response, metadata))


def _files(captures: Iterator[bytes], file_bytes: int) -> Iterator[list]:
    """The text of an archive file from captures, one after the other."""
    held, size = [], 0
    for capture in captures:
        held.append(capture)
        size += len(capture)
        if size >= file_bytes:
            yield [pa.array([_SEPARATOR.join(held)], pa.binary()).cast(pa.string())]
            held, size = [], 0
    if held:
        yield [pa.array([_SEPARATOR.join(held)], pa.binary()).cast(pa.string())]


def write(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a capture for each row of (page_id, url, html) to archive files under ``path``.

    A null html is an empty payload, a null url an empty one; line ends in a url are percent-encoded, and the
    metadata record has the url as it was. Payloads of ``least`` bytes or more that equal another page's are
    revisits of the one with the largest page_id; smaller ones, and rows without a page_id, are always
    responses. Rows that repeat, wholly or in page_id and html, are a capture each; those with the largest
    page_id are all responses. A page of any size is one capture, held whole by the task that writes it. Other
    columns, of whatever name, are not read. An empty table gives no captures.
    """
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.xxhash64(url).alias("url_key"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    joined = rows.join(originals(rows), "sha", "left").select("page_id", "url", "url_key", "html", "sha", F.col("top.page_id").alias("top_page"), F.col("top.url_key").alias("top_key"), "again")
    archive = map_rows(joined, lambda batches: _files(_captures(batches, least), file_bytes), "value string")
    archive.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _inflated(data, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a file, which is gzip (of any number of members) or plain, piece by piece."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    member = zlib.decompressobj(31)
    for i in range(0, len(view), step):
        rest = bytes(view[i : i + step])
        while rest:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(rest, 4 * step)
            rest = member.unused_data if member.eof else member.unconsumed_tail


def _headers(lines: list[bytes]) -> dict[str, list[str]]:
    """Header values by lower-case name; a name may have several, and a line that begins with white space goes on."""
    found: dict[str, list[str]] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            found[name][-1] = f"{found[name][-1]} {line.strip().decode('utf-8', 'replace')}".strip()
        elif b":" in line:
            key, value = line.split(b":", 1)
            name = key.strip().decode("utf-8", "replace").lower()
            found.setdefault(name, []).append(value.strip().decode("utf-8", "replace"))
    return found


def records(data) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of each record of an archive file; one record and a step of the file are held."""
    held, at, pieces = bytearray(), 0, _inflated(data)

    def until(found) -> bool:
        nonlocal held, at
        while not found():
            piece = next(pieces, None)
            if piece is None:
                return False
            del held[:at]
            held += piece
            at = 0
        return True

    while True:
        while until(lambda: len(held) > at) and held[at] in b"\r\n":  # records end by two line ends, at times by more
            at += 1
        if at == len(held):
            return
        if not until(lambda: held.find(b"\r\n\r\n", at) >= 0):
            raise ValueError("a record's headers don't end")
        size = held.index(b"\r\n\r\n", at) - at
        version, *lines = bytes(held[at : at + size]).split(b"\r\n")
        headers = _headers(lines)
        if not version.startswith(b"WARC/") or "content-length" not in headers:
            raise ValueError(f"no record: {version[:40]!r}")
        size, length = size + 4, int(headers["content-length"][0])
        if not until(lambda: len(held) - at >= size + length):  # noqa: B023
            raise ValueError("a record breaks off")
        block = bytes(held[at + size : at + size + length])
        at += size + length
        yield headers, block


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parsed(headers: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    """A row of RECORD. What a foreign record lacks is taken from its block: length and digest of the payload."""

    def one(name: str) -> str | None:
        return headers[name][0] if headers.get(name) else None

    kind, uri, refers = one("warc-type"), one("warc-target-uri"), one("warc-refers-to")
    size, digest, page, body = None, None, None, None
    if kind in ("response", "revisit"):
        http = block[:5] == b"HTTP/"
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        stated = _headers(head.split(b"\r\n")[1:]).get("content-length", [""])[0]
        size = int(stated) if stated.isdigit() else len(body) if kind == "response" else None
        digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
        if kind == "response":
            own = digest_of(body)
            given = one("warc-payload-digest") or ""
            if given.lower().startswith("sha1:") and own != digest:
                raise ValueError(f"payload of {one('warc-record-id')} differs from its digest")
            digest = digest or own
        body = body.decode("utf-8", "replace") if payloads and kind == "response" else None
    elif kind == "metadata":
        own = _headers(block.split(b"\r\n"))
        page, refers = own.get("page-id", [""])[0], own.get("refers-to-page-id", [""])[0] or refers
        page = int(page) if page.lstrip("-").isdigit() else None
        if "page-url" in own:
            ends = {"r": "\r", "n": "\n"}
            uri = re.sub(r"\\(.)", lambda m: ends.get(m[1], m[1]), own["page-url"][0])
    return kind, one("warc-record-id"), headers.get("warc-concurrent-to", []), refers, uri, size, digest, page, body


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``, gzipped or plain; payload is null without ``payloads``.

    A response's payload is checked against its SHA-1 digest, where it has one; a revisit's length and digest
    are its headers'. A response without a digest or length has its payload's. Header names are matched in any
    case; a record may have several concurrent-to headers. A record that breaks off or lacks a length raises.
    """

    def run(batches):
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for headers, block in records(data.as_buffer()):
                    out.append(_parsed(headers, block, payloads))
                    size += 500 + (len(block) if payloads else 0)
                    if size > BATCH_BYTES:
                        yield [list(c) for c in zip(*out, strict=True)]
                        out, size = [], 0
                if out:
                    yield [list(c) for c in zip(*out, strict=True)]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return map_rows(files, run, RECORD)


def assemble(found: DataFrame, several: bool = False) -> DataFrame:
    """One nested row per capture: its request, response (or revisit) and metadata records.

    Records join through WARC-Concurrent-To: those that name one record, and that record, are a capture. With
    ``several``, for archives whose records name more than one other, captures are the connected groups of all
    names; that takes a pass over the ids first. A part that is missing is null; of several records for one
    part the least stays. Records without an id or name are captures of their own together; other types
    (warcinfo, conversion) that name nothing have all three parts null and are left out.
    """
    part = F.when(F.col("record_type").isin("response", "revisit"), "response").otherwise(F.col("record_type"))
    nested = F.struct("record_type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "page_id", "payload")
    capture = F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id"))
    found = found.where(part.isin("request", "response", "metadata"))
    keyed = found.select(capture.alias("capture_id"), part.alias("part"), nested.alias("record"))
    if several:
        named = found.select(F.xxhash64("record_id").alias("u"), F.explode("concurrent_to").alias("name"))
        group = components(named.select("u", F.xxhash64("name").alias("v")))
        keyed = keyed.withColumn("node", F.xxhash64("record.record_id")).join(group, "node", "left")
        keyed = keyed.select(F.coalesce("component", "node").cast("string").alias("capture_id"), "part", "record")
    one = [F.min(F.when(F.col("part") == p, F.col("record"))).alias(p) for p in ("request", "response", "metadata")]
    return keyed.groupBy("capture_id").agg(*one)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """The captures of ``pages``, written to the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, least)
    return assemble(read(spark, path, payloads))


def report(captures: DataFrame) -> DataFrame:
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to").cast("long").alias("refers_to"),
    )
