"""WARC archives: a writer of one gzip member per record and a splittable reader.

The reader's tasks take byte ranges of the archives. A task scans its range for the gzip magic, decodes each candidate
far enough to see a WARC header, and takes it only if the whole member decodes (gzip's own checksum included), its
block is as long as its header says, and another member or the archive's end follows. A record belongs to the range in
which it starts; its end may lie in later ranges.

Writers name files by task and attempt and return a manifest, which is saved; readers read the manifest's archives
only, so files of lost or repeated attempts do no harm.

Defined results: a null html is an empty payload; payloads under DUPLICATE_LEAST bytes are always responses; of equal
payloads the rows with the largest page_id are responses (all of them, should that id repeat; all rows, if none has an
id); null ids come back null; a null url leaves the target header out; other columns, of
any name, are not looked at; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import save, shared_dir, table, text_or_empty

DUPLICATE_LEAST = 1000
SPLIT_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
MAGIC = b"\x1f\x8b\x08"
LEVEL = 3
CHUNK = 1 << 16
RECORD_PREFIX = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _record_id(page_id: int | None) -> str:
    return f"<{RECORD_PREFIX}{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    said = record_id[1 + len(RECORD_PREFIX) : -1]
    return None if said == "none" else int(said)


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with the page's response or revisit record; digest is the payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + c.flush()


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, payload string, digest, refers_to) as archives; returns the saved manifest."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        out, path, size, n, done = None, "", 0, 0, []

        def close():
            out.close()
            done.append((path, size, n))

        for b in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(path, compression=None), 0, 0
                data = member(page, url, payload.encode(), digest, refers)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        p, s, k = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(s, pa.int64()), pa.array(k, pa.int64())], names=["path", "bytes", "records"])

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", "digest", F.col("refers_to").cast("long"))
    return save(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Random reads of a file through one buffer."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.start, self.data = read_at, size, 0, b""

    def get(self, at: int, n: int = CHUNK) -> bytes:
        if not self.start <= at or at + min(n, self.size - at) > self.start + len(self.data):
            self.start, self.data = at, self.read_at(at, min(max(n, 4 * CHUNK), self.size - at)) if at < self.size else b""
        return self.data[at - self.start : at - self.start + n]


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at a place and where it ends, if it is a whole gzip member that begins as a WARC record."""
    d, parts, pos, known = zlib.decompressobj(31), [], at, False
    try:
        while not d.eof:
            data = window.get(pos)
            if not data:
                return None
            parts.append(d.decompress(data))
            pos += len(data)
            if not known and sum(map(len, parts)) >= 5:
                if not b"".join(parts).startswith(b"WARC/"):
                    return None
                known = True
    except zlib.error:
        return None
    return (b"".join(parts), pos - len(d.unused_data)) if known else None


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _parse(offset: int, data: bytes) -> Record | None:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return None
    block, http = rest[: int(length)], {}
    if headers.get("content-type", "").startswith("application/http"):
        said, _, block = block.partition(b"\r\n\r\n")
        http = _fields(said.decode("utf-8", "replace").split("\r\n")[1:])
    return Record(offset, headers, http, block)


def records(read_at: Callable[[int, int], bytes], size: int, start: int, end: int) -> Iterator[Record]:
    """The records that start in [start, end) of an archive of so many bytes."""
    window, pos, end = _Window(read_at, size), start, min(end, size)
    while pos < end:
        data = window.get(pos)
        found = data.find(MAGIC)
        if found < 0:
            pos += max(len(data) - len(MAGIC) + 1, 1)
            continue
        pos += found
        if pos >= end:
            return
        got = _decode(window, pos)
        record = got and _parse(pos, got[0])
        if record and (got[1] >= size or window.get(got[1], len(MAGIC)) == MAGIC):
            yield record
            pos = got[1]
        else:
            pos += 1


def stated_digest(said: str | None) -> tuple[str, str] | None:
    """Algorithm and bare lower-case hex of a digest in hex or base32; null if it is neither, or of an unknown algorithm."""
    name, _, value = (said or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        found = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return None
    return (name, found.hex()) if len(found) == size else None


def described(r: Record) -> tuple:
    """A record's row. Raises if its payload differs from its digest, unless the payload is stored in chunks."""
    kind, said = r.headers.get("warc-type"), stated_digest(r.headers.get("warc-payload-digest"))
    if kind == "revisit":
        length, digest = r.http.get("content-length", ""), said[1] if said and said[0] == "sha1" else None
        return r.headers.get("warc-record-id"), kind, r.headers.get("warc-target-uri"), digest, r.headers.get("warc-refers-to"), int(length) if length.isdigit() else None, None
    if said and "transfer-encoding" not in r.http and hashlib.new(said[0], r.payload).hexdigest() != said[1]:
        raise ValueError(f"payload of {r.headers.get('warc-record-id')} differs from its digest")
    return r.headers.get("warc-record-id"), kind, r.headers.get("warc-target-uri"), hashlib.sha1(r.payload).hexdigest(), r.headers.get("warc-refers-to"), len(r.payload), r.payload


def read(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """record_id, record_type, uri, digest, refers_to, payload_bytes, payload of the archives of a manifest (path, bytes).

    All kinds of records are read, from any writer: digest is the payload's SHA-1 in hex, of a revisit the stated one if it is
    a SHA-1; a revisit has no payload, and its length only if its HTTP head tells it; headers that a record lacks are null."""
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    fields = "record_id string, record_type string, uri string, digest string, refers_to string, payload_bytes long, payload binary"
    schema = pa.schema([(c, t) for c, t in zip([x.split()[0] for x in fields.split(", ")], [pa.string()] * 5 + [pa.int64(), pa.binary()], strict=True)])

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(path) as f:
                    held, weight = [], 0
                    for r in records(lambda at, n, f=f: f.read_at(n, at), size, start, start + split_bytes):
                        held.append(described(r))
                        weight += len(r.payload)
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return splits.repartition(min(n, 100_000), "path", "start").mapInArrow(run, fields)


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of every row of pages."""
    base = pages.select("page_id", "url", text_or_empty("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = base.filter(F.octet_length("payload") >= DUPLICATE_LEAST)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # saved, so that the join has exchanges of its own on both sides and Spark can split a hot digest's partition
    first = save(first, "warc-first")
    joined = base.join(first, "digest", "left")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    manifest = write(deduplicated(table(spark, sf_dir, "pages")), folder)
    found = read(manifest, folder)
    number = lambda c: F.regexp_extract(c, rf"^<{RECORD_PREFIX}(-?\d+)>$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {DUPLICATE_LEAST} AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {DUPLICATE_LEAST} AND page_id < first THEN first END AS refers_to FROM d
"""
