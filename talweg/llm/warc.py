"""Operator 6, WARC archives under a two-level capture index.

Tasks write their rows as gzip members, one record each, into archive files of the shared folder, through the file
system that its address names. Records of equal payloads are one response (largest page_id) and revisits of it. The
capture index is sorted by the URL with its host reversed: lines go into compressed blocks of `block` lines, and a sparse
directory keeps the first and last key, file, offset and length of each block. A look-up of URLs runs in tasks: each key goes to the
index files whose range holds it, the task of such a file bisects its part of the directory for the blocks, and each
block for the lines, and the captures found are dealt by archive range, each range being read once.

A file is named by the attempt that wrote it and becomes known only by the rows that this attempt commits, so lost
executors leave at most files that no index names.

Defined results: a null html has an empty payload; a null url has the key ""; a null page_id is below all others and never
a response while others share its payload; repeated rows of the largest page_id are all responses (of one record id);
a URL that is looked up twice is found once; without rows there is an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, pieces, work_dir, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, file string, offset long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def plain_key(url: str | None) -> str:
    """The URL as a sort key: host labels in reverse, then port, path and query; scheme and fragment go."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + path


def url_key(url: str | None) -> str:
    """The sort key as index lines hold it: tabs and newlines are escaped before anything is sorted or looked up."""
    return plain_key(url).replace("\t", "%09").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, place: str = "") -> bytes:
    """The record of a page; `place`, where it stands, tells revisits of a repeated page_id apart."""
    head = HTTP % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}{'' if refers_to is None else place}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def members(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def packed(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclasses.dataclass(frozen=True)
class Archive:
    """An archive folder, the sparse directory of its index (first, last, file, offset, length), the range of keys of each
    index file (first, last, file; as many as the session has partitions) and the bytes of all records."""

    path: str
    directory: DataFrame
    files: list[tuple[str, str, str]]
    size: int


def originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(sha, original) of the payloads that several rows share; counted with map-side combining."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sha = pages.where(F.octet_length(payload) >= min_bytes).select(F.unhex(F.sha1(payload)).alias("sha"), "page_id")
    return sha.groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("sha", "original")


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0, level: int = 1, block: int = 300, small: int = 100_000) -> Archive:
    """Writes a record per row and the index. `small`: up to so many shared payloads are broadcast, more are joined by a shuffle."""
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    shared = written(originals(pages, min_bytes), "warc-originals")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    rows = rows.join(F.broadcast(shared) if shared.count() <= small else shared, "sha", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, f"{uuid.uuid4().hex}.warc.gz", 0
        fs, folder = file_system(path)
        try:
            for b in pieces(batches, "payload"):
                made = []
                for page_id, url, data, sha, original in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "original")), strict=True):
                    refers_to = original if original is not None and page_id != original else None
                    raw = packed(record(page_id, url, data, sha, refers_to, f":{name}:{offset}"), level)
                    if out is None:
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(raw)
                    made.append((url_key(url), page_id, name, offset, len(raw)))
                    offset += len(raw)
                yield entries(made)
        finally:
            if out is not None:
                out.close()

    captures = written(in_tasks(rows.select("page_id", "url", "payload", "sha", "original"), records, ENTRY), "warc-captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, offset, held = f"{uuid.uuid4().hex}.cdx.gz", 0, []
        fs, folder = file_system(path)
        out = None

        def lines() -> Iterator[list[tuple]]:
            for b in batches:
                held.extend(zip(*(c.to_pylist() for c in b.columns), strict=True))
                while len(held) >= block:
                    yield held[:block]
                    del held[:block]
            if held:
                yield held

        for part in lines():
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            raw = packed("\n".join("\t".join(map(str, line)) for line in part).encode(), 6)
            out.write(raw)
            yield pa.RecordBatch.from_pydict({"first": [part[0][0]], "last": [part[-1][0]], "file": [name], "offset": [offset], "length": [len(raw)]})
            offset += len(raw)
        if out is not None:
            out.close()

    ranged = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = written(in_tasks(ranged, index, "first string, last string, file string, offset long, length long"), "warc-directory")
    files = [tuple(r) for r in directory.groupBy("file").agg(F.min("first"), F.max("last")).select("min(first)", "max(last)", "file").collect()]
    return Archive(path, directory, sorted(files), captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def block_entries(fs: pafs.FileSystem, folder: str, file: str, offset: int, length: int) -> list[tuple]:
    with fs.open_input_file(f"{folder}/{file}") as f:
        text = members(f.read_at(length, offset)).decode()
    rows = [x.split("\t") for x in text.split("\n")]
    return [(k, None if p == "None" else int(p), f, int(o), int(n)) for k, p, f, o, n in rows]


def find(archive: Archive, url: str) -> list[bytes]:
    """The records of one URL, in order of page_id, as a short list for a person to read."""
    asked = archive.directory.sparkSession.createDataFrame([(url,)], "url string")
    fs, folder = file_system(archive.path)
    found = []
    for r in lookup(archive, asked).orderBy("page_id", "file", "offset").toLocalIterator():
        with fs.open_input_file(f"{folder}/{r['file']}") as f:
            found.append(members(f.read_at(r["length"], r["offset"])))
    return found


def lookup(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """The index lines of all captures of the URLs: key, page_id, file, offset and length; each capture once."""
    path, files = archive.path, archive.files
    firsts, lasts = [f for f, _, _ in files], [x for _, x, _ in files]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = {url_key(u) for u in b.column("url").to_pylist()}
            # files are in order of first and hold ranges that meet at most at their ends, so lasts are in order too
            rows = [(files[i][2], k) for k in keys for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["index", "key"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        index, blocks, ends, held, at = None, [], [], [], -1
        for b in batches:
            found = []
            for name, key, last, offset, length in zip(*(b.column(c).to_pylist() for c in ("index", "key", "last", "offset", "length")), strict=True):
                if name != index:
                    index, blocks, ends, held, at = name, [], [], [], -1
                if last is not None:  # blocks of a file stand before the keys that it is asked for
                    blocks.append((key, offset, length))
                    ends.append(last)
                    continue
                for i in range(bisect_left(ends, key), bisect_right(blocks, key, key=lambda x: x[0])):
                    if i != at:
                        held, at = block_entries(fs, folder, name, *blocks[i][1:]), i
                    to = bisect_right(held, key, key=lambda x: x[0])
                    found += held[bisect_left(held, key, key=lambda x: x[0]) : to]
                if len(found) >= 10_000:
                    yield entries(found)
                    found = []
            yield entries(found)

    keys = in_tasks(urls.select(F.col(url).alias("url")), asked, "index string, key string").distinct()
    none = F.lit(None)
    both = archive.directory.select(F.col("file").alias("index"), F.col("first").alias("key"), "last", "offset", "length").unionByName(keys.select("index", "key", none.cast("string").alias("last"), none.cast("long").alias("offset"), none.cast("long").alias("length")))
    dealt = both.repartition("index").sortWithinPartitions("index", F.col("last").isNull(), "key", "offset")
    return in_tasks(dealt, lines, ENTRY)


def read(archive: Archive, found: DataFrame | None = None, stretch: int = 2_000_000, share: int = 64_000_000) -> DataFrame:
    """The captures `found` by a look-up, or all that the index names: page_id, record_type, refers_to, payload_bytes,
    payload_digest and body (null for revisits). `share`: bytes of archive for a task."""
    path = archive.path

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for b in batches:
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                yield entries(block_entries(fs, folder, file, offset, length))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(rows):
                to = at + 1
                while to < len(rows) and rows[to][0] == rows[at][0] and rows[to][1] == rows[to - 1][1] + rows[to - 1][2] and rows[to][1] - rows[at][1] < stretch:
                    to += 1
                with fs.open_input_file(f"{folder}/{rows[at][0]}") as f:
                    data = f.read_at(rows[to - 1][1] + rows[to - 1][2] - rows[at][1], rows[at][1])
                yield captures([members(data[o - rows[at][1] : o - rows[at][1] + n]) for _, o, n in rows[at:to]])
                at = to

    spark = archive.directory.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-archive.size // share))  # by bytes of archive, which the rows of the index don't show
    if found is None:
        found = in_tasks(archive.directory.select("file", "offset", "length").repartition(F.col("file"), F.col("offset")), listed, ENTRY)
    dealt = found.select("file", "offset", "length", F.floor(F.col("offset") / stretch).alias("part")).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return in_tasks(dealt.select("file", "offset", "length"), bodies, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, body binary")


def captures(raw: list[bytes]) -> pa.RecordBatch:
    rows = []
    for fields, http, body in map(parse, raw):
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda x: None if x is None or x.startswith("<urn:page:None") else int(x[len("<urn:page:") : -1].split(":")[0])
        response = fields["WARC-Type"] == "response"
        if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), int(http["Content-Length"]), digest, body if response else None))
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("body", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def query(pages: DataFrame) -> DataFrame:
    """Writes the archive and reads it back by looking up the URL of every page."""
    archive = write(pages.select("page_id", "url", "html"))
    return read(archive, lookup(archive, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB SQL, base32 written out by groups of 20 bits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
shared AS (SELECT sha, max(page_id) AS original FROM p GROUP BY sha HAVING count(*) > 1),
named AS (SELECT p.*, CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM p LEFT JOIN shared USING (sha))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
FROM named
"""
