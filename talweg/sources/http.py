"""HTTP as a data source: one partition per URL, resumable bodies, retries; and look-ups by POST or HEAD."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship

#: Some servers answer 406 to a request without one.
AGENT = "talweg/0.2 (Spark data source)"
SCHEMA = "url string, content binary, bytes long, sha256 string, state string, error string"


def fetch(url: str, expected: int | None = None, attempts: int = 3, pause: float = 3.0, chunk: int = 1 << 20) -> bytes:
    """The body of a URL. A broken transfer resumes by a byte range, or anew where the server ignores ranges; 404 fails at once."""
    body = bytearray()
    for attempt in range(1, attempts + 1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": AGENT} | ({"Range": f"bytes={len(body)}-"} if body else {}))
            with urllib.request.urlopen(request, timeout=60) as answer:
                if body and answer.status != 206:
                    body.clear()
                while part := answer.read(chunk):
                    body += part
            if not body or (expected is not None and len(body) != expected):
                body.clear()
                raise OSError("the body is empty or of another size")
            return bytes(body)
        except urllib.error.HTTPError as e:
            if e.code == 416 and body and expected in (None, len(body)):
                return bytes(body)
            if e.code == 416:
                body.clear()
            if e.code == 404 or attempt == attempts:
                raise
        except OSError:
            if attempt == attempts:
                raise
        time.sleep(pause * attempt)
    raise OSError("no attempt was made")


class UrlPartition(InputPartition):
    def __init__(self, url: str, expected: int | None) -> None:
        self.url, self.expected = url, expected


class UrlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.wanted = [tuple(x) if isinstance(x, list) else (x, None) for x in json.loads(options.get("urls", "[]"))]
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 3))

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(u, n) for u, n in self.wanted] or [UrlPartition("", None)]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        if not partition.url:
            return
        try:
            body = fetch(partition.url, partition.expected, self.attempts, self.pause)
            yield partition.url, body, len(body), hashlib.sha256(body).hexdigest(), "downloaded", None
        except OSError as e:
            yield partition.url, None, None, None, "failed", f"{type(e).__name__}: {e}"


class UrlSource(DataSource):
    """spark.read.format("urls").option("urls", '["http://…", ["http://…", 123]]'): a row per URL, failures as rows."""

    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> UrlReader:
        return UrlReader(self.options)


def head(urls: DataFrame) -> DataFrame:
    """(url, bytes, exists): the size that a server states; null and false on errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD", headers={"User-Agent": AGENT}), timeout=30) as a:
                        n = a.headers.get("Content-Length")
                        rows.append((url, int(n) if a.status == 200 and n else None, a.status == 200))
                except (OSError, ValueError):
                    rows.append((url, None, False))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["url", "bytes", "exists"])

    ship(urls.sparkSession)
    return urls.select("url").mapInArrow(run, "url string, bytes long, exists boolean")


def post(url: str, data: str | dict, timeout: float = 60.0) -> dict:
    """A JSON answer: text goes as the form field `data`, a dict as a JSON body."""
    body = urllib.parse.urlencode({"data": data}).encode() if isinstance(data, str) else json.dumps(data).encode()
    kind = "application/x-www-form-urlencoded" if isinstance(data, str) else "application/json"
    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind, "User-Agent": AGENT}), timeout=timeout) as answer:
        return json.loads(answer.read())


def first_answer(mirrors: list[str], data: str | dict, ask=post) -> dict:
    """The answer of the first mirror that gives one."""
    problems = []
    for m in mirrors:
        try:
            return ask(m, data)
        except (OSError, ValueError) as e:
            problems.append(f"{m}: {e}")
    raise OSError("; ".join(problems) or "no mirrors")
