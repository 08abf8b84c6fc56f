"""The download store: files by URL in a shared folder, each whole and checked before it appears under its name.

The index is a Parquet table, partitioned by a bucket of the file's name, that each run appends a record per URL to: Spark's
committer shows a run's records together or not at all. A look-up reads the buckets of the names asked for. `compact` writes
the next generation of the table with only the records that still decide. Tasks fetch, check and rename, so that nothing
but records passes through the driver; a task that is run again fetches again and renames over its own file.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..progress import fetched_bytes
from ..session import ship
from . import rasters
from .http import AGENT

RECORD = "url string, path string, bytes long, sha256 string, state string, error string, seq long"
#: Folders of the index. A name's bucket holds every URL and path that ends in it, so one look-up finds URLs and owners of paths.
BUCKETS = 64
KINDS = {"zip": "zip", "tif": "raster", "tiff": "raster", "json": "json", "geojson": "json"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def check(path: str, name: str, expected: int | None = None) -> None:
    """ValueError unless a file has content, the expected size and, by the suffix of `name`, a readable form."""
    fs, where = opened(path)
    info = fs.get_file_info(where)
    if info.type != pafs.FileType.File or not info.size:
        raise ValueError("the file is empty or missing")
    if expected is not None and info.size != expected:
        raise ValueError(f"{info.size} bytes in place of {expected}")
    kind = KINDS.get(name.rsplit(".", 1)[-1].lower())
    if kind == "zip":
        with fs.open_input_file(where) as f:
            try:
                with zipfile.ZipFile(f) as z:
                    bad = z.testzip()
            except zipfile.BadZipFile as e:
                raise ValueError(f"a broken archive: {e}") from e
            if bad:
                raise ValueError(f"a broken member: {bad}")
    elif kind == "raster":
        try:
            a = rasters.layout(path)
            first = next((i for i, n in enumerate(a.lengths) if n), None)
            if first is not None:
                rasters.unpack(rasters.read_range(path, a.offsets[first], a.lengths[first]), a)
        except Exception as e:
            raise ValueError(f"an unreadable raster: {type(e).__name__}: {e}") from e
    elif kind == "json":
        with fs.open_input_stream(where) as f:
            json.load(f)


def transfer(url: str, path: str, attempts: int = 3, pause: float = 3.0, chunk: int = 1 << 20) -> tuple[int, str]:
    """Streams a URL into a file: its size and digest. A broken transfer goes on by a byte range, or anew where the server ignores ranges."""
    fs, where = opened(path)
    problem: Exception = OSError("no attempt was made")
    out, size, digest = fs.open_output_stream(where, compression=None), 0, hashlib.sha256()
    try:
        for attempt in range(1, attempts + 1):
            try:
                asked = urllib.request.Request(url, headers={"User-Agent": AGENT} | ({"Range": f"bytes={size}-"} if size else {}))
                with urllib.request.urlopen(asked, timeout=60) as answer:
                    if size and answer.status != 206:
                        out.close()
                        out, size, digest = fs.open_output_stream(where, compression=None), 0, hashlib.sha256()
                    while part := answer.read(chunk):
                        out.write(part)
                        digest.update(part)
                        size += len(part)
                return size, digest.hexdigest()
            except urllib.error.HTTPError as e:
                if e.code == 416 and size:
                    return size, digest.hexdigest()
                if e.code == 404:
                    raise
                problem = e
            except OSError as e:
                problem = e
            if attempt < attempts:
                time.sleep(pause * attempt)
        raise problem
    finally:
        out.close()


def fetched(url: str, path: str, expected: int | None, attempts: int, pause: float) -> tuple[int, str]:
    """Fetches to another name, checks and renames; a file that fails its check is fetched anew."""
    fs, where = opened(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    name = where.rsplit("/", 1)[-1]
    part = f"{path}.{uuid.uuid4().hex}.part"
    for attempt in range(1, attempts + 1):
        try:
            size, digest = transfer(url, part, attempts, pause)
            check(part, name, expected)
            fs.move(opened(part)[1], where)
            return size, digest
        except (OSError, ValueError) as e:
            if fs.get_file_info(opened(part)[1]).type == pafs.FileType.File:
                fs.delete_file(opened(part)[1])
            if isinstance(e, OSError) or attempt == attempts:
                raise
            time.sleep(pause * attempt)
    raise OSError("no attempt was made")


def digest_of(path: str, chunk: int = 1 << 20) -> str:
    fs, where = opened(path)
    digest = hashlib.sha256()
    with fs.open_input_stream(where, compression=None) as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def bucket(name: Column) -> Column:
    return F.pmod(F.crc32(name), F.lit(BUCKETS)).cast("int")


def generations(root: str) -> list[int]:
    """The numbers of the index's tables, the last one being in force."""
    fs, where = opened(f"{root}/_index")
    found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.type == pafs.FileType.Directory and f.base_name.isdigit())


def index(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The records of the store over all runs (since the last `compact`: those that decide), or those of some buckets."""
    numbers = generations(root)
    if not numbers:
        return spark.createDataFrame([], RECORD)
    records = spark.read.schema(f"{RECORD}, bucket int").parquet(f"{root}/_index/{numbers[-1]}")
    return (records if buckets is None else records.where(F.col("bucket").isin(buckets))).drop("bucket")


def append(records: DataFrame, root: str) -> None:
    """Adds records to the index: all of them, or none if a task fails for good. A run makes one file a bucket."""
    numbers = generations(root) or [0]
    placed = records.withColumn("bucket", bucket(text.file_name(F.col("url")))).repartition("bucket")
    placed.write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#url", "true").parquet(f"{root}/_index/{numbers[-1]}")


def compact(spark: SparkSession, root: str) -> None:
    """The next generation of the index: of every URL and path the last record with content, of every content the first.

    `obtain` gives the same results before and after it. Failures and older records go. The new table appears by one rename;
    the one before it stays for look-ups under way, older ones are deleted. No run may append meanwhile. An empty store stays so.
    """
    numbers = generations(root)
    if not numbers:
        return
    last = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq"), "url")) == 1
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("seq", "path")) == 1
    kept = index(spark, root).where("sha256 IS NOT NULL").select("*", last("url").alias("_u"), last("path").alias("_p"), first.alias("_c")).where("_u OR _p OR _c")
    fs, base = opened(f"{root}/_index")
    name = f".next-{uuid.uuid4().hex}"
    placed = kept.select(*index(spark, root).columns, bucket(text.file_name(F.col("url"))).alias("bucket")).repartition("bucket")
    placed.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#url", "true").parquet(f"{root}/_index/{name}")
    fs.move(f"{base}/{name}", f"{base}/{numbers[-1] + 1}")
    for n in numbers[:-1]:
        fs.delete_dir(f"{base}/{n}")


def history(records: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Records with first_path, and state `downloaded, duplicate` where that content came earlier under another path in `among` (the records themselves)."""
    known = records if among is None else among.join(records.select("sha256").distinct(), "sha256", "left_semi")
    first = known.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("seq", "path")).alias("_f"))
    twin = (F.col("state") == "downloaded") & (F.col("path") != F.col("_f.path"))
    return records.join(first, "sha256", "left").withColumn("state", F.when(twin, "downloaded, duplicate").otherwise(F.col("state"))).withColumn("first_path", F.col("_f.path")).select(*records.columns, "first_path")


def obtain(wanted: DataFrame, root: str, attempts: int = 3, pause: float = 3.0, tasks: int = 16) -> DataFrame:
    """`wanted` (url, folder, expected size or null) in the store: a record per URL, state reused, downloaded, downloaded, duplicate or failed.

    An indexed file is used again if it still passes its check and has the digest of its record. A file lies under its URL's
    own name in its folder; where another URL has that path (by the index, or the first of those now asked for), it lies in
    a folder of the URL's digest there. Null URLs get no record; of repeated ones the first folder by name counts.
    """
    spark = ship(wanted.sparkSession)
    counted = fetched_bytes(spark.sparkContext)
    seq = time.time_ns() // 1000
    used = [r["b"] for r in wanted.where("url IS NOT NULL").select(bucket(text.file_name(F.col("url"))).alias("b")).distinct().collect()]  # 64 at most
    stored = index(spark, root, used).where("sha256 IS NOT NULL")
    known = stored.groupBy("url").agg(F.max_by(F.struct("path", "bytes", "sha256"), "seq").alias("_i"))
    once = wanted.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct(F.coalesce("folder", F.lit("")).alias("folder"), F.col("expected").cast("long").alias("expected"))).alias("_w"))
    under = lambda *more: F.concat_ws("/", F.lit(root), F.nullif(F.col("_w.folder"), F.lit("")), *more, text.file_name(F.col("url")))
    named = once.select("url", "_w", under().alias("plain"), under(F.substring(F.sha2("url", 256), 1, 16)).alias("apart"))
    owners = stored.groupBy(F.col("path").alias("plain")).agg(F.max_by("url", "seq").alias("_owner"))
    firsts = named.groupBy("plain").agg(F.min("url").alias("_first"))
    placed = named.join(firsts, "plain").join(owners, "plain", "left")
    path = F.when(F.col("url") == F.coalesce("_owner", "_first"), F.col("plain")).otherwise(F.col("apart"))
    asked = placed.join(known, "url", "left").select("url", path.alias("path"), F.col("_w.expected").alias("expected"), F.col("_i.path").alias("old"), F.col("_i.bytes").alias("bytes"), F.col("_i.sha256").alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row = None
                if r["old"] == r["path"]:
                    try:
                        check(r["path"], r["path"], r["bytes"])
                        if digest_of(r["path"]) != r["sha256"]:
                            raise ValueError("another content than that of the record")
                        row = (r["url"], r["path"], r["bytes"], r["sha256"], "reused", None, seq)
                    except (OSError, ValueError):
                        pass  # fetched again below
                if row is None:
                    try:
                        size, digest = fetched(r["url"], r["path"], r["expected"], attempts, pause)
                        counted.add(size)
                        row = (r["url"], r["path"], size, digest, "downloaded", None, seq)
                    except (OSError, ValueError) as e:
                        row = (r["url"], None, None, None, "failed", f"{type(e).__name__}: {e}", seq)
                types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["url", "path", "bytes", "sha256", "state", "error", "seq"])

    append(asked.repartition(tasks).mapInArrow(run, RECORD), root)
    return history(index(spark, root, used).where(F.col("seq") == seq), index(spark, root))
