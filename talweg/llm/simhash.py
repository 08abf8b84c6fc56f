"""Operator 7, SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 2-bit segments, a point on a grid. The Manhattan distance
of two points never exceeds the Hamming distance of their fingerprints, so fingerprints within `max_bits` lie within
that range on the grid. The axes are split into groups: a range of 3 moves at most 3 of 6 groups, so two such points
share the grid cell of at least one choice of 3 groups. The range join is therefore an equality join on those cells;
within a cell the Manhattan bound is tested first and the Hamming distance, exactly, last.

Documents with one fingerprint are one point, so copies are never paired. Cells are compared in blocks, each of which
gives back a spanning forest of its links: groups of near copies cost no row per pair, and no link is lost.

Defined results: a null or empty text has no shingle and fingerprint 0, which links like any other; fewer words than
a shingle make one shingle; each row of a repeated doc_id is linked by its own text; a null doc_id links like any other
but is no smallest one (component_id is null where a group has no other); an empty table gives no rows; further columns
are ignored by `near_duplicates` and pass through `keep_one`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import in_tasks, pieces, written
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GROUPS, FREE = 6, 3


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """SimHash of the k-word shingles: a bit is set where over half of their XXH64 values have it."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() splits at exactly the six separators
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < k:
        return h(b" ".join(words), seed)
    n = len(words) - k + 1
    joined = [words[i:] for i in range(k)]
    values = np.fromiter((h(b" ".join(s), seed) for s in zip(*joined, strict=False)), np.uint64, n)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        sums += np.unpackbits(values[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and with `digest` content, a digest of the text."""
    further = ["content"] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_t"):
            fps = [signed(fingerprint(x)) for x in b.column("_t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), *[b.column(k) for k in further]], names=["doc_id", "fp", *further])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_t"), *[F.xxhash64(F.col(text)).alias(k) for k in further])
    return in_tasks(taken, run, ", ".join(["doc_id long", "fp long", *[f"{k} long" for k in further]]))


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: for every fingerprint the bit counts of its 32 segments, two bits each in one unsigned long."""
    m = np.uint64(0x5555555555555555)
    return (fp & m) + ((fp >> np.uint64(1)) & m)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings. Counts are 0, 1 or 2; as 00, 01 and 11 their difference is a count of unlike bits."""
    m = np.uint64(0x5555555555555555)
    unary = lambda c: (((c | (c >> np.uint64(1))) & m) | (c & ~m))  # noqa: E731  low bit: at least one; high bit: two
    return np.bitwise_count(unary(a) ^ unary(b))


def axis_masks() -> list[np.uint64]:
    """For each choice of GROUPS - FREE groups of axes, the bits of the embedding that hold them."""
    cuts = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    group = [sum(3 << (2 * s) for s in range(a, b)) for a, b in itertools.pairwise(cuts)]
    return [np.uint64(sum(c)) for c in itertools.combinations(group, GROUPS - FREE)]


def cells(points: DataFrame) -> DataFrame:
    """(rep, fp, cell) for every grid cell of a fingerprint; a cell is named by its choice of axes and its counts there."""
    masks = [signed(int(m)) for m in axis_masks()]
    low = F.lit(0x5555555555555555)
    one, other = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))  # their sum, as no carry leaves a segment
    keys = F.array(*[F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return points.select("rep", "fp", F.explode(keys).alias("cell"))


def links(points: DataFrame, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b) between the representatives `rep` of different fingerprints that keep every pair within `max_bits` connected."""
    if max_bits > FREE:
        raise ValueError(f"the grid covers up to {FREE} bits")
    keys = ["cell", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in blocks.grouped(batches, keys):
            rep, fp = (t.column(c).to_numpy() for c in ("rep", "fp"))
            fp = fp.view(np.uint64)
            points, n = popcounts(fp), len(fp)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            a_found, b_found = [], []
            for lag in range(1, int(np.diff(starts).max())):
                i = np.flatnonzero(group[lag:] == group[:-lag])
                if not len(i):
                    break
                j = i + lag
                near = manhattan(points[i], points[j]) <= max_bits
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                a_found.append(i[near])
                b_found.append(j[near])
            if a_found and sum(map(len, a_found)):
                a, b = blocks.forest(np.concatenate(a_found), np.concatenate(b_found), n)
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    pairs = blocks.dealt(cells(points), "cell", F.xxhash64("fp"), block)
    return in_tasks(pairs.select("rep", "fp", *keys).repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def groups(points: DataFrame, max_bits: int) -> DataFrame:
    """(fp, lead, component) of the points (fp, lead): fingerprints are linked by themselves, whatever the documents' ids."""
    points = written(points, "simhash-points")
    roots = components(links(points.select("fp", F.col("fp").alias("rep")), max_bits))
    return written(points.join(roots, points["fp"] == roots["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("component")), "simhash-groups")


def near_duplicates(docs: DataFrame, text: str = "text", max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable), one row per row of `docs`."""
    fps = written(fingerprints(docs, text), "simhash")
    rooted = groups(fps.groupBy("fp").agg(F.min("doc_id").alias("lead")), max_bits)
    least = rooted.groupBy("component").agg(F.min("lead").alias("component_id"))
    return fps.join(rooted.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", max_bits: int = 3, small: int = 500_000) -> DataFrame:
    """`docs` with one row of each group of near duplicates, one of the smallest doc_id; all rows of null doc_id stay.

    Groups are linked by fingerprints and rows go by doc_id and text, so that different texts of one doc_id are documents
    of their own. Up to `small` dropped rows are broadcast, so that texts stay where they are; more are joined by a shuffle.
    """
    fps = written(fingerprints(docs.where(F.col("doc_id").isNotNull()), text, digest=True), "simhash")
    rooted = groups(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "content")).alias("lead")), max_bits)
    best = rooted.groupBy("component").agg(F.min("lead").alias("best"))
    judged = fps.join(rooted.join(best, "component").select("fp", "best"), "fp").withColumn("kept", F.struct("doc_id", "content") == F.col("best"))
    rows = written(judged.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "simhash-dropped")
    dropped = rows.where("not kept").select("_id", "_content")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_content": F.xxhash64(F.col(text))})
    kept = keyed.join(F.broadcast(dropped) if dropped.count() <= small else dropped, ["_id", "_content"], "left_anti")
    if rows.where("kept").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["_id", "_content"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
