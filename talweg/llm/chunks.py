"""Operator 5, substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: each step shifts it by one bit and adds a value of the new byte. A
chunk has `passage` bytes and starts where the hash of its first 17 bytes is the smallest (the last of equal ones) of
some `every` places in a row; each text's first and last chunk are added. Starts depend on the bytes there only, never on
an earlier chunk, so two texts that share `passage` + `every` - 1 bytes, 97 by default, share a chunk, whatever stands
around them. (50 words have 99 bytes or more.) A chunk whose 88-bit digest (100 bits with its bucket) is met in more than one document is repeated;
repeated chunks that overlap or touch form a passage, and each of its chunks is a whole copy of `passage` bytes. Passages
count from `words` words on, 50 by default: what the chunks show of a shared passage may lack `every` - 1 bytes, or nine
short words, at each end and a word cut at its start, so the words shown must be 32 at least; every shared passage of over
50 words is found, and single lines that many documents share, such as license lines, are left alone. The first
place of a chunk (smallest doc_id, then offset) keeps it, all others lose what no such first chunk covers.

Chunks are dealt into buckets by digest, packed by columns, in one exchange. Of a digest that several documents of a
piece of some megabytes hold, one occurrence a piece goes to its bucket. Buckets grow in number with the documents and
are sorted by digest; only repeated chunks leave them and are gathered by document.

Defined results: null texts, texts under `passage` bytes and rows of a null doc_id have no chunk; documents without a repeated passage give no
row; repeats inside one document only are left alone; rows that repeat a doc_id count as one document, its spans merged;
an empty table gives no rows; further columns are ignored by `passages` and passed through by `remove`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, pieces, ship, unused

WINDOW = 32
#: The gear values, by a rule: 32 bits of the XXH64 of each byte.
GEAR = np.array([0, *(xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFFFFFF for b in range(1, 256))], np.uint32)
#: Five bits that the last 17 bytes reach.
MASK = np.uint32(0x1F << 12)
#: The bits that the last 17 bytes make up.
REACH, LOW = 17, np.uint32((1 << 17) - 1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: its sum over a window is built by doubling, in five passes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(texts: list[bytes], least: int, most: int) -> list[list[int]]:
    """Ends of disjoint chunks of each text; a forced end depends on the chunk before it, so `passages` goes by `starts`."""
    pad = b"\0" * WINDOW  # of gear value 0, so that no window reaches into the next text
    data = np.frombuffer(pad.join([*texts, b""]), np.uint8)
    found = (np.flatnonzero((gear_hash(data) & MASK) == 0) + 1).tolist()
    out, at, k, n = [], 0, 0, len(found)
    for t in texts:
        end, ends, last = at + len(t), [], at
        while k < n and found[k] <= at:
            k += 1
        while k < n and found[k] < end:
            c = found[k]
            while c - last > most:
                last += most
                ends.append(last - at)
            if c - last >= least:
                ends.append(c - at)
                last = c
            k += 1
        while end - last > most:
            last += most
            ends.append(last - at)
        if end > last:
            ends.append(end - at)
        out.append(ends)
        at = end + WINDOW
    return out


def starts(texts: list[bytes], passage: int, every: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one string, where the chunks start in it, and for each chunk its text and its offset there."""
    pad = b"\0" * max(passage, every, WINDOW)
    joined = pad.join([b"", *texts, b""])
    n, sizes = len(joined), np.array([len(t) for t in texts])
    at = len(pad) + np.cumsum(sizes + len(pad)) - sizes - len(pad)
    first, last = at[sizes >= passage], (at + sizes - passage)[sizes >= passage]
    edge = np.zeros(n, np.int8)
    edge[first] = 1
    edge[last + 1] -= 1
    valid = np.cumsum(edge, dtype=np.int8) > 0
    h = gear_hash(np.frombuffer(joined, np.uint8)) & LOW
    low = (h[REACH - 1 :].astype(np.uint64) << np.uint64(32)) | np.arange(n, REACH - 1, -1, dtype=np.uint64)
    width = 1
    while width < every:
        step = min(width, every - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    whole = valid[: len(low)] & valid[every - 1 :][: len(low)]
    chosen = np.zeros(n, bool)
    chosen[n - (low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    chosen[first] = chosen[last] = True
    found = np.flatnonzero(chosen)
    of = np.searchsorted(at, found, "right") - 1
    # An empty text starts where no chunk can, so the last text that starts at or before a chunk holds it.
    return joined, found, of, found - at[of]


#: An occurrence of a chunk: 88 bits of its digest, its document, its offset there, the words begun before it (modulo 256)
#: and those begun in it, 128 more where the chunk is known to be repeated.
CHUNK = {"high": np.int64, "low": np.uint16, "lower": np.uint8, "doc_id": np.int64, "place": np.int32, "word": np.uint8, "words": np.uint8}
#: One whose chunk is known to be repeated and to come first elsewhere.
KNOWN = {k: CHUNK[k] for k in ("doc_id", "place", "word", "words")}
#: Whether a byte separates words.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def words_begun(joined: bytes) -> np.ndarray:
    """For each position of texts in one string, the words that begin before it; a text's first word begins after its padding."""
    space = SPACE[np.frombuffer(joined, np.uint8)] | (np.frombuffer(joined, np.uint8) == 0)
    begin = ~space
    begin[1:] &= space[:-1]
    return np.append(0, np.cumsum(begin, dtype=np.int32))


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of their bytes, which compress well where values are near each other."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpacked(data: list[bytes], kinds: dict) -> list[np.ndarray]:
    width = sum(np.dtype(d).itemsize for d in kinds.values())
    rows = np.concatenate([np.frombuffer(d, np.uint8).reshape(width, -1).T for d in data])
    ends = np.cumsum([np.dtype(d).itemsize for d in kinds.values()])
    return [np.ascontiguousarray(rows[:, y - np.dtype(d).itemsize : y]).view(d)[:, 0] for d, y in zip(kinds.values(), ends, strict=True)]


def ordered(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences (columns of CHUNK) by digest, document and place; for each the first of its digest, and whether that is repeated."""
    order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    high, low, lower, doc = columns[:4]
    begin = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (lower[1:] != lower[:-1])]))
    size = np.diff([*begin, len(doc)])
    sure = np.maximum.reduceat(columns[6], begin) >= 128
    return columns, np.repeat(begin, size), np.repeat(sure | (doc[begin] != doc[begin + size - 1]), size), order


def chunks(docs: DataFrame, text: str = "text", passage: int = 80, every: int = 18, buckets: int | None = None) -> DataFrame:
    """(bucket, data): every chunk, packed with the others of its bucket.

    A piece of texts that holds a chunk in several documents sends on its first place there only; its others are known to
    be repeated and not to be first, and go to buckets of their own, so that a frequent digest fills no bucket.
    """
    if passage < REACH:
        raise ValueError(f"passages have {REACH} bytes at least")
    buckets = buckets or min(1 << 22, max(4096, docs.count() // 500))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in pieces(batches, "_t", 4_000_000):
            joined, found, of, place = starts(b.column("_t").cast(pa.binary()).to_pylist(), passage, every)
            if not len(found):
                continue
            begun = words_begun(joined)
            before = begun[found] - begun[found - place]
            inside = begun[found + passage] - begun[found]
            made = np.frombuffer(b"".join([digest(joined[x : x + passage]) for x in found.tolist()]), np.dtype([("high", "<i8"), ("low", "<u2"), ("lower", "u1"), ("none", "u1"), ("rest", "<u4")]))
            values = (made["high"], made["low"], made["lower"], b.column("doc_id").to_numpy()[of], place, before % 256, np.minimum(inside, 127))
            columns, head, many, order = ordered([c.astype(d) for c, d in zip(values, CHUNK.values(), strict=True)])
            known = many & ((columns[3] != columns[3][head]) | (columns[4] != columns[4][head]))
            columns[6] = np.where(many, columns[6] | 128, columns[6]).astype(np.uint8)
            bucket = (made["rest"] % buckets).astype(np.int32)[order]
            keys, data = [], []
            if known.any():
                keys.append(buckets + int(made["rest"][0] >> 2))
                data.append(packed([columns[i][known] for i in range(3, 7)]))
            rest = np.flatnonzero(~known)
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            own, cut = np.unique(bucket[rest], return_index=True)
            keys += own.tolist()
            data += [packed([c[rest[x:y]] for c in columns]) for x, y in itertools.pairwise([*cut.tolist(), len(rest)])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    rows = docs.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    dealt = in_tasks(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_t")), run, "bucket int, data binary")
    return dealt.withColumn("known", F.col("bucket") >= buckets)


def repeats(dealt: DataFrame) -> DataFrame:
    """(doc_id, at, word, words): every occurrence of a chunk that more than one document holds; `at` is twice its offset, and one more for the first."""

    def run(t: pa.Table) -> pa.Table:
        data = t.column("data").to_pylist()
        if t.column("known")[0].as_py():
            doc, place, word, words = unpacked(data, KNOWN)
            at = 2 * place.astype(np.int64)
        else:
            columns, head, many, _ = ordered(unpacked(data, CHUNK))
            doc, place, word, words = (c[many] for c in columns[3:])
            at = 2 * place.astype(np.int64) + ((columns[3] == columns[3][head]) & (columns[4] == columns[4][head]))[many]
        return pa.table({"doc_id": doc, "at": at, "word": word.astype(np.int32), "words": (words & 127).astype(np.int32)})

    ship(dealt.sparkSession)
    return dealt.groupBy("bucket").applyInArrow(run, "doc_id long, at long, word int, words int")


def spans(place: np.ndarray, first: np.ndarray, passage: int) -> tuple[int, int, list[tuple[int, int, bool]]]:
    """Of a document's repeated chunks: the passages, their bytes, and their parts (start, end, whether a first chunk covers it)."""
    points = np.unique(np.concatenate([place, place + passage]))
    depth = np.zeros((2, len(points)), np.int64)
    for k in (0, 1):
        p = place[first == k]
        np.add.at(depth[k], np.searchsorted(points, p), 1)
        np.add.at(depth[k], np.searchsorted(points, p + passage), -1)
    other, own = depth.cumsum(axis=1) > 0
    state = np.where(own, 2, np.where(other, 1, 0))
    cut = np.flatnonzero(np.diff(state, prepend=-1))
    parts = [(int(points[i]), int(points[j]), bool(state[i] == 2)) for i, j in zip(cut[:-1], cut[1:]) if state[i]]
    n = sum(i == 0 or parts[i - 1][1] < x[0] for i, x in enumerate(parts))
    return n, sum(y - x for x, y, _ in parts), parts


def long_enough(place: np.ndarray, word: np.ndarray, words: np.ndarray, passage: int, least: int) -> np.ndarray:
    """Which of a document's repeated chunks, in order of place, lie in a passage that shows `least` words or more."""
    begin = np.append(True, place[1:] > place[:-1] + passage)[: len(place)]
    run = np.cumsum(begin) - 1
    heads = np.flatnonzero(begin)
    step = np.append(0, (word[1:] - word[:-1]) % 256)  # fewer than 256 words begin within a chunk
    step[begin] = 0
    shown = np.cumsum(step) + words
    return (np.maximum.reduceat(shown, heads) - np.cumsum(step)[heads])[run] >= least


def passages(docs: DataFrame, text: str = "text", passage: int = 80, every: int = 18, words: int = 50) -> DataFrame:
    """One row per document that holds repeated passages: doc_id, n_passages, repeated_bytes, removed_bytes and `spans`
    (start, end, first: byte offsets of parts of passages, and whether they are kept as the first of their kind)."""
    ordered = repeats(chunks(docs, text, passage, every)).groupBy("doc_id").agg(F.collect_list(F.struct("at", "word", "words")).alias("held"))
    least = words + 1 - 2 * (every // 2) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], []
            for i in range(b.num_rows):
                rows = b.column("held")[i].values
                at, once = np.unique(rows.field("at").to_numpy(), return_index=True)
                fine = long_enough(at >> 1, *(rows.field(c).to_numpy()[once] for c in ("word", "words")), passage, least)
                if not fine.any():
                    continue
                n, size, parts = spans(at[fine] >> 1, (at[fine] & 1) == 1, passage)
                held.append(i)
                out.append((n, size, sum(y - x for x, y, kept in parts if not kept), [{"start": x, "end": y, "first": kept} for x, y, kept in parts]))
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            made = pa.array([x[3] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(held, pa.int32())), *columns, made], names=["doc_id", "n_passages", "repeated_bytes", "removed_bytes", "spans"])

    return in_tasks(ordered, run, "doc_id long, n_passages long, repeated_bytes long, removed_bytes long, spans array<struct<start:int,end:int,first:boolean>>")


def remove(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the repeated spans that are not the first of their kind; bytes of a character cut in two go too."""
    own, drop, raw, keep = unused(docs, "_id", "_drop", "_raw", "_keep")
    cut = found.select(F.col("doc_id").alias(own), F.filter("spans", lambda x: ~x["first"]).alias(drop))
    kept = F.expr(f"""concat(transform(sequence(0, size({drop})), i -> struct(
        if(i = 0, 0, greatest(0, {drop}[i - 1].end)) AS x, if(i = size({drop}), octet_length({raw}), {drop}[i].start) AS y)), cast(array() AS array<struct<x:int,y:int>>))""")
    joined = docs.join(cut, docs["doc_id"] == cut[own], "left").withColumn(raw, F.encode(F.col(text), "UTF-8")).withColumn(keep, F.when(F.size(drop) > 0, kept))
    glued = F.expr(f"aggregate({keep}, cast('' AS binary), (a, k) -> concat(a, substring({raw}, k.x + 1, greatest(0, k.y - k.x))))")
    cleaned = F.when(F.col(keep).isNull(), F.col(text)).otherwise(F.make_valid_utf8(glued.cast("string")))
    return joined.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return passages(docs.select("doc_id", "text"))
