"""Operator 9, byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of a pre-token are taken in order of rank, and of position within a rank. Positions wait in one bucket per
rank; a bitmap of the filled buckets, with two levels of summaries above it, gives the next rank by three find-first-set
steps, whatever the length of the pre-token. Tokens are a linked list over the bytes. A merge touches its two
neighbours only; entries of pairs that are gone are recognised when they come up and skipped. A pre-token of n bytes
costs O(n) queue steps. Short pre-tokens share one run of the queue, their lists not being linked to each other, and a
bucket is then merged as an array.

Results per word are kept in a bounded memo in each Python worker; texts come in as Arrow batches, whole.

Defined results: a null text counts as empty and gives no ids; repeated rows are encoded alike; an empty table gives no
rows; strings of special tokens are ordinary text; further columns pass through `encode`, except those named like its
results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_tasks, pieces


class RankQueue:
    """Buckets by rank under a bitmap of three levels of 64-way words."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Pushes positions by their ranks; negative ranks stay out."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks, 0, sorter=order) :]
        if not len(order):
            return
        sorted_ranks, places = ranks[order], positions[order].tolist()
        cuts = np.flatnonzero(sorted_ranks[1:] != sorted_ranks[:-1]) + 1
        ends = [*cuts.tolist(), len(places)]
        at = 0
        for rank, end in zip(sorted_ranks[np.append(0, cuts)].tolist(), ends, strict=True):
            self.push(rank, places[at])
            if end - at > 1:
                self.buckets[rank] += places[at + 1 : end]
            at = end

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions; the queue must not be empty."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = a << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[a] = bits
        if not bits:
            word &= word - 1
            self.mid[b] = word
            if not word:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


#: Pre-tokens up to this many bytes share one run of the queue, whose buckets are then merged as arrays.
SHORT = 64
#: Buckets up to this many entries are merged one by one.
FEW = 8
#: So many short pre-tokens share a run, which bounds its arrays.
GROUP = 16_384


class Encoder:
    """Encodes and decodes by a table of ranks (token bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        #: Only this pattern is known to start a pre-token at every lone space; texts under others are never cut into words.
        self.cuttable = pattern == default_vocabulary()[1]
        #: White space other than the plain space, for a look at what stands beside a space.
        self.crossed = re.compile(r" \s|[^\S ] ").search
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.tokens = {i: t for t, i in ranks.items()}
        #: Every pair of tokens whose bytes together are a token, with that token's rank.
        self.pairs = {(ranks[t[:c]], ranks[t[c:]]): r for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[order], -1)
        top = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(top)])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)
        #: Words (text up to the next space) to their ids: at the start of a text, and after a space.
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.memo_size = memo

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where they don't merge."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge_one(self, piece: bytes) -> bytes:
        """The packed ids of one pre-token, of any length."""
        if (whole := self.ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        rank_of = self.pairs.get
        ids = [*self.single[np.frombuffer(piece, np.uint8)].tolist(), -1]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n
        queue = RankQueue()
        push = queue.push
        for i in range(n - 2):
            if (r := rank_of((ids[i], ids[i + 1]), -1)) >= 0:
                waiting[i] = r
                push(r, i)
        while queue.top:
            r, bucket = queue.pop()
            bucket.sort()
            for at, i in enumerate(bucket):
                if waiting[i] != r:
                    continue  # stale: the pair has changed or gone since
                j = after[i]
                k = after[j]
                ids[i], waiting[j], ids[j] = r, -1, -2
                after[i], before[k] = k, i
                waiting[i] = low = rank_of((r, ids[k]), -1)
                if low >= 0:
                    push(low, i)
                if (h := before[i]) >= 0:
                    waiting[h] = new = rank_of((ids[h], r), -1)
                    if new >= 0:
                        push(new, h)
                        low = new if low < 0 else min(low, new)
                if 0 <= low < r:  # a lower rank has come up: it goes before the rest of this one
                    for rest in bucket[at + 1 :]:
                        push(r, rest)
                    break
        found = np.array(ids)
        return found[found >= 0].astype("<u4").tobytes()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of short pre-tokens. Of a popped bucket each pre-token merges its first pair; its others go back."""
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes + 1)
        raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        n = len(raw)
        ids = self.single[raw]
        ids[ends - 1] = -1  # lists are not linked across these
        word = np.repeat(np.arange(len(pieces)), sizes + 1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting = np.full(n, -1)
        waiting[:-1] = self.ranks_of(ids[:-1], ids[1:])
        queue = RankQueue()
        push, pair = queue.push, self.pairs.get
        queue.push_all(waiting, np.arange(n))
        while queue.top:
            r, bucket = queue.pop()
            if len(bucket) <= FEW:
                last = -1
                for i in sorted(bucket):
                    if waiting[i] != r:
                        continue
                    if word[i] == last:
                        push(r, i)
                        continue
                    last = word[i]
                    j = after[i]
                    k, h = after[j], before[i]
                    ids[i], ids[j], waiting[j] = r, -2, -1
                    after[i], before[k] = k, i
                    waiting[i] = new = pair((r, int(ids[k])), -1)
                    if new >= 0:
                        push(new, i)
                    if h >= 0:
                        waiting[h] = new = pair((int(ids[h]), r), -1)
                        if new >= 0:
                            push(new, int(h))
                continue
            at = np.array(bucket)
            at = np.sort(at[waiting[at] == r])
            of = word[at]
            first = np.append(True, of[1:] != of[:-1])[: len(at)]
            if not first.all():
                queue.push_all(np.full(len(at), r)[~first], at[~first])
                at = at[first]
            j = after[at]
            k, h = after[j], before[at]
            ids[at], ids[j], waiting[j] = r, -2, -1
            after[at], before[k] = k, at
            waiting[at] = right = self.ranks_of(np.full(len(at), r), ids[k])
            left = self.ranks_of(np.where(h >= 0, ids[h], -1), np.full(len(at), r))
            waiting[h[h >= 0]] = left[h >= 0]
            queue.push_all(np.append(right, left), np.append(at, h))
        alive = ids >= 0
        at = (4 * np.cumsum(alive)[ends - 1]).tolist()
        packed = ids[alive].astype("<u4").tobytes()
        return [packed[x:y] for x, y in itertools.pairwise([0, *at])]

    def words(self, text: str) -> tuple[str, list[str]] | None:
        """The text cut at its spaces; None where other white space stands beside one, so that a pre-token may cross it.

        Elsewhere a pre-token starts at every space and none crosses it.
        """
        if not self.cuttable or text[-1:].isspace() or self.crossed(text):
            return None
        first, *rest = text.split(" ")
        return first, rest

    def learn(self, texts: list[str]) -> list[bytes | None]:
        """Puts the words of the texts into the memo; encodes what can't be cut into words."""
        new: tuple[set[str], set[str]] = (set(), set())
        uncut: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if (cut := self.words(t)) is None:
                uncut.append((i, self.split(t)))
            else:
                new[0].add(cut[0])
                new[1].update(cut[1])
        if sum(map(len, self.memo)) + sum(len(x - m.keys()) for x, m in zip(new, self.memo, strict=True)) > self.memo_size:
            self.memo = ({}, {})
        missing = [list(x - m.keys()) for x, m in zip(new, self.memo, strict=True)]
        inner = self.split("".join([" " + w for w in missing[1]]))  # a word starts where a pre-token starts with a space
        starts = [self.split(w) for w in missing[0]]
        distinct = list({*inner, *(m for p in starts for m in p), *(m for _, p in uncut for m in p)})
        coded = dict(zip(distinct, self.merge([m.encode() for m in distinct]), strict=True))
        bounds = [*(i for i, m in enumerate(inner) if m[0] == " "), len(inner)]
        values = [coded[m] for m in inner]
        self.memo[1].update((w, values[x] if y == x + 1 else b"".join(values[x:y])) for w, (x, y) in zip(missing[1], itertools.pairwise(bounds), strict=True))
        self.memo[0].update((w, b"".join([coded[m] for m in p])) for w, p in zip(missing[0], starts, strict=True))
        out: list[bytes | None] = [None] * len(texts)
        for i, p in uncut:
            out[i] = b"".join([coded[m] for m in p])
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed."""
        known = self.ranks
        short = [p for p in pieces if len(p) <= SHORT and p not in known]
        merged: dict[bytes, bytes] = {}
        for at in range(0, len(short), GROUP):
            part = short[at : at + GROUP]
            merged.update(zip(part, self.merge_many(part), strict=True))
        return [x if (x := merged.get(p)) is not None else self.merge_one(p) for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = self.learn(texts)
        starts, inner = self.memo
        for i, t in enumerate(texts):
            if out[i] is None:
                first, *rest = t.split(" ")
                out[i] = starts[first] + b"".join(map(inner.__getitem__, rest))
        return out

    def decode(self, ids: np.ndarray, most: int = 131_072) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end. `most` ids are spread out at a time, which bounds the index arrays."""
        sizes = self.lengths[ids]
        parts = []
        for at in range(0, len(ids), most):
            n = sizes[at : at + most]
            ends = np.cumsum(n)
            parts.append(self.bytes[np.repeat(self.offsets[ids[at : at + most]] - ends + n, n) + np.arange(int(ends[-1]))].tobytes())
        return b"".join(parts), np.cumsum(sizes)


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary file in a worker."""
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, carry: list[str] | None = None, piece: int = 1_000_000) -> DataFrame:
    """`docs` with `ids` (array<int>), n_tokens and the digests of the ids and of the decoded bytes.

    `path` is where every worker finds the vocabulary, an installed file that is read only. `carry` names the columns of
    `docs` that the result keeps, all by default: the text itself need not travel back. `piece` bounds the bytes of text
    that a worker takes at a time; a longer text is taken alone and whole.
    """
    where, rule = default_vocabulary()
    where, rule = path or where, pattern or rule
    new = T.StructType.fromDDL("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new.names]
    schema = T.StructType([*docs.select(*kept).schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where, rule)
        for b in pieces(batches, "_t", piece):
            coded = e.encode([t or "" for t in b.column("_t").to_pylist()])
            ends = np.cumsum([0, *[len(c) // 4 for c in coded]])
            ids = np.frombuffer(b"".join(coded), "<u4")
            back, at = e.decode(ids)
            cuts = np.append(0, at)[ends].tolist()
            lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(ids.astype("<i4")))
            view = memoryview(back)
            new_columns = [lists, pa.array(np.diff(ends), pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(view[x:y]).hexdigest() for x, y in itertools.pairwise(cuts)], pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new_columns], names=[*kept, *new.names])

    return in_tasks(docs.select(*kept, F.col(text).alias("_t")), run, schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`rows` with `decoded`, the bytes of their ids; null for null ids."""
    where, rule = default_vocabulary()
    where, rule = path or where, pattern or rule
    kept = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where, rule)
        for b in batches:
            back = [None if x is None else e.decode(np.array(x, "<i4"))[0] for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(back, pa.binary())], names=[*kept, "decoded"])

    return in_tasks(rows.select(*kept, F.col(ids).alias("_ids")), run, schema)


def query(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text"), carry=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

