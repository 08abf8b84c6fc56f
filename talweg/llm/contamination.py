"""Operator 13, benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are sequences of words (A-Z as a-z; digits, letters and all beyond ASCII; the rest separates). The
automaton holds every sequence of words that occurs in an item. A document is streamed through it: after each word the
state stands for the longest suffix that occurs in an item, and its length. Where that length reaches `window`, the
window ending there is hit and the state that stands for just that window names its items; items of fewer words than a
window are hit where the whole of them occurs. Words hit form spans; `clean` cuts out those longer than a limit and turns
away documents that they cover too far.

Size: an automaton has at most two states and three steps a word, some 350 bytes in all. Items go through in passes of
`pass_words` words (140 MB a worker): each pass broadcasts its items, whose size is so bounded, and a worker builds the
automaton once. More items make more passes over what the pass before has written; longer items are cut into
pieces that overlap by a window less one word, so that no window is lost. Documents are not exchanged at all.

Defined results: null and empty texts have no words and are never hit; items without words name nothing; a null item_id
hits words but is no item of the count; rows of one item_id are one item; repeated documents are rows of their own; an
empty table of documents gives no rows, an empty one of items no hits; further columns of documents pass through `clean`
and `spans`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, written

#: A-Z as a-z, digits, a-z and all beyond ASCII stay; the rest separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
PIECE = 20_000


class Automaton:
    """Every sequence of words of the items: steps by state and word, suffix links, and which items end where.

    `items` are (name, words); names may repeat. Words are bytes.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        by_words: dict[tuple[bytes, ...], set[str | None]] = {}
        for name, words in items:
            if words:
                by_words.setdefault(tuple(words), set()).add(name)
        self.word = {w: i for i, w in enumerate(dict.fromkeys(w for words in by_words for w in words))}
        self.width = max(1, len(self.word))
        self.step: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self.out: list[list[int]] = [[]]
        coded = [[self.word[w] for w in words] for words in by_words]
        for words in coded:
            last = 0
            for c in words:
                last = self._extend(last, c)
        del self.out
        self._name(coded, [names - {None} for names in by_words.values()])

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        """The part of state `q` that is reached from `p` by `c` as its longest becomes a state of its own."""
        step, width, link = self.step, self.width, self.link
        made = self._state(self.length[p] + 1, link[q])
        self.out[made] = list(self.out[q])
        for d in self.out[q]:
            step[made * width + d] = step[q * width + d]
        link[q] = made
        while p != -1 and step.get(p * width + c) == q:
            step[p * width + c] = made
            p = link[p]
        return made

    def _extend(self, last: int, c: int) -> int:
        step, width = self.step, self.width
        q = step.get(last * width + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        made = self._state(self.length[last] + 1, 0)
        p = last
        while p != -1 and (q := step.get(p * width + c)) is None:
            step[p * width + c] = made
            self.out[p].append(c)
            p = self.link[p]
        if p != -1:
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return made

    def _name(self, coded: list[list[int]], names: list[set[str]]) -> None:
        """For each state the state of its window, and of the short items that end with it."""
        w = self.window
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.ends = [0] * len(self.length)  # the state that stands for the last `window` words
        for s in order:
            if self.length[s] >= w:
                self.ends[s] = s if self.length[self.link[s]] < w else self.ends[self.link[s]]
        self.names = names
        self.held: dict[int, list[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, words in enumerate(coded):
            s = 0
            for n, c in enumerate(words, 1):
                s = self.step[s * self.width + c]
                if n >= w and (not (h := self.held.setdefault(self.ends[s], [])) or h[-1] != i):
                    h.append(i)
            if len(words) < w:
                self.short.setdefault(s, {}).setdefault(len(words), []).append(i)
        self.mask = [0] * len(self.length)  # bit k: the last k words are a short item
        for s in order:
            self.mask[s] = self.mask[self.link[s]] | sum(1 << k for k in self.short.get(s, {}))
        self.least = min([w, *(len(x) for x in coded)])

    def suffix(self, s: int, k: int) -> int:
        """The state of the last `k` words of state `s`."""
        while self.length[self.link[s]] >= k:
            s = self.link[s]
        return s

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, spans of words hit (from, to, in order, apart) and names of the items."""
        get, step, width, length, link, least = self.word.get, self.step.get, self.width, self.length, self.link, self.least
        state = long = n = 0
        spans: list[tuple[int, int]] = []
        ended: set[tuple[int, int]] = set()
        for words in words_in(text):
            where, which, size = [], [], []
            for i, c in enumerate(map(get, words), n):
                if c is None:
                    state = long = 0
                    continue
                to = step(state * width + c)
                while to is None and state:
                    state = link[state]
                    long = length[state]
                    to = step(state * width + c)
                if to is None:
                    continue
                state = to
                long += 1
                if long >= least:
                    where.append(i)
                    which.append(state)
                    size.append(long)
            n += len(words)
            if where:
                self._collect(np.array(where), np.array(which), np.array(size), spans, ended)
        found = {i for s, k in ended for i in (self.held[s] if k == self.window else self.short[s][k])}
        return n, joined(spans), set().union(*(self.names[i] for i in found)) if found else set()

    def _collect(self, where: np.ndarray, which: np.ndarray, size: np.ndarray, spans: list[tuple[int, int]], ended: set[tuple[int, int]]) -> None:
        w = self.window
        masks = np.array([self.mask[s] for s in which.tolist()], np.int64)
        for k in [w, *(k for k in range(1, w) if (masks >> k & 1).any())]:
            at = size >= k if k == w else (size >= k) & ((masks >> k & 1) == 1)
            p = where[at]
            if len(p):
                cut = np.flatnonzero(np.diff(p) > k)  # windows that overlap or touch are one span
                starts, ends = p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)]
                spans.extend(zip((starts - k + 1).tolist(), (ends + 1).tolist(), strict=True))
                for s in np.unique(which[at]).tolist():
                    ended.add((self.ends[s], w) if k == w else (self.suffix(s, k), k))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words_in(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about `size` bytes each."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        to = folded.find(b" ", at + size)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0))


def parts(items: DataFrame, window: int) -> DataFrame:
    """(name, words, n): the items' words, long items in overlapping pieces that hold all their windows."""
    rows = items.select(F.col("item_id").cast("string").alias("name"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    step = PIECE - window + 1
    starts = F.when(F.size("w") <= PIECE, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size("w") - window + 1, F.lit(step)))
    piece = F.transform(starts, lambda s: F.slice(F.col("w"), s, F.lit(PIECE)))
    return rows.select("name", F.posexplode(piece).alias("piece", "words")).withColumn("n", F.size("words"))


_built: dict[str, Automaton] = {}


def built(key: str, items: list[tuple[str | None, str]], window: int) -> Automaton:
    """The automaton of a broadcast, once a worker; only the last is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, words.encode().split(b" ")) for name, words in items], window)
    return _built[key]


def scanned(docs: DataFrame, items: list[tuple[str | None, str]], window: int, key: str) -> DataFrame:
    """`docs` (_row, its fields; _text; _n, _spans, _items so far) after one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(key, sent.value, window)
        for b in batches:
            before = zip(b.column("_spans").to_pylist(), b.column("_items").to_pylist(), strict=True)
            n, spans, names = [], [], []
            for text, (old_spans, old_names) in zip(b.column("_text"), before, strict=True):
                count, hit, found = automaton.scan(text.as_buffer().to_pybytes() if text.is_valid else b"")
                n.append(count)
                spans.append([{"from": x, "to": y} for x, y in joined([(s["from"], s["to"]) for s in old_spans] + hit)])
                names.append(sorted(found.union(old_names)))
            kept = [c for c in b.schema.names if c not in ("_n", "_spans", "_items")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(names, pa.list_(pa.string()))], names=[*kept, "_n", "_spans", "_items"])

    return in_tasks(docs, run, docs.schema)


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, pass_words: int = 400_000, keep: bool = True) -> DataFrame:
    """(row, n_words, spans, items) for every document: `row` holds the document's columns, `spans` the ranges of words hit (from, before), `items` the names of the items found, sorted."""
    cut = parts(items, window)
    total = cut.agg(F.sum("n")).first()[0] or 0
    passes = max(1, math.ceil(total / pass_words))
    if passes > 1:
        cut = written(cut, "items")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row") if keep else F.struct(F.col("doc_id")).alias("_row")
    nothing = [F.lit(0).cast("long").alias("_n"), F.array().cast("array<struct<from:long,to:long>>").alias("_spans"), F.array().cast("array<string>").alias("_items")]
    out = docs.select(row, F.col("text").alias("_text"), *nothing)
    for k in range(passes):
        some = cut.where(F.pmod(F.xxhash64("name", "words", "piece"), F.lit(passes)) == k) if passes > 1 else cut
        # At most about `pass_words` words: bounded whatever the table's size.
        held = [(r["name"], r["words"]) for r in some.select("name", F.array_join("words", " ").alias("words")).collect()]
        out = scanned(out, held, window, f"{docs.sparkSession.sparkContext.applicationId}-{id(held)}-{k}-{hash(tuple(held))}")
        if k + 1 < passes:
            out = written(out, "scanned")
    return out.select(F.col("_row").alias("row"), F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"), F.col("_text").alias("text"))


def hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5, pass_words: int = 400_000) -> DataFrame:
    """The documents without the spans of more than `longest` words that hit an item; documents with more than `coverage` of their words hit are left out."""
    found = spans(docs, items, window, pass_words).where(hit(F.col("spans")) <= F.lit(coverage) * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [without(t, [(s["from"], s["to"]) for s in cut if s["to"] - s["from"] > longest]) if cut else t for t, cut in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    short = in_tasks(found.select("row", "text", "spans"), run, found.select("row", "text").schema)
    return short.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def without(text: str, cut: list[tuple[int, int]]) -> str:
    """A text without the words of the spans and what stands between them."""
    raw = text.encode()
    folded = raw.translate(FOLD)
    kept, last, n, at = [], 0, 0, 0
    ends = iter(sorted(cut))
    span = next(ends, None)
    while span:
        while at < len(folded) and folded[at] == 32:
            at += 1
        to = folded.find(b" ", at)
        to = len(folded) if to < 0 else to
        if n == span[0]:
            kept.append(raw[last:at])
        n, at = n + 1, to
        if n == span[1]:
            last, span = to, next(ends, None)
    return b"".join([*kept, raw[last:]]).decode()


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = spans(docs.select("doc_id", "text"), items, keep=False)
    n_hit = hit(F.col("spans"))
    return found.select(F.col("row.doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
starts AS (SELECT r, k, a, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM windows))),
met AS (SELECT r, k, a, item_id FROM starts JOIN windows USING (k, s)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + k)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h USING (r) LEFT JOIN named n USING (r)
"""
