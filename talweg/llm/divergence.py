"""Operator 12, source divergence audit by two-dimensional tiling of groups.

Tasks count the terms of their documents by group (lang, source) before anything is exchanged. The terms that enough
documents of a language hold get a place in a chunk of the vocabulary; a group's counts in a chunk are one packed row.
The groups of a language are dealt into blocks, each group's rows go to the tiles (block, block) that its block takes
part in, and a tile's task goes through its chunks one after the other and adds up the submatrix of its pairs. A wide
vocabulary is cut into spans of chunks, which are tasks of their own whose sums are added. All shares are whole
numbers of 1e-9, by long division.

Defined results: null text, lang and source are empty strings; a group without terms takes part with the shares of zero
counts; without kept terms in a language all its pair values are zero and it has no terms to report; repeated rows count
as often as they occur; equal values are ranked by item; an empty table gives no rows; further columns are ignored.
Counts up to some 9e15 a group are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import in_tasks, pieces, written

#: Letters stay (A-Z as a-z) and so does all beyond ASCII; what is left separates terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What is added to each count, and what a whole is.
PRIOR, WHOLE = 5, 1_000_000_000
CHUNK, SPAN, BLOCK = 8192, 16, 32


def terms_of(text: pa.StringArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each term's text, and the terms, of texts without nulls."""
    n, at = len(text), text.offset
    offsets = np.frombuffer(text.buffers()[1], np.int32)[at : at + n + 1] if n else np.zeros(1, np.int32)
    data = text.buffers()[2]
    flat = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(LETTERS) if data is not None else b""
    plain = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(flat))
    words = pc.ascii_split_whitespace(plain)
    values = words.flatten()
    return np.repeat(np.arange(n), np.diff(words.offsets.to_numpy())), values


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed over all documents."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            doc, values = terms_of(b.column("text"))
            coded = values.dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            some = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
            real = some[code] if len(code) else np.array([], bool)
            doc, code, k = doc[real], code[real], len(names)
            if not len(code):
                continue
            langs, sources = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            pair, times = np.unique(doc * k + code, return_counts=True)
            key, own = np.unique(group[pair // k] * k + pair % k, return_inverse=True)
            n, held = np.bincount(own, times).astype(np.int64), np.bincount(own).astype(np.int64)
            g = key // k
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), names.take(pa.array(key % k)), pa.array(n), pa.array(held)], names=["lang", "source", "term", "n", "docs"])

    found = in_tasks(rows, run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(WHOLE * (n + PRIOR) / (total + PRIOR * v)), three digits at a time."""
    below = total + F.lit(PRIOR) * v

    def digits(rest: Column, out: Column, left: int) -> Column:
        if not left:
            return out
        more = F.struct((rest * 1000).alias("x"), out.alias("o"))
        return F.transform(F.array(more), lambda s: digits(s["x"] % below, s["o"] * 1000 + F.call_function("div", s["x"], below), left - 1))[0]

    return digits((n + PRIOR) % below, F.call_function("div", n + PRIOR, below), 3) + 1


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """The same of an array of counts whose rows are groups."""
    below = (total + PRIOR * v)[:, None]
    out, rest = np.divmod(n + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def joined(rows: DataFrame, few: DataFrame, on: list[str], by: str, ways: int = 64) -> DataFrame:
    """`rows` with what `few` has for their keys; rows of one key are spread by `by` over `ways` copies of its row."""
    salted = few.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).join(salted, [*on, "_way"]).drop("_way")


def vocabulary(counts: DataFrame, least_docs: int, chunk: int) -> DataFrame:
    """(lang, term, lang_n, chunk, place): the terms kept, each with a place in a chunk of about `chunk` terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term", "lang_n"), "vocabulary")
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = joined(kept, sizes, ["lang"], "term").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return dealt.select("lang", "term", "lang_n", "chunk", place.alias("place"))


def tiles(kept: DataFrame, stats: DataFrame, spans: DataFrame, block: int, span: int) -> DataFrame:
    """(lang, a, b, value) for each two sources a < b of a language."""
    sizes = stats.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = stats.join(sizes, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    heads = dealt.join(spans, "lang").select("lang", "source", "blocks", "own", "total", "v", "span", "terms", F.lit(-1).alias("chunk"), F.array().cast("array<struct<place:int,n:long>>").alias("packed"))
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("packed"))
    bodies = packed.join(dealt, ["lang", "source"]).select("lang", "source", "blocks", "own", "total", "v", F.expr(f"chunk div {span}").cast("int").alias("span"), F.lit(0).cast("long").alias("terms"), "chunk", "packed")
    both = heads.unionByName(bodies).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = both.select("lang", "source", "own", "total", "v", "span", "terms", "chunk", "packed", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: dict = {}

        def done() -> Iterator[pa.RecordBatch]:
            if tile:
                zero = shares(np.zeros((len(tile["names"]), 1), np.int64), tile["total"], tile["v"])[:, 0] if tile["v"] else np.zeros(len(tile["names"]), np.int64)
                sums = tile["sums"] + (tile["terms"] - tile["seen"]) * np.abs(zero[:, None] - zero[None, :])
                x, y = np.nonzero(tile["pairs"])
                names = np.array(tile["names"], object)
                swap = names[x] > names[y]
                a, b = np.where(swap, names[y], names[x]), np.where(swap, names[x], names[y])
                yield pa.RecordBatch.from_arrays([pa.array([tile["key"][0]] * len(x), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(sums[x, y])], names=["lang", "a", "b", "value"])

        for t, starts in blocks.grouped(batches, ["lang", "i", "j", "span", "chunk"], 64):
            for at, to in zip(starts[:-1], starts[1:], strict=True):
                part = t.slice(at, to - at)
                key = tuple(part.column(c)[0].as_py() for c in ("lang", "i", "j", "span"))
                names = part.column("source").to_pylist()
                if key != tile.get("key"):
                    yield from done()
                    own = part.column("own").to_numpy()
                    left, right = own == key[1], own == key[2]
                    pairs = np.triu(np.ones((len(own), len(own)), bool), 1) if key[1] == key[2] else left[:, None] & right[None, :]
                    tile = {"key": key, "names": names, "at": {s: i for i, s in enumerate(names)}, "total": part.column("total").to_numpy(), "v": part.column("v")[0].as_py(), "terms": part.column("terms")[0].as_py(), "pairs": pairs, "sums": np.zeros(pairs.shape, np.int64), "seen": 0}
                    continue
                packs = part.column("packed").combine_chunks()
                flat = packs.flatten()
                rows = np.repeat([tile["at"][s] for s in names], pc.list_value_length(packs).to_numpy())
                place, column = np.unique(flat.field("place").to_numpy(), return_inverse=True)
                n = np.zeros((len(tile["names"]), len(place)), np.int64)
                n[rows, column] = flat.field("n").to_numpy()
                p = shares(n, tile["total"], tile["v"])
                tile["seen"] += len(place)
                for x in np.flatnonzero(tile["pairs"].any(axis=1)):
                    y = np.flatnonzero(tile["pairs"][x])
                    tile["sums"][x, y] += np.abs(p[y] - p[x]).sum(axis=1)
        yield from done()

    keys = ["lang", "i", "j", "span"]
    parts = in_tasks(placed.repartition(*keys).sortWithinPartitions(*keys, "chunk", "source"), run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: how far the other sources of the language are, and what a source has more of than its language."""
    counts = written(counted(docs), "term-counts")
    words = written(vocabulary(counts, least_docs, chunk), "places")
    kept = written(counts.select("lang", "source", "term", "n").join(words, ["lang", "term"]), "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    langs = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = written(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")]), "groups")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    more = joined(kept, stats, ["lang", "source"], "term").select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(more).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    # A language without kept terms still has one span, of none.
    full = words.groupBy("lang", F.expr(f"chunk div {span}").cast("int").alias("span")).agg(F.count("*").alias("terms"))
    bare = stats.where("v = 0").select("lang", F.lit(0).alias("span"), zero.alias("terms")).distinct()
    sums = tiles(kept, stats, full.unionByName(bare), block, span)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = ranked(sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def query(docs: DataFrame) -> DataFrame:
    return audit(docs)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT g.lang, coalesce(k.v, 0) AS v, coalesce(c.total, 0) AS lang_total FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang) LEFT JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) c USING (lang)),
totals AS (SELECT lang, source, coalesce(total, 0) AS total FROM groups LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.total + 5 * l.v)::HUGEINT AS p, 1 + (1000000000 * (a.n + 5)::HUGEINT) // (l.lang_total + 5 * l.v)::HUGEINT AS q
    FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) JOIN lang_counts a ON a.lang = t.lang AND a.term = k.term LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50
"""
