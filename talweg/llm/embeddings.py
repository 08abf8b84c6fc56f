"""Operator 10, embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors are one point with a count. Centroids are fitted on a bounded sample (`sample` vectors, by hash); every
vector is assigned to the cell of its nearest centroid. So that no pair is lost at a border, a vector also visits each
cell whose bisecting plane is within half of the largest chord of a link: of two linked vectors in different cells the
segment between them crosses that plane, so one of the two lies that near to it and visits the other's cell. Recall is
therefore 1 by construction, whatever the centroids. Within a cell, blocks of unit vectors are multiplied in double
precision; a task gives back counts of links per point and a spanning forest, never a row per pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, also not
with their copies; vectors of different lengths are not compared; repeated rows of a vec_id are rows of their own; a null
vec_id links like any other but is no smallest one (component_id is null where a group has no other, and that row is
kept); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import in_tasks, written
from .components import components


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (the vector in its own type, null where it links with nothing)."""
    v = F.col("embedding")
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v"))


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return np.unique(c, axis=0)


def fit(points: DataFrame, n: int, sample: int = 20_000, seed: int = 5) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from at most about `sample` vectors."""
    part = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1_000_000))
    rows = points.where(part < max(1, min(1_000_000, sample * 1_000_000 // max(n, 1)))).select("rep", "v").limit(2 * sample).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["rep"]):
        by.setdefault(len(r["v"]), []).append(r["v"])
    k = max(1, min(1024, math.isqrt(n) // 2))
    return {d: spherical_kmeans(unit(v), max(1, k * len(v) // len(rows)), seed=seed) for d, v in by.items()}


def crosses(x: np.ndarray, c: np.ndarray, own: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """For vectors at home in cells `own`: whether each visits its cell in `other`. Row by row, so that every task gets the same answer."""
    d = c[own] - c[other]
    return (d * x).sum(axis=1) <= 0.5 * math.sqrt(2 - 2 * least) * np.sqrt((d * d).sum(axis=1)) + 1e-7


def visits(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cells; then vectors and the cells that they visit."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    width = np.sqrt(np.maximum(2 - 2 * (c @ c.T)[home], 0))
    i, j = np.nonzero(dots[np.arange(len(x)), home][:, None] - dots <= 0.5 * math.sqrt(2 - 2 * least) * width + 1e-6)
    near = (j != home[i]) & crosses(x[i], c, home[i], j, least)
    return home, i[near], j[near]


def assigned(points: DataFrame, centroids: dict[int, np.ndarray], least: float) -> DataFrame:
    """(rep, n, v, cell, home): a row for the home cell and one for each cell visited. Vectors travel as they came."""
    kind = dict(points.dtypes)["v"]
    element = pa.float32() if kind == "array<float>" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rep, n, vs = b.column("rep").to_numpy(), b.column("n").to_numpy(), b.column("v").to_pylist()
                for d in sorted({len(v) for v in vs}):
                    own = np.array([i for i, v in enumerate(vs) if len(v) == d])
                    raw = np.array([vs[i] for i in own], element.to_pandas_dtype())
                    c = centroids.get(d)
                    home, i, j = visits(unit(raw), c if c is not None else np.ones((1, d)) / math.sqrt(d), least)
                    rows, cell = np.append(np.arange(len(own)), i), np.append(home, j)
                    for x in range(0, len(rows), 8192):
                        part = rows[x : x + 8192]
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(raw[part].ravel(), element))
                        yield pa.RecordBatch.from_arrays([pa.array(rep[own][part]), pa.array(n[own][part]), flat, pa.array(d * 100_000 + cell[x : x + 8192]), pa.array(home[part] + d * 100_000)], names=["rep", "n", "v", "cell", "home"])

    return in_tasks(points, run, f"rep long, n long, v {kind}, cell long, home long")


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """`rows` with the tasks that they take part in: (_kind, _p, _q).

    Kind 0 compares a block of vectors at home (p) with a block of visitors (q), and for q = 0 with itself; kind 1 compares
    two blocks at home (p < q). Visitors are never compared with each other. Most cells are one task, and only rows of
    larger cells, whose counts are joined back, are repeated.
    """
    here = F.col("cell") == F.col("home")
    sizes = rows.groupBy("cell").agg(F.count_if(here).alias("h"), F.count_if(~here).alias("g"))
    large = sizes.where((F.col("h") > block) | (F.col("g") > 8 * block)).select("cell", F.ceil(F.col("h") / block).cast("int").alias("_nh"), F.greatest(F.lit(1), F.ceil(F.col("g") / (8 * block))).cast("int").alias("_ng"))
    one = F.lit(1)
    placed = rows.join(large, "cell", "left").select(*rows.columns, here.alias("_here"), F.greatest(one, F.coalesce("_nh", one)).alias("_nh"), F.coalesce("_ng", one).alias("_ng"))
    own = F.when(F.col("_here"), F.pmod(F.xxhash64("rep"), F.col("_nh"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("_ng"))).cast("int")
    task = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"))
    o = F.col("_own")
    count = lambda n: F.sequence(F.lit(0), n - 1)
    at_home = F.concat(F.transform(count(F.col("_ng")), lambda k: task(0, o, k)), F.transform(F.filter(count(F.col("_nh")), lambda j: j != o), lambda j: task(1, F.least(o, j), F.greatest(o, j))))
    tasks = F.when(F.col("_here"), at_home).otherwise(F.transform(count(F.col("_nh")), lambda i: task(0, i, o)))
    out = placed.withColumn("_own", own).select(*rows.columns, "_own", F.explode(tasks).alias("_t"))
    return out.select(*rows.columns, "_own", F.col("_t.kind").alias("_kind"), F.col("_t.p").alias("_p"), F.col("_t.q").alias("_q"))


def links(points: DataFrame, centroids: dict[int, np.ndarray], least: float, block: int) -> DataFrame:
    """Rows (a, b, n): a point's links as a count n with b null, and forest links (a, b) with n 0."""
    keys = ["cell", "_kind", "_p", "_q"]

    def close(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs by products in single precision with a margin, each found pair then by its product in double precision."""
        single = x.astype(np.float32)
        other, found = single[right].T, []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            i, j = np.nonzero(single[part] @ other >= np.float32(least - 1e-5 - 4e-7 * x.shape[1]))
            for y in range(0, len(i), 65_536):
                a, b = part[i[y : y + 65_536]], right[j[y : y + 65_536]]
                sure = (x[a] * x[b]).sum(axis=1) >= least
                found.append((a[sure], b[sure]))
        return np.concatenate([f[0] for f in found] or [np.array([], int)]), np.concatenate([f[1] for f in found] or [np.array([], int)])

    def pairs(x: np.ndarray, cell: np.ndarray, home: np.ndarray, own: np.ndarray, kind: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of a task. A visitor's pair is left to the other cell where it is met there too and that has the lower number."""
        if kind:
            return close(x, np.flatnonzero(own == p), np.flatnonzero(own == q))
        host, guest = np.flatnonzero(cell == home), np.flatnonzero(cell != home)
        i, j = close(x, host, guest)
        if len(i):
            d = x.shape[1]
            mine, other = home[i] - d * 100_000, home[j] - d * 100_000
            keep = (mine < other) | ~crosses(x[i], centroids[d], mine, other, least)
            i, j = i[keep], j[keep]
        if q == 0:
            a, b = close(x, host, host)
            i, j = np.append(i, a[a < b]), np.append(j, b[a < b])
        return i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in blocks.grouped(batches, keys, 4096):
            rep, n, cell, home, own, kind, p, q = (t.column(c).to_numpy() for c in ("rep", "n", "cell", "home", "_own", "_kind", "_p", "_q"))
            vs = t.column("v").combine_chunks()
            vs = vs.chunk(0) if isinstance(vs, pa.ChunkedArray) else vs
            offsets, flat = vs.offsets.to_numpy(), vs.values.to_numpy()
            for at, to in zip(starts[:-1], starts[1:], strict=True):
                if to - at < 2:
                    continue
                s = slice(at, to)
                x = unit(flat[offsets[at] : offsets[to]].reshape(to - at, -1))
                i, j = pairs(x, cell[s], home[s], own[s], kind[at], p[at], q[at])
                if not len(i):
                    continue
                count = np.bincount(i, n[s][j], to - at).astype(np.int64) + np.bincount(j, n[s][i], to - at).astype(np.int64)
                some = np.flatnonzero(count)
                a, b = blocks.forest(i, j, to - at)
                of = rep[s]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(of[some], of[a])), pa.array([*[None] * len(some), *of[b].tolist()], pa.int64()), pa.array(np.append(count[some], np.zeros(len(a), np.int64)))], names=["a", "b", "n"])

    rows = dealt(assigned(points, centroids, least), block)
    return in_tasks(rows.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, block: int | None = None, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of `vectors`."""
    rows = written(usable(vectors).withColumn("h", F.xxhash64("v")), "vectors")
    points = written(rows.where("v IS NOT NULL").groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "points")
    size = points.agg(F.max(F.size("v"))).first()[0]
    block = block or max(512, 524_288 // (size or 1))  # 4 MB of a block at home in double precision, whatever the vectors' length
    found = written(links(points, fit(points, points.count(), sample), least, block), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    rooted = written(points.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "h", "v", "n", "least", F.coalesce("root", "rep").alias("component")), "vector-groups")
    least_of = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    known = rooted.join(counts, "rep", "left").join(least_of, "component").select("h", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("v IS NOT NULL").join(known, ["h", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors.select("vec_id", "embedding"))


#: The same in DuckDB SQL over all pairs, which only small tables allow; groups by the smallest vec_id reached, round by round.
ORACLE = """
WITH RECURSIVE usable AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.n <> b.n AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached(n, m) AS (SELECT n, n FROM usable UNION SELECT r.n, l.b FROM reached r JOIN links l ON l.a = r.m),
grouped AS (SELECT r.n, min(o.vec_id) AS component_id FROM reached r JOIN usable o ON o.n = r.m GROUP BY r.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, g.component_id, e.vec_id IS NOT DISTINCT FROM g.component_id AS kept FROM usable e JOIN grouped g USING (n) LEFT JOIN counted c USING (n)
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
    WHERE NOT (embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
