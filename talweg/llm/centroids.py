"""Operator 11, centroid clustering by sort-means, in exact integers.

Vectors with exactly `size` finite components become integers floor(64 * x). In each round the centroids are ordered by
their distance from each centroid; a vector scans that order from the centroid it was assigned to before and stops at the
first centroid strictly beyond twice its distance (four times, in squares): by the triangle inequality none from there on
is nearer, and none is as near, so ties still go to the smaller number. A round is one pass that reads the vectors with
their last assignment and writes them with the new one, without an exchange, and one pass that sums. What the sums bring
to the driver is bounded by centroids times components.

Sums travel as limbs of 30 bits, so no count of vectors and no component overflows them; components from 2**27 on (which
a table of unit vectors never has) are worked out in integers of any size.

Defined results: vectors that are null, of another length or hold null or non-finite components are left out; repeated
rows are rows of their own, also among the first centroids; a null vec_id is clustered but has no hash, so its vector
starts no centroid before all others do; equal hashes (repeated vec_ids) are ordered by their vectors; fewer vectors than
centroids make fewer centroids; an empty centroid stays where it is; a distance or inertia beyond a long is null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, written

SCALE = 64
#: Components below this have squared distances that a long holds, whatever two vectors of up to 64 components are compared.
SAFE = 2**27
LIMB = 30


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and v: the vectors that take part."""
    v = F.col("embedding")
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(64 * x) as longs, or as Python's integers where these are too large."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * rows.astype(float))
    if np.abs(x).max(initial=0) < SAFE:
        return x.astype(np.int64)
    return np.vectorize(lambda y: int(y * SCALE // 1) if abs(y) < 2**60 else int(y) * SCALE, otypes=[object])(rows.astype(float))


def common_type(*arrays: np.ndarray) -> list[np.ndarray]:
    return [a.astype(object) for a in arrays] if any(a.dtype == object for a in arrays) else list(arrays)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def sort_means(x: np.ndarray, c: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals) and squared distance of each row of `x`, from the assignment `last`."""
    x, c = common_type(x, c)
    apart = squares(c[:, None, :], c[None, :, :])
    best, near = last.copy(), np.empty(len(x), x.dtype)
    for a in np.unique(last):
        rows = np.flatnonzero(last == a)
        own = squares(x[rows], c[a])
        low, at = own.copy(), np.full(len(rows), a)
        active = np.arange(len(rows))
        for b in np.lexsort((np.arange(len(c)), apart[a])):
            if b == a:
                continue
            active = active[(apart[a, b] <= 4 * own[active]).astype(bool)]
            if not len(active):
                break
            d = squares(x[rows[active]], c[b])
            better = ((d < low[active]) | ((d == low[active]) & (b < at[active]))).astype(bool)
            low[active[better]], at[active[better]] = d[better], b
        best[rows], near[rows] = at, low
    return best, near


def as_array(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def first(points: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The vectors with the smallest hashes of `<seed>:<vec_id>`."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return integers(np.array([r["v"] for r in rows], float).reshape(len(rows), size))


def assigned(points: DataFrame, c: np.ndarray, size: int) -> DataFrame:
    """vec_id, v, cluster and distance, by a scan from the cluster that `points` have."""
    kind = dict(points.dtypes)["v"]
    element = pa.float32() if kind == "array<float>" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                v = b.column("v")
                best, near = sort_means(integers(as_array(v, size)), c, b.column("cluster").to_numpy().astype(np.int64))
                far = near if near.dtype != object else [int(d) if d < 2**63 else None for d in near]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), v.cast(pa.list_(element)), pa.array(best.astype(np.int32)), pa.array(far, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return in_tasks(points.select("vec_id", "v", "cluster"), run, f"vec_id long, v {kind}, cluster int, distance long")


def sums(points: DataFrame, k: int, size: int) -> dict[tuple[int, int], int]:
    """(cluster, component) to the sum over its vectors; component -1 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size), object)
        count = np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                x, own = integers(as_array(b.column("v"), size)), b.column("cluster").to_numpy()
                for a in np.unique(own):
                    total[a] += x[own == a].sum(axis=0).astype(object)
                    count[a] += int((own == a).sum())
        rows = []
        for a in np.flatnonzero(count):
            rows.append((a, -1, 0, int(count[a])))
            for i, s in enumerate(total[a].tolist()):
                limb = 0
                while s not in (0, -1):
                    rows.append((a, i, limb, s & ((1 << LIMB) - 1)))
                    s, limb = s >> LIMB, limb + 1
                if s:
                    rows.append((a, i, limb, s))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "i", "limb", "part"])

    parts = in_tasks(points.select("v", "cluster"), run, "cluster int, i int, limb int, part long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "i", "limb").agg(F.sum("part").alias("part")).collect():
        out[r["cluster"], r["i"]] = out.get((r["cluster"], r["i"]), 0) + (r["part"] << (LIMB * r["limb"]))
    return out


def moved(c: np.ndarray, total: dict[tuple[int, int], int]) -> np.ndarray:
    """Centroids at the floor of the mean of their vectors; empty ones stay."""
    out = [[total.get((a, i), 0) // n for i in range(c.shape[1])] if (n := total.get((a, -1))) else c[a].tolist() for a in range(len(c))]
    small = all(abs(x) < SAFE for row in out for x in row)
    return np.array(out, np.int64 if small else object).reshape(c.shape)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of the vectors that take part, and the centroids."""
    spark = vectors.sparkSession
    points = usable(vectors, size).withColumn("cluster", F.lit(0))
    c = first(points, k, seed, size)
    if not len(c):
        return spark.createDataFrame([], f"vec_id long, v {dict(points.dtypes)['v']}, cluster int, distance long"), c
    for _ in range(rounds):
        points = written(assigned(points, c, size), "assigned")
        c = moved(c, sums(points, len(c), size))
    return written(assigned(points, c, size), "assigned"), c


def query(vectors: DataFrame) -> DataFrame:
    points, c = cluster(vectors)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row per centroid.
    by = points.groupBy("cluster").agg(F.when(F.count_if(F.col("distance").isNull()) == 0, total).alias("s")).collect()
    known, long = {r["cluster"]: r["s"] for r in by}, lambda s: F.lit(int(s) if s is not None and s < 2**63 else None).cast("long")
    whole = None if None in known.values() else sum(known.values())
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return points.select(
        "vec_id", "cluster", "distance",
        pick([long(known.get(a, 0)) for a in range(len(c))]).cast("long").alias("cluster_inertia"), long(whole).alias("inertia"), pick([F.lit(d) for d in digest]).cast("string").alias("centroid_sha256"),
    )


def oracle(k: int = 16, rounds: int = 3, size: int = 64, seed: int = 1) -> str:
    """The same in DuckDB SQL: every vector against every centroid, round by round."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT n - 1 AS a, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) AS n FROM kept) WHERE n <= {k})"""]
    far = "list_sum(list_transform(range(1, len(k.v) + 1), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT r, arg_min(a, struct_pack(d := d, a := a)) AS a, CAST(min(d) AS BIGINT) AS d FROM (SELECT k.r, c.a, {far} AS d FROM kept k CROSS JOIN c{n} c) GROUP BY r)")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (SELECT a, list(m ORDER BY i) AS v FROM (SELECT a, i, (s - ((s % n) + n) % n) // n AS m FROM
    (SELECT d.a, i, sum(k.v[i]) AS s, count(*) AS n FROM kept k JOIN d{n} d USING (r), range(1, {size} + 1) t(i) GROUP BY d.a, i)) GROUP BY a)""")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.a, list_transform(coalesce(m.v, c.v), lambda x: CAST(x AS BIGINT)) AS v FROM c{n} c LEFT JOIN m{n} m USING (a))")
    return f"""
WITH {", ".join(steps)}
SELECT k.vec_id, CAST(d.a AS INTEGER) AS cluster, d.d AS distance, CAST(sum(d.d) OVER (PARTITION BY d.a) AS BIGINT) AS cluster_inertia, CAST(sum(d.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k JOIN d{rounds} d USING (r) JOIN c{rounds} c USING (a)
"""


ORACLE = oracle()
