"""Operator 4, a quality classifier: random Fourier features, ridge scores and isotonic calibration.

A document is described by statistics of its whole text, computed by built-in functions. Random Fourier features
approximate a Gaussian kernel over the standardised statistics; each partition of the training rows sums its part of
the normal equations, the parts add up to one system, and its solution gives the score. Isotonic regression on rows
that the fit did not see turns scores into probabilities.

Labels enter for fitting only, from a bounded sample (`max_labels` rows, by hash); the statistics and scores cover every
text. Defined results: a null text counts as empty; an empty text has all statistics 0 and a score like any other;
null labels are left out; repeated rows score alike; an empty table gives no rows; without labels of both kinds the
score is 0.5 for all. Further columns pass through `Model.apply`, except those named like its results.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, let, ship, words_of

STATS = ["log_words", "word_length", "symbols", "marks", "upper", "spaces", "line_length", "distinct_words", "distinct_lines"]


def statistics(text: Column) -> Column:
    """array<double>, in the order of STATS."""
    t = F.coalesce(text, F.lit(""))
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    chars = F.length(t)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.length(F.array_join(w, "")).alias("c"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))

    w, x = let(words_of(t), of_words), let(F.split(t, "\n"), of_lines)
    count = lambda rx: F.regexp_count(t, F.lit(rx))
    return let(
        F.struct(w.alias("w"), x.alias("x"), chars.alias("c")),
        lambda s: F.array(
            F.log1p(s["w"]["n"].cast("double")), share(s["w"]["c"], s["w"]["n"]), share(count(r"[#*$%&|<>{}\\~^]"), s["w"]["n"]), share(s["c"] - F.length(F.replace(t, F.lit("!"), F.lit(""))), s["w"]["n"]),
            share(count(r"\p{Lu}"), s["c"]), share(s["c"] - s["w"]["c"], s["c"]), F.log1p(share(s["c"], s["x"]["n"])), share(s["w"]["d"], s["w"]["n"]), share(s["x"]["d"], s["x"]["n"]),
        ),
    )


def labels_used(labels: DataFrame, max_labels: int, seed: int) -> DataFrame:
    """doc_id and quality of at most about `max_labels` rows, chosen by hash: small whatever the table, so it can be broadcast."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).select("doc_id", F.col("quality").cast("double").alias("_y"))
    n = usable.count()
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000))
    bounded = usable.where(part < min(1_000_000, max_labels * 1_000_000 // n)) if n else usable
    return bounded.groupBy("doc_id").agg(F.avg("_y").alias("_y"))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by the steps, linearly between their middles; ranks within a step keep a trace of the raw score."""
        raw = self.raw(x)
        return np.clip(0.998 * np.interp(raw, *self.steps) + 0.002 * np.clip(raw, 0, 1), 0, 1)

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `score`, every whole text being scored."""
        model = self
        ship(docs.sparkSession)

        @F.pandas_udf("double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield pd.Series(model.score(np.stack(s.to_list()).astype(float)) if len(s) else [], dtype="float64")

        kept = [c for c in docs.columns if c != "score"]
        return docs.select(*kept, statistics(F.col(text)).alias("_stats")).select(*kept, scored("_stats").alias("score"))


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase), z, np.ones((len(z), 1))])


def isotonic(raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted raw scores with label means y and counts n: the middles and heights of the steps."""
    blocks: list[list[float]] = []
    for r, v, k in zip(raw, y, n, strict=True):
        blocks.append([r * k, v * k, k])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_labels: int = 20_000, n_features: int = 256, gamma: float = 0.05, ridge: float = 1.0, seed: int = 29) -> Model:
    """A model from the labelled documents whose crc32(doc_id) mod 5 is not 0; one of eight of them calibrates, the others fit."""
    used = labels_used(labels, max_labels, seed)
    rows = docs.select("doc_id", text).join(F.broadcast(used), "doc_id").select("_y", statistics(F.col(text)).alias("_x"), (F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))), F.lit(8)) == 0).alias("_cal"), "doc_id")
    rows = rows.repartition(8, "doc_id").sortWithinPartitions("doc_id", "_x").persist()
    d = len(STATS)
    sums = rows.where(~F.col("_cal")).agg(F.count("*").alias("n"), F.sum("_y").alias("y"), *[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, np.sqrt(2 * gamma), (d, n_features)), rng.uniform(0, 2 * np.pi, n_features)
    width = n_features + d + 1
    if not sums["n"] or not 0 < sums["y"] < sums["n"]:
        rows.unpersist()
        return Model(np.zeros(d), np.ones(d), omega, phase, np.zeros(width), (np.array([0.0]), np.array([0.5])))
    mean = np.array([sums[f"m{i}"] for i in range(d)])
    scale = np.array([sums[f"s{i}"] for i in range(d)])
    scale = np.where(scale > 1e-9 * np.maximum(1, np.abs(mean)), scale, 1.0)  # a constant statistic varies by rounding only

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for b in batches:
            if b.num_rows:
                f = features(np.array(b.column("_x").to_pylist(), float), mean, scale, omega, phase)
                total += f.T @ np.hstack([f, b.column("_y").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_pydict({"i": list(range(width)), "row": total.tolist()}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    parted = in_tasks(rows.where(~F.col("_cal")).select("_x", "_y").coalesce(8), parts, "i int, row array<double>")
    system = parted.collect()  # width rows from each of at most eight partitions, however many the session deals: the size is fixed
    gram = np.zeros((width, width + 1))
    for i in range(width):
        gram[i] = np.sum(sorted((r["row"] for r in system if r["i"] == i)), axis=0)
    weights = np.linalg.solve(gram[:, :width] + ridge * np.eye(width), gram[:, width])
    model = Model(mean, scale, omega, phase, weights, (np.array([0.0]), np.array([0.5])))

    @F.pandas_udf("double")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(s.to_list()).astype(float)))

    cal = rows.where("_cal").select(F.round(raw("_x"), 3).alias("r"), "_y").groupBy("r").agg(F.avg("_y").alias("y"), F.count("*").alias("n")).orderBy("r").collect()
    rows.unpersist()
    if cal:
        model = dataclasses.replace(model, steps=isotonic(*(np.array([r[c] for r in cal], float) for c in ("r", "y", "n"))))
    return model


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = fit(docs, labels)
    scored = model.apply(docs.select("doc_id", "text")).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
