"""Comparisons within cells in blocks: rows of a cell are dealt into blocks of bounded size and every pair of blocks is a
task of its own, so a cell that holds a third of all rows is spread over the cluster. Rows are replicated once per
block of their cell; no pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, cell: str, by: Column, block: int) -> DataFrame:
    """`rows` with `_i` <= `_j`, the pair of blocks of the cell, and `_side`: 0 in block i, 1 in block j, 2 where they are the same.

    Cells up to `block` rows are one block. The sizes of the larger ones come from a count with map-side combining and
    are joined back; the optimizer may broadcast them, as long as they are under its size limit.
    """
    large = rows.groupBy(cell).count().where(F.col("count") > block).select(cell, F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    own = F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.pmod(by, F.col("_blocks")).cast("int"))
    placed = rows.join(large, cell, "left").withColumn("_own", own)
    others = F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1)
    return (
        placed.select("*", F.explode(others).alias("_other"))
        .select(*rows.columns, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.when(F.col("_own") == F.col("_other"), F.lit(2)).when(F.col("_own") < F.col("_other"), F.lit(0)).otherwise(F.lit(1)).cast("int").alias("_side"))
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition that is sorted by `keys`, with the row at which each group starts (and the end)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(whole, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield whole.slice(0, cut), np.append(starts[:-1], cut)
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
        least = max(least, 2 * rows)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, np.append(starts_of(whole, keys), whole.num_rows)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between local indexes 0..n-1, as (member, smallest member) pairs: at most n - 1 of them."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            member = np.flatnonzero(label != np.arange(n))
            return member, label[member]
        label = new
