"""Cell sets (row, col) as labelled parts and as polygons.

Labels are found within square blocks and merged over the blocks' borders, where only links between parts of blocks are
left; outlines are runs of cell sides, made within blocks, whose rings come from `overlay.rings`. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..session import checkpointed, ship
from . import hydro, overlay


def merged(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the smallest node that it reaches. Each round hooks every node to its
    smallest neighbour, follows these hooks to their ends and goes on with links between the ends; it halves the nodes at least."""
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = hydro.ends(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        known = checkpointed(hooks if known is None else known.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root")))
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = checkpointed(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return known if known is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between local cells 0..n-1: the smallest cell that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(mask: DataFrame, block: int = 256) -> DataFrame:
    """`mask` (row, col) with `label`: the smallest cell number of its part, of cells that share sides."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        r, c = hydro.frame(pdf, block)
        at = np.full((block + 4, block + 4), -1)
        at[r, c] = np.arange(len(pdf))
        links = [(at[r, c][near >= 0], near[near >= 0]) for near in (at[r + 1, c], at[r, c + 1])]
        label = least_labels(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), len(pdf))
        node = pdf["row"].to_numpy().astype(np.int64) * hydro.ROW + pdf["col"].to_numpy()
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "part": node[label]})

    ship(mask.sparkSession)
    size = F.lit(block)
    placed = mask.select("row", "col").distinct().select("row", "col", F.floor(F.col("row") / size).cast("int").alias("br"), F.floor(F.col("col") / size).cast("int").alias("bc"))
    local = checkpointed(hydro.by_block(placed, "br", "bc").applyInPandas(kernel, "row int, col int, part long"))
    links = None
    for along, across in (("row", "col"), ("col", "row")):
        last = local.where(F.pmod(F.col(across), size) == block - 1).select(along, (F.col(across) + 1).alias(across), F.col("part").alias("a"))
        first = local.where(F.pmod(F.col(across), size) == 0).select(along, across, F.col("part").alias("b"))
        met = last.join(first, [along, across]).select("a", "b")
        links = met if links is None else links.unionByName(met)
    roots = merged(links)
    return local.join(roots, F.col("part") == F.col("node"), "left").select("row", "col", F.coalesce("root", "part").alias("label"))


#: Sides of a cell with the cell on their left: the neighbour that must be absent, and start and end from the cell's south-west corner.
SIDES = (((1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((-1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0)))


def sides(cells: DataFrame, block: int = 256) -> DataFrame:
    """(shape, x0, y0, x1, y1): the outline of each label of `cells` (row, col, label) in straight runs, x to the east in
    columns, y to the north in rows (row 0 lies between y 0 and y -1)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = hydro.frame(pdf, block)
        n = block + 4
        at = np.full((n, n), -1)
        at[r, c] = np.arange(len(pdf))
        label, own = pdf["label"].to_numpy(), pdf["own"].to_numpy()
        here = np.full((n, n), -1)
        here[r[own], c[own]] = np.flatnonzero(own)
        names, out = np.append(label, -1), []
        of = names[at]  # the label of each cell, -1 without one; labels are cell numbers
        for (dr, dc), start, end in SIDES:
            bare = (here >= 0) & (of != np.roll(of, (-dr, -dc), (0, 1)))
            flat = dr != 0
            lines, marks = (bare, of) if flat else (bare.T, of.T)
            goes_on = lines[:, 1:] & lines[:, :-1] & (marks[:, 1:] == marks[:, :-1])
            first, last = lines.copy(), lines.copy()
            first[:, 1:] &= ~goes_on
            last[:, :-1] &= ~goes_on
            (i, a), (_, b) = np.nonzero(first), np.nonzero(last)
            row0, col0, row1, col1 = (i, a, i, b) if flat else (a, i, b, i)
            if (start > end) if flat else (start[1] > end[1]):
                lead, tail = (row1, col1), (row0, col0)
            else:
                lead, tail = (row0, col0), (row1, col1)
            if not flat:  # rows grow to the south, y to the north
                lead, tail = tail, lead
            br, bc = int(pdf["br"].iloc[0]) * block - 2, int(pdf["bc"].iloc[0]) * block - 2
            corner = lambda cell, off, br=br, bc=bc: (cell[1] + bc + off[0], -(cell[0] + br) - 1 + off[1])
            (x0, y0), (x1, y1) = corner(lead, start), corner(tail, end)
            out.append(pd.DataFrame({"shape": of[row0, col0], "x0": x0, "y0": y0, "x1": x1, "y1": y1}))
        return pd.concat(out).astype("int64")

    return hydro.by_block(hydro.around(cells.select("row", "col", "label"), block), "br", "bc").applyInPandas(kernel, "shape long, x0 long, y0 long, x1 long, y1 long")


def outlines(mask: DataFrame, block: int = 256) -> DataFrame:
    """(label, points, twice) for each ring of each part of `mask`: outer rings turn left, holes right; whole numbers of cells, y to the north."""
    return overlay.rings(sides(checkpointed(labelled(mask, block)), block)).withColumnRenamed("shape", "label")


def polygons(mask: DataFrame, origin: tuple[float, float] = (0.0, 0.0), cell: float = 1.0, block: int = 256) -> DataFrame:
    """(label, parts, holes, area, outline): each part of `mask` as rings, the outer one first, with the length of all its rings."""
    spot = lambda p: geom.point(origin[0] + p["x"] * cell, origin[1] + p["y"] * cell)
    each = outlines(mask, block).select("label", "twice", F.transform("points", spot).alias("ring"))
    found = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("twice")).alias("o"), F.col("ring").alias("r")))).alias("s"), F.count_if(F.col("twice") < 0).alias("holes"), (F.sum("twice") * (cell * cell / 2)).alias("area"), F.sum(geom.length(F.col("ring"), True)).alias("outline"))
    return found.select("label", F.transform("s", lambda v: v["r"]).alias("parts"), "holes", "area", "outline")
