"""Grids as cell tables: mosaics, resampling, masks and class shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..schemas import CLOUD_CLASSES
from ..session import ship


def valid(cells: DataFrame, nodata: float | None = -9999.0) -> DataFrame:
    """Cells that are finite and not the no-data value."""
    z = F.col("z")
    fine = z.isNotNull() & ~F.isnan(z.cast("double")) & (F.abs(z.cast("double")) < float("inf"))
    return cells.where(fine if nodata is None else fine & (z != nodata))


def mosaic(parts: DataFrame) -> DataFrame:
    """Cells (row, col, z, priority) of overlapping tiles: the first valid one of each place, the lowest among equals."""
    return valid(parts).groupBy("row", "col").agg(F.min_by("z", F.struct("priority", "z")).alias("z"))


def centre(row: Column, col: Column, x0: float, y0: float, cell: float) -> Column:
    return geom.point(x0 + (col + 0.5) * cell, y0 - (row + 0.5) * cell)


def bilinear(points: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    """(key, z) at points given in source cells (u right, v down; centres at halves). Missing corners leave the others' weights; with none there is no row."""
    u, v = F.col("u") - 0.5, F.col("v") - 0.5
    corners = F.array(*[F.struct((F.floor(v) + r).cast("int").alias("row"), (F.floor(u) + c).cast("int").alias("col"), ((v - F.floor(v)) if r else (1 - (v - F.floor(v)))).alias("wv"), ((u - F.floor(u)) if c else (1 - (u - F.floor(u)))).alias("wu")) for r in (0, 1) for c in (0, 1)])
    spread = points.select(key, F.explode(corners).alias("k")).select(key, "k.row", "k.col", (F.col("k.wu") * F.col("k.wv")).alias("w")).where("w > 0")
    return spread.join(cells.select("row", "col", "z"), ["row", "col"]).groupBy(key).agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def nearest(points: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    placed = points.select(key, F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col"))
    return placed.join(cells.select("row", "col", "z"), ["row", "col"]).select(key, "z")


def sampled(points: DataFrame, cells: DataFrame, key: str = "id", how: str = "bilinear", block: int = 256, piece: Column | None = None) -> DataFrame:
    """(key, z) as by `bilinear` or `nearest`, for many points: these meet their source block and its next row and column as
    one array, so that a point is shuffled once and no corner is.

    `piece` numbers the groups that share a block, so that one crowded with points is shared out; a group holds the points of
    a piece in a block and (block + 1)^2 cells. Points without a place or with no valid corner get no row; cells are unique.
    """
    ship(points.sparkSession)
    smooth = how == "bilinear"
    shift = 0.5 if smooth else 0.0
    home = lambda x: F.floor(x / block).cast("int")
    u, v = F.col("u") - shift, F.col("v") - shift
    fine = F.col("u").isNotNull() & F.col("v").isNotNull() & ~F.isnan("u") & ~F.isnan("v")
    placed = points.where(fine).select(key, u.alias("u"), v.alias("v"), home(v).alias("br"), home(u).alias("bc"), F.coalesce(F.lit(0) if piece is None else piece, F.lit(-1)).cast("long").alias("piece"))
    # A block's first row and column serve the block before it too.
    blocks = lambda x: F.array_distinct(F.array(home(x), home(x - 1))) if smooth else F.array(home(x))
    dealt = cells.where(F.col("z").isNotNull()).select("row", "col", "z", F.explode(blocks(F.col("row"))).alias("br"))
    dealt = dealt.select("row", "col", "z", "br", F.explode(blocks(F.col("col"))).alias("bc"))
    near = dealt.join(placed.select("br", "bc", "piece").distinct(), ["br", "bc"]).select("row", "col", "z", *[F.col(c).alias(f"_{c}") for c in ("br", "bc", "piece")])

    def kernel(where: tuple, at: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        br, bc, _ = where
        grid = np.full((block + 1, block + 1), np.nan)
        grid[known["row"] - br * block, known["col"] - bc * block] = known["z"]
        x, y = at["u"].to_numpy(), at["v"].to_numpy()
        r, c = np.floor(y), np.floor(x)
        fy, fx = y - r, x - c
        r, c = r.astype(np.int64) - br * block, c.astype(np.int64) - bc * block
        total, weight = np.zeros(len(at)), np.zeros(len(at))
        for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)) if smooth else ((0, 0),):
            w = (fy if dr else 1 - fy) * (fx if dc else 1 - fx) if smooth else np.ones(len(at))
            z = grid[r + dr, c + dc]
            w = np.where(np.isnan(z), 0.0, w)
            total += np.where(w > 0, w * np.nan_to_num(z), 0.0)
            weight += w
        some = weight > 0
        return pd.DataFrame({key: at[key][some], "z": (total[some] / weight[some]).astype(known["z"].dtype if not smooth else float)})

    kind = "double" if smooth else dict(cells.dtypes)["z"]
    return placed.groupBy("br", "bc", "piece").cogroup(near.groupBy("_br", "_bc", "_piece")).applyInPandas(kernel, f"{key} {dict(points.dtypes)[key]}, z {kind}")


def masked(cells: DataFrame, ring: Column, x0: float, y0: float, cell: float) -> DataFrame:
    """Cells whose centre is in a ring; others become missing, never 0."""
    x, y = x0 + (F.col("col") + 0.5) * cell, y0 - (F.col("row") + 0.5) * cell
    return cells.where(geom.contains(ring, x, y))


def class_shares(cells: DataFrame, *by: str) -> DataFrame:
    """Cells and percent of each class, per group; the no-data class 0 is left out."""
    counted = cells.where("class > 0").groupBy(*by, "class").agg(F.count("*").alias("cells"))
    total = counted.groupBy(*by).agg(F.sum("cells").alias("total"))
    return (counted.join(total, list(by)) if by else counted.crossJoin(F.broadcast(total))).select(*by, "class", "cells", (100 * F.col("cells") / F.col("total")).alias("percent"))


def cloud_counts(cells: DataFrame, *by: str) -> DataFrame:
    """Cloudy and valid cells per scene and their percentage; kept as counts so that ranks need no rounding of doubles."""
    cloudy, seen = F.count_if(F.col("class").isin(CLOUD_CLASSES)), F.count_if(F.col("class") > 0)
    return cells.groupBy(*by).agg(cloudy.alias("cloudy"), seen.alias("seen"), (100 * cloudy / F.greatest(seen, F.lit(1))).alias("cloud_pct"))


def spans(shapes: DataFrame, x0: float, y0: float, cell: float, height: int, width: int, key: str = "id") -> DataFrame:
    """(key, row, lo, hi): for every row of a grid that a polygon of `shapes` (key, parts) covers, the stretches of x inside, at
    the height of the row's cell centres. Edges are dealt to the rows whose centres they pass, so no cell meets an edge; the
    crossings of a row, sorted, bound its stretches. Odd numbers of rings are inside."""
    a, b = F.col("e.a"), F.col("e.b")
    row = lambda y: (y0 - y) / cell - 0.5
    edge = shapes.select(key, F.explode("parts").alias("r")).select(key, F.explode(geom.edges(F.col("r"))).alias("e")).where(a["y"] != b["y"])
    first, last = F.greatest(F.lit(0), F.floor(row(F.greatest(a["y"], b["y"])))), F.least(F.lit(height - 1), F.ceil(row(F.least(a["y"], b["y"]))))
    dealt = edge.where(first <= last).select(key, "e", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("row"))
    y = y0 - (F.col("row") + 0.5) * cell
    met = dealt.where((a["y"] > y) != (b["y"] > y)).select(key, "row", ((b["x"] - a["x"]) * ((y - a["y"]) / (b["y"] - a["y"])) + a["x"]).alias("x"))
    line = met.groupBy(key, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("lo"), F.get("xs", 2 * i + 1).alias("hi")))
    return line.select(key, "row", F.inline(pairs)).where((F.col("hi") > x0) & (F.col("lo") < x0 + width * cell) & (F.col("lo") < F.col("hi")))


def covered(shapes: DataFrame, x0: float, y0: float, cell: float, height: int, width: int, key: str = "id") -> DataFrame:
    """(key, row, col): the cells of a grid whose centres are in the polygons of `shapes` (key, parts)."""
    column = lambda x: (x - x0) / cell - 0.5
    first, last = F.greatest(F.lit(0), F.floor(column(F.col("lo")))), F.least(F.lit(width - 1), F.ceil(column(F.col("hi"))))
    rows = spans(shapes, x0, y0, cell, height, width, key).where(first <= last)
    at = rows.select(key, "row", "lo", "hi", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("col"))
    x = x0 + (F.col("col") + 0.5) * cell
    return at.where((x >= F.col("lo")) & (x < F.col("hi"))).select(key, "row", "col")
