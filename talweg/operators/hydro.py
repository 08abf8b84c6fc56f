"""Flow over an elevation grid kept as a cell table (row, col, z); a cell without a row is invalid.

All work goes by square blocks. Filling has one fixpoint whatever the order: blocks are filled by themselves, and those whose
neighbours changed at the border are filled again. Accumulation and basins are solved within blocks first; what is left
are the cells where flow enters a block, a small table whose pointers are followed by doubling, and a last pass brings
the answer back to all cells. Channels follow pointers by doubling: log2(length) rounds, each cut by a checkpoint.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
import itertools
import math
import operator
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schemas import NEIGHBOURS
from ..session import checkpointed, ship

ROW = 1 << 32


def node(row: Column | str = "row", col: Column | str = "col") -> Column:
    """A cell as one number."""
    c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("long")
    return c(row) * ROW + c(col)


def placed(nodes: DataFrame) -> DataFrame:
    """`nodes` with the row and col that their numbers were made of, also of cells below zero."""
    half = 1 << 31
    up = F.col("node") + half
    return nodes.select("*", F.shiftright(up, 32).cast("int").alias("row"), (up.bitwiseAND(F.lit(ROW - 1)) - half).cast("int").alias("col"))


def around(cells: DataFrame, block: int) -> DataFrame:
    """Every cell in its block, and again in each block that it borders: columns br, bc and own."""
    ship(cells.sparkSession)  # the blocks go to Python workers
    size = F.lit(block)
    at = lambda r, c: F.struct(F.floor((F.col("row") + r) / size).cast("int").alias("br"), F.floor((F.col("col") + c) / size).cast("int").alias("bc"))
    inner = F.pmod("row", size).between(1, block - 2) & F.pmod("col", size).between(1, block - 2)
    targets = F.when(inner, F.array(at(0, 0))).otherwise(F.array_distinct(F.array(*[at(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])))
    dealt = cells.select(*cells.columns, F.explode(targets).alias("_b"))
    return dealt.select(*cells.columns, "_b.br", "_b.bc", ((F.floor(F.col("row") / size) == F.col("_b.br")) & (F.floor(F.col("col") / size) == F.col("_b.bc"))).alias("own"))


def by_block(dealt: DataFrame, *keys: str) -> GroupedData:
    """Groups of blocks over a fixed number of tasks: they are small in bytes but not in work, and would else be put into one."""
    spark = dealt.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(tasks, *keys).groupBy(*keys)


def frame(pdf: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a block's cells in an array with a border of two, so that neighbours always exist."""
    return (pdf["row"] - pdf["br"] * block + 2).to_numpy(), (pdf["col"] - pdf["bc"] * block + 2).to_numpy()


def seeds(cells: DataFrame, block: int = 256) -> DataFrame:
    """Valid cells with fewer than eight valid neighbours."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = frame(pdf, block)
        valid = np.zeros((block + 4, block + 4), bool)
        valid[r, c] = True
        near = sum(valid[r + dr, c + dc].astype(int) for dr, dc in NEIGHBOURS)
        return pdf.loc[pdf["own"] & (near < 8), ["row", "col"]]

    return by_block(around(cells.select("row", "col"), block), "br", "bc").applyInPandas(kernel, "row int, col int")


def fill(cells: DataFrame, block: int = 256, whole: bool = False, spill: bool | None = None) -> DataFrame:
    """`row, col, z, f`: depressions filled to their lowest way out, each step of the way up by the least amount: the next
    double, or 1 with `whole` for elevations in integers.

    With `spill` the levels of all depressions come first, from a graph of the catchments of the blocks' borders
    (`levels`), in a number of passes that does not grow with the length of the way out; blocks then exchange steps only
    within waters of one level that reach over their borders. Elevations that lie closer together than a water has steps
    break what this start assumes; a last look at every cell finds that, and the fill starts again without it. Without
    `spill` blocks whose neighbours changed at the border are filled again until none does, in as many rounds as the longest
    way out crosses blocks. Both end at the same elevations; unset, grids of more than 24 blocks a side go by the graph.
    """
    kind = "long" if whole else "double"
    start = cells.select("row", "col", F.col("z").cast(kind).alias("z"))
    if spill is None:
        b = start.agg(*[f(c).alias(f"{c}{i}") for c in ("row", "col") for i, f in enumerate((F.min, F.max))]).first()
        spill = b["row0"] is not None and max(b["row1"] - b["row0"], b["col1"] - b["col0"]) > 24 * block
    if not spill:
        return relaxed(start, block, whole)
    done = checkpointed(relaxed(levels(start, block), block, whole))
    return done if unsettled(done, block, whole).limit(1).count() == 0 else relaxed(start, block, whole)


def padded(r: np.ndarray, c: np.ndarray, n: int, values: np.ndarray, empty: float) -> list:
    """Values of a block's cells on one line with a border of two; places without a cell hold `empty`."""
    out = np.full(n * n, empty, values.dtype)
    out[r * n + c] = values
    return out.tolist()


def rim_of(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Cells of a block with fewer than eight neighbours there."""
    there = np.zeros((n, n), bool)
    there[r, c] = True
    return ~np.logical_and.reduce([there[r + dr, c + dc] for dr, dc in NEIGHBOURS])


#: Above every elevation, and below.
FAR, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min

#: A block as one row: which places of it hold a cell, elevations and fill of these, packed; its border cells and which of them changed.
PACKED = "br int, bc int, cells binary, z binary, f binary, at array<int>, edge_z array<long>, edge_f array<long>, fresh array<boolean>, woken boolean"


def ranked(v: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, so that the next double is one more; whole numbers as they are."""
    if v.dtype.kind != "f":
        return v.astype(np.int64)
    bits = v.astype(np.float64).view(np.int64)
    return np.where(bits < 0, LEAST - bits, bits)


def unranked(v: np.ndarray, whole: bool) -> np.ndarray:
    return v if whole else np.where(v < 0, LEAST - v, v).view(np.float64)


def packed(v: np.ndarray) -> bytes:
    return zlib.compress(v.tobytes(), 1)


def unpacked(block_row: pd.Series, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a block's cells, row by row, their elevations and their fill."""
    read = lambda name, kind: np.frombuffer(zlib.decompress(block_row[name]), kind)
    z = read("z", np.int64)
    return np.flatnonzero(np.unpackbits(read("cells", np.uint8), count=block * block)), z, z + read("f", np.int64)


def lowered(place: np.ndarray, z: np.ndarray, f: np.ndarray, start: np.ndarray, block: int) -> np.ndarray:
    """The fill of a block's cells once what starts below it has run through the block, each step of the way up by one."""
    n = block + 2
    at = (place // block + 1) * n + place % block + 1
    low = np.flatnonzero(start < f)
    over, under = np.full(n * n, LEAST), np.zeros(n * n, np.int64)
    over[at], under[at] = np.minimum(f, start), z
    fs, zs = over.tolist(), under.tolist()  # places without a cell lie below all, so nothing lowers them
    bits = (n * n).bit_length()
    mask = (1 << bits) - 1
    heap = [v << bits | k for v, k in zip(start[low].tolist(), at[low].tolist(), strict=True)]
    heapq.heapify(heap)
    steps = [dr * n + dc for dr, dc in NEIGHBOURS]
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        v, k = x >> bits, x & mask
        if v > fs[k]:
            continue
        v += 1
        for s in steps:
            j = k + s
            old = fs[j]
            if old > v:
                new = zs[j]
                if new < v:
                    new = v
                if new < old:
                    fs[j] = new
                    push(heap, new << bits | j)
    return np.array(fs, np.int64)[at]


def block_row(br: int, bc: int, place: np.ndarray, z: np.ndarray, f: np.ndarray, after: np.ndarray, block: int) -> pd.DataFrame:
    """The row of a block whose fill was `f` and is `after`."""
    there = np.zeros(block * block, bool)
    there[place] = True
    r, c = place // block, place % block
    edge = (r == 0) | (r == block - 1) | (c == 0) | (c == block - 1)
    lines = {"at": place[edge].astype(np.int32), "edge_z": z[edge], "edge_f": after[edge], "fresh": after[edge] != f[edge]}
    return pd.DataFrame({"br": [br], "bc": [bc], "cells": [packed(np.packbits(there))], "z": [packed(z)], "f": [packed(after - z)]} | {k: [v] for k, v in lines.items()} | {"woken": [True]})


def relaxed(cells: DataFrame, block: int, whole: bool) -> DataFrame:
    """`row, col, z, f` by lowering within blocks until no border changes. Where `cells` have a level `w`, cells that lie at
    their own level beside a lower one start there, and only waters that reach over borders need further rounds.

    A block is a row from the first round on. A round reads the border cells, finds by them what their changes lower in
    other blocks, and runs that through those blocks; cells are dealt once before and once after all rounds.
    """
    kind = "long" if whole else "double"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = frame(pdf, block)
        own, z = pdf["own"].to_numpy(), ranked(pdf["z"].to_numpy())
        start = np.where(rim_of(r, c, block + 4), z, FAR)
        if "w" in pdf:
            w = ranked(pdf["w"].to_numpy())
            grid = np.full((block + 4, block + 4), FAR)
            grid[r, c] = w
            beside = np.logical_or.reduce([grid[r + dr, c + dc] < w for dr, dc in NEIGHBOURS])
            start = np.where(beside & (z == w), np.minimum(start, w), start)
        if not own.any():  # beyond the grid
            return pd.DataFrame(columns=["br", "bc", "cells", "z", "f", "at", "edge_z", "edge_f", "fresh", "woken"])
        place = ((r - 2) * block + c - 2)[own]
        order = np.argsort(place)
        place, z, start = place[order], z[own][order], start[own][order]
        f = np.full(len(z), FAR)
        return block_row(pdf["br"].iloc[0], pdf["bc"].iloc[0], place, z, f, lowered(place, z, f, start, block), block)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf.iloc[0]
        place, z, f = unpacked(held, block)
        met = np.searchsorted(place, np.asarray(held["met"], np.int64))
        start = np.full(len(z), FAR)
        start[met] = np.maximum(z[met], np.asarray(held["by"], np.int64) + 1)
        return block_row(held["br"], held["bc"], place, z, f, lowered(place, z, f, start, block), block)

    def cell_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf.iloc[0]
        place, z, f = unpacked(held, block)
        f = f if whole else np.minimum(f, ranked(np.array([np.inf]))[0])
        return pd.DataFrame({"row": held["br"] * block + place // block, "col": held["bc"] * block + place % block, "z": unranked(z, whole), "f": unranked(f, whole)})

    row, col = F.col("br") * block + F.floor(F.col("at") / block).cast("int"), F.col("bc") * block + F.col("at") % block
    blocks = checkpointed(by_block(around(cells, block), "br", "bc").applyInPandas(first, PACKED), 16)
    while True:
        border = blocks.select("br", "bc", "woken", F.inline(F.arrays_zip("at", "edge_z", "edge_f", "fresh")))
        border = border.select(row.alias("row"), col.alias("col"), F.col("edge_z").alias("z"), F.col("edge_f").alias("f"), (F.col("woken") & F.col("fresh")).alias("changed"))
        lower = useful(border.where("changed"), border, block).select("br", "bc", F.struct(((F.col("row") - F.col("br") * block) * block + F.col("col") - F.col("bc") * block).alias("met"), "by").alias("m"))
        woken = checkpointed(lower.groupBy("br", "bc").agg(F.collect_list("m").alias("m")).select("br", "bc", "m.met", "m.by"))
        if woken.limit(1).count() == 0:
            return by_block(blocks.select("br", "bc", "cells", "z", "f"), "br", "bc").applyInPandas(cell_rows, f"row int, col int, z {kind}, f {kind}")
        done = by_block(blocks.select("br", "bc", "cells", "z", "f").join(woken, ["br", "bc"]), "br", "bc").applyInPandas(again, PACKED)
        still = blocks.join(woken.select("br", "bc"), ["br", "bc"], "left_anti").withColumn("woken", F.lit(False))
        blocks = checkpointed(done.unionByName(still), 16)


def useful(edge: DataFrame, state: DataFrame, block: int) -> DataFrame:
    """The blocks (br, bc) that changed border cells of other blocks (row, col, f) can lower."""
    near = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in NEIGHBOURS])).alias("n")
    size = F.lit(block)
    reached = edge.select(F.col("f").alias("by"), F.floor(F.col("row") / size).alias("r0"), F.floor(F.col("col") / size).alias("c0"), near).select("by", "r0", "c0", "n.row", "n.col")
    reached = reached.withColumn("br", F.floor(F.col("row") / size).cast("int")).withColumn("bc", F.floor(F.col("col") / size).cast("int")).where("br <> r0 OR bc <> c0")
    lowest = reached.groupBy("row", "col", "br", "bc").agg(F.min("by").alias("by"))
    return lowest.join(state.select("row", "col", F.col("z").alias("_z"), F.col("f").alias("_f")), ["row", "col"]).where("by < _f AND _z < _f")


def unsettled(filled: DataFrame, block: int, whole: bool) -> DataFrame:
    """Cells that neither start a fill nor lie where their lowest neighbour leaves them."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = frame(pdf, block)
        n = block + 4
        f, z = pdf["f"].to_numpy(), pdf["z"].to_numpy()
        grid = np.full((n, n), np.iinfo(np.int64).max - 1 if whole else np.inf, f.dtype)
        grid[r, c] = f
        low = np.minimum.reduce([grid[r + dr, c + dc] for dr, dc in NEIGHBOURS])
        want = np.where(rim_of(r, c, n), z, np.maximum(z, low + 1 if whole else np.nextafter(low, np.inf)))
        return pdf.loc[pdf["own"] & (want != f), ["row", "col"]]

    return by_block(around(filled.select("row", "col", "z", "f"), block), "br", "bc").applyInPandas(kernel, "row int, col int")


#: What lies beyond the grid, as a catchment.
BEYOND = -(1 << 62)


def levels(cells: DataFrame, block: int) -> DataFrame:
    """`row, col, z, w`: the lowest level at which water can leave the grid from each cell, without any step up.

    Each block is flooded from its border: every cell belongs to the catchment of the border cell (or of a cell at the
    grid's own rim) that it drains to, and catchments that touch have a pass. Over the blocks' borders the passes make a
    graph of border catchments; Boruvka's rounds give each catchment its level, and a last join takes it back to the cells.
    """
    kind = dict(cells.dtypes)["z"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = frame(pdf, block)
        n = block + 4
        own, z = pdf["own"].to_numpy(), pdf["z"].to_numpy()
        at, node_ = r * n + c, pdf["row"].to_numpy().astype(np.int64) * ROW + pdf["col"].to_numpy()
        rim = own & rim_of(r, c, n)
        border = own & ((r == 2) | (r == block + 1) | (c == 2) | (c == block + 1))
        zs = padded(r, c, n, z, 0)
        names: list = [None] * (n * n)
        for k, i, b in zip(at[rim | border].tolist(), node_[rim | border].tolist(), rim[rim | border].tolist(), strict=True):
            names[k] = BEYOND if b else i
        heap = list(zip(z[rim | border].tolist(), at[rim | border].tolist(), strict=True))
        heapq.heapify(heap)
        mine = bytearray(n * n)
        for k in at[own].tolist():
            mine[k] = 1
        f = list(zs)
        passes: dict = {}
        steps = [dr * n + dc for dr, dc in NEIGHBOURS]
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            v, k = pop(heap)
            mark = names[k]
            for s in steps:
                j = k + s
                if not mine[j]:
                    continue
                other = names[j]
                if other is None:
                    names[j] = mark
                    f[j] = zs[j] if zs[j] > v else v
                    push(heap, (f[j], j))
                elif other != mark:
                    over = f[j] if f[j] > v else v
                    pair = (mark, other) if mark < other else (other, mark)
                    if pair not in passes or over < passes[pair]:
                        passes[pair] = over
        line = at[own].tolist()
        inner = pd.DataFrame({"row": pdf.loc[own, "row"], "col": pdf.loc[own, "col"], "z": z[own], "f": np.array([f[k] for k in line], z.dtype), "a": np.array([names[k] for k in line], np.int64), "b": np.int64(0), "cell": True})
        # over the border: to each neighbour in another block, at the higher of the two
        grid, held = np.zeros((n, n), z.dtype), np.zeros((n, n), np.int64)
        grid[r, c], held[r, c] = z, np.where(own, 0, 1)
        number = np.zeros((n, n), np.int64)
        number[r, c] = node_
        edge = np.flatnonzero(border)
        over = [(node_[e], number[r[e] + dr, c[e] + dc], np.maximum(z[e], grid[r[e] + dr, c[e] + dc])) for dr, dc in NEIGHBOURS for e in [edge[held[r[edge] + dr, c[edge] + dc] == 1]]]
        beyond = dict(zip(node_[rim & border].tolist(), itertools.repeat(BEYOND)))
        pairs = [(p, q, w) for (p, q), w in passes.items()] + [(beyond.get(p, p), q, w) for a, b, o in over for p, q, w in zip(a.tolist(), b.tolist(), o.tolist(), strict=True)]
        graph = pd.DataFrame(pairs, columns=["a", "b", "f"]).astype({"a": "int64", "b": "int64", "f": z.dtype}).assign(row=0, col=0, z=np.zeros(1, z.dtype)[0], cell=False)
        # a neighbour at the rim goes by the name of what lies beyond; its own block says so
        rims = pd.DataFrame({"a": np.array(sorted(beyond), np.int64)}).assign(b=np.int64(BEYOND), f=np.array([zs[k] for k in at[rim & border][np.argsort(node_[rim & border])].tolist()], z.dtype), row=0, col=0, z=np.zeros(1, z.dtype)[0], cell=False)
        return pd.concat([inner, graph, rims])[["row", "col", "z", "f", "a", "b", "cell"]]

    local = checkpointed(by_block(around(cells.select("row", "col", "z"), block), "br", "bc").applyInPandas(kernel, f"row int, col int, z {kind}, f {kind}, a long, b long, cell boolean"))
    passes = local.where("NOT cell").select("a", "b", F.col("f").alias("w"))
    known = spilled(passes)
    inner = local.where("cell").select("row", "col", "z", "f", F.col("a").alias("node"))
    return checkpointed(inner.join(known, "node", "left").select("row", "col", "z", F.greatest("f", "level").alias("w")))


def spilled(passes: DataFrame) -> DataFrame:
    """(node, level) for catchments joined by `passes` (a, b, w): the least height of the highest pass on a way to BEYOND.

    Boruvka's rounds: every group of catchments takes its lowest pass, which all its members have to cross at least; what
    groups take gets lower along a chain of takings, so that one height is the level of the whole chain so far.
    """
    low = lambda rows: rows.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    edges = checkpointed(low(passes))
    known = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        order = F.struct("w", F.least("a", "b"), F.greatest("a", "b"))
        taken = checkpointed(both.where(F.col("a") != BEYOND).groupBy(F.col("a").alias("node")).agg(F.min_by("b", order).alias("to"), F.min("w").alias("w")))
        back = taken.select(F.col("node").alias("to"), F.col("to").alias("_back"))
        roots = ends(taken.join(back, "to", "left").select("node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to")))
        joined = taken.select("node", "w").join(roots, "node")
        if known is None:
            known = joined.select("node", F.col("root").alias("group"), F.col("w").alias("level"))
        else:
            after = joined.select(F.col("node").alias("group"), F.col("root").alias("_root"), F.col("w").alias("_w"))
            known = known.join(after, "group", "left").select("node", F.coalesce("_root", "group").alias("group"), F.greatest("level", "_w").alias("level"))
        known = checkpointed(known)
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = checkpointed(low(edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w")))
    return known.select("node", "level") if known is not None else edges.select(F.col("a").alias("node"), F.col("w").alias("level"))


def ends(pointers: DataFrame) -> DataFrame:
    """(node, root) for pointers (node, to) of trees whose roots point to themselves or have none: where each ends, by doubling."""
    state = checkpointed(pointers.select("node", F.col("to").alias("root")))
    while True:
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        after = checkpointed(state.join(ahead, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        if after.where("moved").limit(1).count() == 0:
            return state
        state = after.drop("moved")


def directions(filled: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = 256) -> DataFrame:
    """(row, col, f, node, down): down is the neighbour of the steepest descent, the first in order among equals, null without one."""
    reach = np.array([math.hypot(dr * dy, dc * dx) for dr, dc in NEIGHBOURS])[:, None]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        r, c = frame(pdf, block)
        grid = np.full((block + 4, block + 4), np.nan)
        grid[r, c] = pdf["f"] - pdf["f"].min()  # differences of whole elevations stay exact
        mine = pdf["own"].to_numpy()
        r, c, out = r[mine], c[mine], pdf.loc[mine, ["row", "col", "f"]].copy()
        descent = (grid[r, c] - np.stack([grid[r + dr, c + dc] for dr, dc in NEIGHBOURS])) / reach
        descent = np.where(np.isnan(descent), -np.inf, descent)
        choice = descent.argmax(axis=0)
        here = out["row"].to_numpy().astype(np.int64) * ROW + out["col"].to_numpy()
        target = here + np.array([dr * ROW + dc for dr, dc in NEIGHBOURS])[choice]
        out["node"] = here
        out["down"] = pd.array(target, dtype="Int64").copy()
        out.loc[descent.max(axis=0) <= 0, "down"] = pd.NA
        return out

    kind = dict(filled.dtypes)["f"]
    return by_block(around(filled.select("row", "col", "f"), block), "br", "bc").applyInPandas(kernel, f"row int, col int, f {kind}, node long, down long")


def in_block(node_: Column, block: int) -> Column:
    """The block of a node, as one number."""
    return F.floor(node_ / ROW / block).cast("long") * ROW + F.floor(F.pmod(node_, F.lit(ROW)) / block).cast("long")


def linked(node_: np.ndarray, down: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """For the cells of a block in order of `node_`: the place of the cell below each, -1 where that is none of them; and whether there is any below."""
    some = down.notna().to_numpy()
    to = down.fillna(-1).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(node_, to), len(node_) - 1)
    return np.where(some & (node_[at] == to), at, -1), some


def summed(below: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of all cells of a block that drain through each, itself included: level by level from the ridges down."""
    total = weight.copy()
    waiting = np.bincount(below[below >= 0], minlength=len(below))
    front = np.flatnonzero(waiting == 0)
    seen = 0
    while len(front):
        seen += len(front)
        front = front[below[front] >= 0]
        to = below[front]
        np.add.at(total, to, total[front])
        np.subtract.at(waiting, to, 1)
        to = np.unique(to)
        front = to[waiting[to] == 0]
    if seen < len(below):
        raise ValueError("the pointers have a cycle")
    return total


def last_of(below: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The last cell of each cell's way down within its block, or the first where `stop` holds."""
    at = np.arange(len(below))
    jump = np.where(stop | (below < 0), at, below)
    for _ in range(len(below).bit_length() + 1):
        ahead = jump[jump]
        if (ahead == jump).all():
            return jump
        jump = ahead
    raise ValueError("the pointers have a cycle")


def accumulation(edges: DataFrame, block: int = 256) -> DataFrame:
    """(node, down, acc): the cells that drain through each, itself included."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        below, _ = linked(pdf["node"].to_numpy(), pdf["down"])
        acc = summed(below, np.ones(len(pdf), np.int64))
        return pd.DataFrame({"node": pdf["node"], "down": pdf["down"].astype("Int64"), "acc": acc, "leaves": pdf["down"].astype("Int64")[last_of(below, np.zeros(len(pdf), bool))].to_numpy(), "_b": pdf["_b"]})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        below, _ = linked(pdf["node"].to_numpy(), pdf["down"])
        more = summed(below, pdf["more"].fillna(0).to_numpy().astype(np.int64))
        return pd.DataFrame({"node": pdf["node"], "down": pdf["down"].astype("Int64"), "acc": pdf["acc"] + more})

    ship(edges.sparkSession)
    keyed = edges.select("node", "down", in_block(F.col("node"), block).alias("_b"))
    local = checkpointed(by_block(keyed, "_b").applyInPandas(first, "node long, down long, acc long, leaves long, _b long"))
    entered = checkpointed(local.where(in_block(F.col("down"), block) != F.col("_b")).groupBy(F.col("down").alias("node")).agg(F.sum("acc").alias("weight")))
    if entered.limit(1).count() == 0:
        return local.select("node", "down", "acc")
    between = entered.join(local.select("node", F.col("leaves").alias("down")), "node")
    more = doubled_sums(between)
    return by_block(local.join(more, "node", "left").select("node", "down", "acc", "more", "_b"), "_b").applyInPandas(second, "node long, down long, acc long")


def doubled_sums(edges: DataFrame) -> DataFrame:
    """(node, more): the weights of all nodes whose pointers lead to each, itself included. A round doubles the reach of every
    pointer; nodes that have reached an end leave the joins."""
    state = edges.select("node", F.col("down").alias("jump"), F.col("weight").alias("more"))
    while True:
        state = checkpointed(state)
        open_ = state.where("jump IS NOT NULL")
        if open_.limit(1).count() == 0:
            return state.select("node", "more")
        gained = open_.groupBy(F.col("jump").alias("node")).agg(F.sum("more").alias("gain"))
        ahead = open_.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        moved = open_.join(ahead, "jump", "left").select("node", F.col("next").alias("jump"), "more").unionByName(state.where("jump IS NULL"))
        state = moved.join(gained, "node", "left").select("node", "jump", (F.col("more") + F.coalesce("gain", F.lit(0))).alias("more"))


def upstream(edges: DataFrame, outlets: DataFrame, block: int = 256) -> DataFrame:
    """(node, outlet): every cell that drains through an outlet (node), itself included; the first outlet on its way counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        node_, stop = pdf["node"].to_numpy(), pdf["mark"].to_numpy().astype(bool)
        below, _ = linked(node_, pdf["down"])
        last = last_of(below, stop)
        met = stop[last]
        outlet, leaves = pd.array(node_[last], dtype="Int64"), pdf["down"].astype("Int64").array[last].copy()
        outlet[~met], leaves[met] = pd.NA, pd.NA
        return pd.DataFrame({"node": node_, "outlet": outlet, "leaves": leaves})

    marks = outlets.select("node", F.lit(True).alias("mark")).distinct()
    ship(edges.sparkSession)
    keyed = edges.select("node", "down").join(marks, "node", "left").select("node", "down", F.coalesce("mark", F.lit(False)).alias("mark"), in_block(F.col("node"), block).alias("_b"))
    local = checkpointed(by_block(keyed, "_b").applyInPandas(run, "node long, outlet long, leaves long"))
    here = local.where("outlet IS NOT NULL").select("node", "outlet")
    leaving = local.where("leaves IS NOT NULL")
    state = checkpointed(leaving.select(F.col("leaves").alias("node")).distinct().join(local, "node").select("node", F.col("leaves").alias("jump"), "outlet"))
    while state.where("jump IS NOT NULL").limit(1).count():
        open_ = state.where("jump IS NOT NULL")
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("outlet").alias("met"))
        state = checkpointed(open_.join(ahead, "jump", "left").select("node", F.col("next").alias("jump"), F.col("met").alias("outlet")).unionByName(state.where("jump IS NULL")))
    entered = state.where("outlet IS NOT NULL").select(F.col("node").alias("leaves"), "outlet")
    return here.unionByName(leaving.select("node", "leaves").join(entered, "leaves").select("node", "outlet"))


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node, step): the way down from each start (node), itself first."""
    path = start.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("step"))
    jumps = edges.where("down IS NOT NULL").select("node", F.col("down").alias("jump"))
    for k in range(63):  # a grid has fewer cells than 2**63
        path, jumps = checkpointed(path), checkpointed(jumps)
        further = path.join(jumps, "node").select("start", F.col("jump").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        if further.limit(1).count() == 0:
            return path
        path = path.unionByName(further)
        ahead = jumps.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        jumps = jumps.join(ahead, "jump").select("node", F.col("next").alias("jump"))
    raise RuntimeError("downstream: the pointers have a cycle")


def drains_to(edges: DataFrame, pairs: DataFrame, block: int = 256) -> DataFrame:
    """`pairs` (source, target) with drains: whether the way down from source meets target; a cell meets itself.

    Pairs that ask about one target are answered by its basin; for several targets the ways down are joined.
    """
    targets = pairs.select("target").distinct().limit(2).collect()
    if len(targets) == 1:
        basin = upstream(edges, pairs.select(F.col("target").alias("node")).limit(1), block).select(F.col("node").alias("source"), F.lit(True).alias("_met"))
        return pairs.join(basin, "source", "left").select(*pairs.columns, F.col("_met").isNotNull().alias("drains"))
    ways = downstream(edges, pairs.select(F.col("source").alias("node")).distinct()).select(F.col("start").alias("source"), F.col("node").alias("target"), F.lit(True).alias("_met"))
    return pairs.join(ways, ["source", "target"], "left").select(*pairs.columns, F.col("_met").isNotNull().alias("drains"))


def main_channel(flow: DataFrame, outlet: int, threshold: int) -> DataFrame:
    """(node, step): the channel from an outlet up, each time to the child of most accumulation (the lowest number among
    equals) while that reaches the threshold. `flow` has node, down, acc."""
    channel = flow.where(F.col("down").isNotNull() & (F.col("acc") >= threshold))
    child = channel.groupBy("down").agg(F.max_by("node", F.struct("acc", -F.col("node"))).alias("node"))
    state = child.select("node", F.col("down").alias("jump"), F.lit(1).cast("long").alias("step"))
    for _ in range(64):
        state = checkpointed(state)
        open_ = state.where(F.col("jump") != outlet)
        if open_.limit(1).count() == 0:
            first = flow.where(F.col("node") == outlet).select("node", F.lit(0).cast("long").alias("step"))
            return first.unionByName(state.select("node", "step"))
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("step").alias("more"))
        state = state.where(F.col("jump") == outlet).unionByName(open_.join(ahead, "jump").select("node", F.col("next").alias("jump"), (F.col("step") + F.col("more")).alias("step")))
    raise RuntimeError("main channel: the pointers have a cycle")


def snap_candidates(flow: DataFrame, row: int, col: int, threshold: int, radius_m: float, dx: float, dy: float) -> DataFrame:
    """Channel cells near a point, in order of preference: by distance, then accumulation, row and column. `flow` has row, col, node, acc.

    Without a channel cell in reach, the cell of most accumulation in the window, with `fallback` true.
    """
    reach = max(1, math.ceil(radius_m / min(dx, dy)))
    near = flow.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach))
    near = near.withColumn("distance_m", F.hypot((F.col("row") - row) * F.lit(float(dy)), (F.col("col") - col) * F.lit(float(dx))))
    found = near.where((F.col("acc") >= threshold) & (F.col("distance_m") <= radius_m)).withColumn("fallback", F.lit(False))
    if found.limit(1).count() == 0:
        return near.orderBy(F.desc("acc"), "row", "col").limit(1).withColumn("fallback", F.lit(True)).withColumn("place", F.lit(1))
    return found.withColumn("place", F.row_number().over(W.orderBy("distance_m", F.desc("acc"), "row", "col")))  # a window of radius_m: bounded


def ring(mask: DataFrame, block: int = 256) -> list[tuple[int, int]]:
    """The outline of a cell set (row, col) as corner points (col, row): of its largest part of cells that share sides, holes
    left out. Only that ring comes to the driver."""
    from . import masks

    best = masks.outlines(mask, block).where("twice > 0").orderBy(F.desc("twice"), "label").limit(1).first()
    return [(p["x"], -p["y"]) for p in best["points"]] if best else []


def dilated(mask: DataFrame, radius: float) -> DataFrame:
    """The cells within `radius` cells of a cell set."""
    k = math.floor(radius)
    steps = [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1) if math.hypot(r, c) <= radius]
    inner = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps])
    return mask.select("row", "col", F.explode(inner).alias("s")).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()


@dataclasses.dataclass
class Delineation:
    outlet: tuple[int, int]
    shift_m: float
    area_km2: float
    edge_cells: int
    headwater_drains: bool | None
    outlet_z: float
    mask: DataFrame
    channel: DataFrame
    warnings: list[str]
    origin: tuple[float, float] = (0.0, 0.0)
    cell: float = 1.0

    @property
    def truncated(self) -> bool:
        return self.edge_cells > 0

    def polygon(self) -> list[tuple[float, float]]:
        """The basin's outline in the grid's coordinates."""
        return [(self.origin[0] + c * self.cell, self.origin[1] - r * self.cell) for c, r in ring(self.mask)]

    def channel_points(self) -> DataFrame:
        """(step, x, y): the main channel's cell centres from the outlet up."""
        r, c = F.floor(F.col("node") / ROW), F.pmod("node", F.lit(ROW))
        return self.channel.select("step", (self.origin[0] + (c + 0.5) * self.cell).alias("x"), (self.origin[1] - (r + 0.5) * self.cell).alias("y"))


@dataclasses.dataclass(frozen=True)
class Grid:
    """Where cells lie: the north-west corner and the size of a cell, rows going south."""

    origin: tuple[float, float]
    cell: float

    def place(self, point: tuple[float, float]) -> tuple[int, int]:
        return math.floor((self.origin[1] - point[1]) / self.cell), math.floor((point[0] - self.origin[0]) / self.cell)

    def centre(self, row: int, col: int) -> tuple[float, float]:
        return self.origin[0] + (col + 0.5) * self.cell, self.origin[1] - (row + 0.5) * self.cell


#: What a delineation may warn of, by name, in the order of its report.
NOTES = {
    "fallback": "no channel in reach of the outlet: the cell of most accumulation was taken",
    "outside": "the headwater is outside the grid",
    "apart": "the headwater does not drain to the outlet",
    "low": "the headwater is not above the outlet",
}


def met_on_the_way(arrows: DataFrame, start: int, candidates: list) -> object | None:
    """The most preferred candidate cell that the way down from `start` meets."""
    spark = arrows.sparkSession
    asked = spark.createDataFrame([(start, c["node"]) for c in candidates], "source long, target long")
    met = {r["target"] for r in drains_to(arrows, asked).where("drains").collect()}
    return next((c for c in candidates if c["node"] in met), None)


def delineate(cells: DataFrame, origin: tuple[float, float], cell: float, outlet: tuple[float, float], headwater: tuple[float, float] | None = None, channel_km2: float = 0.1, snap_m: float = 150.0, block: int = 256) -> Delineation:
    """The basin that drains through an outlet (x, y) over a grid whose north-west corner is `origin`, rows going south."""
    grid, notes = Grid(origin, cell), set()
    spots = {"outlet": grid.place(outlet)} | ({"headwater": grid.place(headwater)} if headwater else {})
    wanted = [(F.col("row") == r) & (F.col("col") == c) for r, c in spots.values()]
    heights = {(r["row"], r["col"]): r["z"] for r in cells.where(functools.reduce(operator.or_, wanted)).collect()}
    if spots["outlet"] not in heights:
        raise ValueError("the outlet is outside the grid or on a cell without data")
    arrows = checkpointed(directions(fill(cells, block), cell, cell, block))
    flow = checkpointed(placed(accumulation(arrows, block)))
    threshold = max(2, round(channel_km2 * 1e6 / cell**2))
    near = snap_candidates(flow, *spots["outlet"], threshold, snap_m, cell, cell).orderBy("place").collect()
    notes |= {"fallback"} if near[0]["fallback"] else set()
    chosen, drains = near[0], None
    if headwater and spots["headwater"] not in heights:
        notes.add("outside")
    elif headwater:
        r, c = spots["headwater"]
        found = met_on_the_way(arrows, r * ROW + c, near)
        drains, chosen = found is not None, found or chosen
    here = (chosen["row"], chosen["col"])
    z = heights[here] if here in heights else cells.where((F.col("row") == here[0]) & (F.col("col") == here[1])).first()["z"]
    notes |= {"apart"} if drains is False else {"low"} if drains and heights[spots["headwater"]] <= z else set()
    basin = upstream(arrows, flow.where(F.col("node") == chosen["node"]).select("node"), block)
    mask = checkpointed(basin.join(arrows.select("node", "row", "col"), "node").select("node", "row", "col"))
    return Delineation(
        here, math.dist(grid.centre(*here), outlet), mask.count() * cell**2 / 1e6, mask.join(seeds(cells, block), ["row", "col"], "left_semi").count(), drains, float(z), mask,
        main_channel(flow, chosen["node"], threshold), [text for name, text in NOTES.items() if name in notes], origin, cell,
    )
