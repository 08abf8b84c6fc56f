"""Joins of two tables of features by place.

A feature (id, kind, parts) lies on a level of square cells, of a size that suits its own extent and number of points, and
is cut up by them: a cell holds the edges that pass it, the points that lie in it and, for polygons, whether its
south-west corner is inside. Two features meet on the coarser of their levels, by an equality join on cells, and are
tested there with what the cell holds. A feature of many points is so spread over many cells, and no row carries it whole.
A polygon has several cells a side, more where it is larger than most, so that most of what shares a cell with it does meet
it: cells without its edges, and corners inside both of two polygons, answer without a test of edges.

Features of one kind and equal parts are cut up and tested as one row, which carries their numbers; pairs of numbers are
made last. Where both have few points, and neither is a point, a cell holds them whole, and a pair is tested in one cell:
that of the south-west corner of what their bounds have in common. A point lies in one cell of a level anyway. So only
pairs of features of many points are found in several cells and gathered.

What meets: polygons all; lines lines and polygons; points polygons. A point is in a polygon where it is inside an odd
number of its rings (on a border it may go either way); borders that touch do meet, but for edges that lie on one line.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geom
from ..session import checkpointed, ship, spread

#: Where the cells' corners lie within a cell's size, off the places where coordinates tend to be round.
OFF_X, OFF_Y = 0.381966011, 0.171572875
MOST, POINTS_A_CELL = 256, 8
#: Cells along the side of a polygon: of the usual extent, and at most for larger ones of few points.
USUAL, LARGE = 4.0, 16.0
POINT_LEVEL = -40
#: Points of a feature that a cell holds whole, features of one shape that a row stands for, rows a task.
FEW, COPIES, ROWS = 64, 64, 2000
#: Features of a cell that come to a worker as one row, pairs that it looks at together, numbers on the right of a found row.
BUNDLE, PAIRS, NUMBERS = 256, 100_000, 256
#: Shapes that meet, by the numbers of their features; `same` where it is one row of one table.
MET = ["left_ids", "right_ids", "same"]


def step(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def column_of(x: Column, size: Column) -> Column:
    return F.floor(x / size + OFF_X).cast("long")


def row_of(y: Column, size: Column) -> Column:
    return F.floor(y / size + OFF_Y).cast("long")


def levelled(features: DataFrame) -> DataFrame:
    """`features` (id, kind, parts, perhaps more) with their bounds `b`, number of points `n` and `own`: the level on which a feature is cut into
    about as many cells as it has groups of points, a polygon into some more."""
    points = geom.let(F.flatten("parts"), lambda r: F.struct(geom.bounds(r).alias("b"), F.size(r).alias("n")))
    known = features.select(*features.columns, points.alias("p"))
    b, n = F.col("p.b"), F.col("p.n")
    extent = F.greatest(b["east"] - b["west"], b["north"] - b["south"])
    known = checkpointed(known.where(n > 0).select(*features.columns, "p.b", "p.n", extent.alias("extent")))
    usual = known.where("kind = 'polygon' AND extent > 0").agg(F.percentile_approx("extent", 0.5)).first()[0] or 1.0
    least = F.when(F.col("kind") == "polygon", F.greatest(F.lit(USUAL), F.least(F.lit(LARGE), USUAL * F.col("extent") / usual))).otherwise(1.0)
    cells = F.greatest(least, F.least(F.lit(float(MOST)), F.col("n") / POINTS_A_CELL))
    return known.select(*features.columns, "b", "n", F.when((F.col("kind") == "point") | (F.col("extent") <= 0), F.lit(POINT_LEVEL)).otherwise(F.ceil(F.log2(F.col("extent") / cells))).cast("int").alias("own"))


def in_cells(features: DataFrame, levels: list[int]) -> DataFrame:
    """(id, kind, own, b, level, cx, cy, edges, spots, inside): each feature on its own level and on the coarser ones of `levels`."""
    placed = features.select("id", "kind", "own", "b", "parts", F.explode(F.array_distinct(F.concat(F.array("own"), F.filter(F.array(*map(F.lit, levels)), lambda v: v > F.col("own"))) if levels else F.array("own"))).alias("level"))
    # the size, the bounds of an edge in a column of cells: columns of their own, as long expressions are not compiled
    placed = placed.withColumn("size", step(F.col("level")))
    keys = ["id", "kind", "own", "b", "level", "size"]
    size = F.col("size")
    closed = F.col("kind") == "polygon"
    lines = placed.where("kind <> 'point'").select(*keys, F.explode("parts").alias("line")).select(*keys, F.explode(F.when(closed, geom.edges(F.col("line"))).otherwise(geom.edges(F.col("line"), False))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    slack = size * 1e-9
    across = lines.withColumn("cx", F.explode(F.sequence(column_of(F.least(a["x"], b["x"]) - slack, size), column_of(F.greatest(a["x"], b["x"]) + slack, size))))
    west = (F.col("cx") - OFF_X) * size
    into = lambda x: F.greatest(F.least(a["x"], b["x"]), F.least(F.greatest(a["x"], b["x"]), x))
    at = lambda x: F.when(a["x"] == b["x"], None).otherwise(a["y"] + (into(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) * (b["y"] - a["y"]))
    ends = across.select(*keys, "cx", "e", F.coalesce(at(west - slack), a["y"]).alias("first"), F.coalesce(at(west + size + slack), b["y"]).alias("last"))
    passed = ends.withColumn("cy", F.explode(F.sequence(row_of(F.least("first", "last") - slack, size), row_of(F.greatest("first", "last") + slack, size)))).select(*keys, "cx", "cy", F.col("e").alias("edge"))
    spot = placed.select(*keys, F.explode(F.flatten("parts")).alias("spot")).select(*keys, column_of(F.col("spot.x"), size).alias("cx"), row_of(F.col("spot.y"), size).alias("cy"), "spot")
    # Rows of cells whose south side is crossed: every second stretch between crossings is inside.
    lowest, highest = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    crossed = lines.where("kind = 'polygon'").where(lowest < highest).select(*keys, "e", F.explode(F.sequence(row_of(lowest, size), row_of(highest, size) + 1)).alias("cy"))
    south = (F.col("cy") - OFF_Y) * size
    xs = crossed.where((a["y"] > south) != (b["y"] > south)).select(*keys, "cy", ((b["x"] - a["x"]) * ((south - a["y"]) / (b["y"] - a["y"])) + a["x"]).alias("x"))
    stretch = xs.groupBy(*keys, "cy").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("from"), F.get("xs", 2 * i + 1).alias("to")))
    first, last = (F.ceil(F.col("s.from") / size + OFF_X).cast("long"), F.floor(F.col("s.to") / size + OFF_X).cast("long"))
    inner = stretch.select(*keys, "cy", F.explode(pairs).alias("s")).where(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("cx"), "cy", F.lit(1).alias("inside"))
    no_edge, no_spot = F.lit(None).cast(dict(passed.dtypes)["edge"]), F.lit(None).cast(dict(spot.dtypes)["spot"])
    rows = passed.select(*keys, "cx", "cy", "edge", no_spot.alias("spot"), F.lit(0).alias("inside"))
    rows = rows.unionByName(spot.select(*keys, "cx", "cy", no_edge.alias("edge"), "spot", F.lit(0).alias("inside"))).unionByName(inner.select(*keys, "cx", "cy", no_edge.alias("edge"), no_spot.alias("spot"), "inside"))
    return rows.groupBy(*keys, "cx", "cy").agg(F.collect_list("edge").alias("edges"), F.collect_list("spot").alias("spots"), (F.max("inside") == 1).alias("inside"))


def crossed_before(west: Column, south: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """How often an edge is crossed from a cell's corner up to a point's height, then across to it."""
    up = a["y"] + F.coalesce(F.try_divide(west - a["x"], b["x"] - a["x"]), F.lit(0.0)) * (b["y"] - a["y"])
    across = (b["x"] - a["x"]) * F.coalesce(F.try_divide(y - a["y"], b["y"] - a["y"]), F.lit(0.0)) + a["x"]
    return F.when(((a["x"] > west) != (b["x"] > west)) & (up > south) & (up <= y), 1).otherwise(0) + F.when(((a["y"] > y) != (b["y"] > y)) & (across > west) & (across <= x), 1).otherwise(0)


def holds(edges: Column, corner_inside: Column, west: Column, south: Column, p: Column) -> Column:
    """Whether a point of a cell is in a polygon: from the cell's corner up to the point's height, then across, counting edges."""
    return F.aggregate(edges, corner_inside.cast("int"), lambda s, e: s + crossed_before(west, south, p["x"], p["y"], e["a"], e["b"])) % 2 == 1


def gathered(features: DataFrame) -> DataFrame:
    """(id, ids, kind, parts): up to COPIES features of one kind and equal parts as a row with a number of its own."""
    placed = spread(features, "kind", "parts").select("id", "kind", "parts", F.floor((F.row_number().over(W.partitionBy("kind", "parts").orderBy("id")) - 1) / COPIES).alias("_group"))
    # a list leaves out nulls, but not structs of them
    rows = placed.groupBy("kind", "parts", "_group").agg(F.collect_list(F.struct("id")).alias("ids"))
    return rows.select(F.monotonically_increasing_id().alias("id"), F.transform("ids", lambda s: s["id"]).alias("ids"), "kind", "parts")


def shapes(features: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Gathered features on their levels with `how`: point, few or many points; and how many there are of each."""
    finite = (F.col("b.east") - F.col("b.west") < float("inf")) & (F.col("b.north") - F.col("b.south") < float("inf"))
    how = F.when((F.col("kind") == "point") & (F.col("n") == 1), "point").when((F.col("kind") != "point") & (F.col("n") <= FEW) & finite, "few").otherwise("many")
    known = levelled(gathered(features)).withColumn("how", how)
    return known, {r["how"]: r["count"] for r in known.groupBy("how").count().collect()}


def levels(rows: DataFrame) -> list[int]:
    """Whole numbers between POINT_LEVEL and some fifty: a bounded list."""
    return sorted(r["own"] for r in rows.select("own").distinct().collect() if r["own"] is not None)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """`rows` by cell in tasks that suit `n` features: little data, but many pairs."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * (n // (ROWS * cores) + 1), "level", "cx", "cy")


def points_within(polygons: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """MET: polygons and the single points in them, each pair once."""
    west, south, size = (F.col("cx") - OFF_X) * F.col("size"), (F.col("cy") - OFF_Y) * F.col("size"), step(F.col("level"))
    cells = checkpointed(in_cells(polygons, []).select("id", "level", "cx", "cy", west.alias("west"), south.alias("south"), "inside", "edges"))
    spot = points.select("ids", F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("p"), F.explode(F.array(*map(F.lit, levels(polygons))).cast("array<int>")).alias("level"))
    spot = spot.select(F.col("ids").alias("right_ids"), "p.x", "p.y", "level", column_of(F.col("p.x"), size).alias("cx"), row_of(F.col("p.y"), size).alias("cy"))

    def met(cells: DataFrame, *columns: Column | str) -> DataFrame:
        left = cells.join(polygons.select("id", "ids"), "id").select("level", "cx", "cy", F.col("ids").alias("left_ids"), F.lit(False).alias("same"), *columns)
        return dealt(left, n).join(dealt(spot, n), ["level", "cx", "cy"])

    # Most cells have one edge or none: what tests them has no lambdas, and so is compiled.
    none, one, more = (cells.where(f"size(edges) {size}") for size in ("= 0", "= 1", "> 1"))
    x, y, west, south = (F.col(c) for c in ("x", "y", "west", "south"))
    none = met(none.where("inside"))
    one = met(one, "inside", "west", "south", F.col("edges")[0]["a"].alias("a"), F.col("edges")[0]["b"].alias("b")).where((F.col("inside").cast("int") + crossed_before(west, south, x, y, F.col("a"), F.col("b"))) % 2 == 1)
    more = met(more, "inside", "west", "south", "edges").where(holds(F.col("edges"), F.col("inside"), west, south, F.struct("x", "y")))
    return none.select(*MET).unionByName(one.select(*MET)).unionByName(more.select(*MET))


def touching(left: dict, right: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether features `i` of the left meet features `j` of the right, by the same sums as `geom.contains` and `geom.cross`."""
    starts, values = [side["edges"].offsets.to_numpy() for side in (left, right)], [side["edges"].values.to_numpy(zero_copy_only=False) for side in (left, right)]
    closed = left["closed"][i], right["closed"][j]
    n, m = (((s[of + 1] - s[of]) // 4).astype(int) for s, of in zip(starts, (i, j), strict=True))
    found = np.zeros(len(i), bool)

    def held(e, f):
        """Whether a ring of edges holds the start of another edge."""
        ax, ay, bx, by = (e[:, None, k] for k in range(4))
        px, py = f[None, :, 0], f[None, :, 1]
        hit = ((ay > py) != (by > py)) & (px < (bx - ax) * ((py - ay) / (by - ay)) + ax)
        return np.logical_xor.reduce(hit, axis=0).any(axis=0)

    def crossing(e, f):
        a, b, c, d = (e[:, None, 0], e[:, None, 1]), (e[:, None, 2], e[:, None, 3]), (f[None, :, 0], f[None, :, 1]), (f[None, :, 2], f[None, :, 3])
        side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        first, second = side(a, b, c), side(a, b, d)
        return ((first * second <= 0) & (side(c, d, a) * side(c, d, b) <= 0) & ((first != 0) | (second != 0))).any(axis=(0, 1))

    with np.errstate(all="ignore"):
        sizes = n * (FEW + 1) + m
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            k, q = int(size) // (FEW + 1), int(size) % (FEW + 1)
            at_once = max(16, 131072 // max(1, k * q))
            for at in range(0, len(rows), at_once):
                some = rows[at : at + at_once]
                e, f = (v[s[of[some]][None, :] + np.arange(4 * c)[:, None]].reshape(c, 4, -1) for v, s, of, c in zip(values, starts, (i, j), (k, q), strict=True))
                # each test sees only what those before it left open; the first is quick and settles most
                tests = [
                    lambda e, f, o: held(e, f[:1]) & closed[0][o],
                    lambda e, f, o: held(e, f[1:]) & closed[0][o],
                    lambda e, f, o: held(f, e) & closed[1][o],
                    lambda e, f, o: crossing(e, f),
                ]
                for test in tests:
                    hit = test(e, f, some)
                    found[some[hit]] = True
                    some, e, f = some[~hit], e[..., ~hit], f[..., ~hit]
                    if not len(some):
                        break
    return found


def met_in_cells(batches: Iterator[pa.RecordBatch], alike: bool) -> Iterator[pa.RecordBatch]:
    """MET of rows (level, cx, cy, size, left, right): a bundle of features of either side that share a cell."""

    def side(column: pa.ListArray) -> dict:
        rows = column.values
        fields = {rows.type.field(k).name: rows.field(k) for k in range(rows.type.num_fields)}
        return {"starts": column.offsets.to_numpy()} | {c: v if c in ("ids", "edges") else v.to_numpy(zero_copy_only=False) for c, v in fields.items()}

    for batch in batches:
        left, right = side(batch.column("left")), side(batch.column("right"))
        level, cx, cy, size = (batch.column(c).to_numpy() for c in ("level", "cx", "cy", "size"))
        n, m = (np.diff(s["starts"]).astype(int) for s in (left, right))
        total = np.cumsum(n * m)
        first = 0
        while first < len(total):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
            rows = np.arange(first, last)
            row = np.repeat(rows, (n * m)[rows])
            k = np.arange(len(row)) - np.repeat(total[rows] - (n * m)[rows] - (total[first - 1] if first else 0), (n * m)[rows])
            i, j = left["starts"][row] + k // m[row], right["starts"][row] + k % m[row]
            first = last
            for near in (
                lambda: (left["west"][i] <= right["east"][j]) & (right["west"][j] <= left["east"][i]),
                lambda: (left["south"][i] <= right["north"][j]) & (right["south"][j] <= left["north"][i]),
                lambda: ((right["own"][j] < level[row]) | (left["id"][i] <= right["id"][j])) if alike else (left["own"][i] == level[row]) | (right["own"][j] == level[row]),
                lambda: np.floor(np.maximum(left["west"][i], right["west"][j]) / size[row] + OFF_X) == cx[row],
                lambda: np.floor(np.maximum(left["south"][i], right["south"][j]) / size[row] + OFF_Y) == cy[row],
                lambda: left["closed"][i] | right["closed"][j] | (left["line"][i] & right["line"][j]),
                lambda: touching(left, right, i, j),
            ):
                kept = near()
                row, i, j = row[kept], i[kept], j[kept]
            same = left["id"][i] == right["id"][j] if alike else np.zeros(len(i), bool)
            yield pa.RecordBatch.from_arrays([left["ids"].take(pa.array(i[same])), right["ids"].take(pa.array(j[same])), pa.array(same[same])], MET)
            i, j = i[~same], j[~same]
            if len(i):
                # the numbers on the right of each feature on the left, one after another, in pieces
                starts = right["ids"].offsets.to_numpy().astype(int)
                much = starts[j + 1] - starts[j]
                ends = np.cumsum(much)
                numbers = right["ids"].values.take(pa.array(np.repeat(starts[j] - ends + much, much) + np.arange(ends[-1])))
                groups = np.flatnonzero(np.diff(i, prepend=-1))
                begin = (ends - much)[groups]
                pieces = -(-np.diff(begin, append=ends[-1]) // NUMBERS)
                of = np.repeat(np.arange(len(groups)), pieces)
                cuts = begin[of] + NUMBERS * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, ends[-1]), pa.int32()), numbers)
                yield pa.RecordBatch.from_arrays([left["ids"].take(pa.array(i[groups][of])), lists, pa.array(np.zeros(len(of), bool))], MET)


def whole(rows: DataFrame, coarser: list[int]) -> DataFrame:
    """Features of few points on their own level and those of `coarser` above it: in all cells that their bounds meet."""
    point = lambda p, q: F.array(p["x"], p["y"], q["x"], q["y"])
    ends = lambda line: F.when(F.col("kind") == "polygon", geom.following(line)).otherwise(F.concat(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, -1, 1)))
    edges = F.flatten(F.transform("parts", lambda line: F.flatten(F.when(F.size(line) > 0, F.zip_with(line, ends(line), point)).otherwise(F.array().cast("array<array<double>>")))))
    above = F.filter(F.array(*map(F.lit, coarser)).cast("array<int>"), lambda v: v > F.col("own"))
    placed = rows.select("id", "ids", "kind", "b", "own", edges.alias("edges"), F.explode(F.array_distinct(F.concat(F.array("own"), above))).alias("level"))
    across, up = ([of(F.col(f"b.{side}"), F.col("size")) for side in sides] for of, sides in ((column_of, ("west", "east")), (row_of, ("south", "north"))))
    return placed.withColumn("size", step(F.col("level"))).withColumn("cx", F.explode(F.sequence(*across))).withColumn("cy", F.explode(F.sequence(*up)))


def bundled(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(level, cx, cy, size, `name`): the features of a cell as lists of up to BUNDLE."""
    placed = dealt(rows, n).withColumn("_group", F.floor((F.row_number().over(W.partitionBy("level", "cx", "cy").orderBy("id")) - 1) / BUNDLE))
    feature = F.struct("id", "ids", (F.col("kind") == "polygon").alias("closed"), (F.col("kind") == "line").alias("line"), "b.west", "b.south", "b.east", "b.north", "own", "edges")
    return placed.groupBy("level", "cx", "cy", "size", "_group").agg(F.collect_list(feature).alias(name)).drop("_group")


def few_meeting(a: DataFrame, b: DataFrame, n: int, alike: bool) -> DataFrame:
    """MET: features of few points that meet, each pair once; if the tables are `alike`, also only one way round."""
    # cells twice as large as where features are cut up: they are taken whole
    a, b = (rows.withColumn("own", F.when(F.col("own") == POINT_LEVEL, POINT_LEVEL).otherwise(F.col("own") + 1)) for rows in (a, b))
    left, right = bundled(whole(a, [] if alike else levels(b)), n, "left"), bundled(whole(b, levels(a)), n, "right")
    both = left.join(right.drop("size"), ["level", "cx", "cy"]).select("level", "cx", "cy", "size", "left", "right")
    ship(a.sparkSession)
    kinds = [dict(rows.dtypes)["ids"] for rows in (a, b)]
    return both.mapInArrow(functools.partial(met_in_cells, alike=alike), f"left_ids {kinds[0]}, right_ids {kinds[1]}, same boolean")


def cut_meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_id, right_id): features that meet, tested by what each cell holds of them; pairs are gathered from all cells that they share."""
    # Levels are whole numbers between POINT_LEVEL and some fifty: a bounded list.
    of = {side: levels(rows.where("kind <> 'point'")) for side, rows in (("a", a), ("b", b))}
    own = F.col("own") == F.col("level")
    named = lambda rows, n: rows.select("level", "cx", "cy", own.alias(f"{n}_own"), F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in ("kind", "b", "edges", "spots", "inside")])
    both = named(in_cells(a, of["b"]), "left").join(named(in_cells(b, of["a"]), "right"), ["level", "cx", "cy"])
    near = [F.col(f"{n}_b.{lo}") <= F.col(f"{o}_b.{hi}") for n, o in (("left", "right"), ("right", "left")) for lo, hi in (("west", "east"), ("south", "north"))]
    met = both.where("(left_own OR right_own) AND (left_kind = 'polygon' OR right_kind = 'polygon' OR (left_kind = 'line' AND right_kind = 'line'))").where(near[0] & near[1] & near[2] & near[3])
    west, south = (F.col("cx") - OFF_X) * step(F.col("level")), (F.col("cy") - OFF_Y) * step(F.col("level"))
    held = lambda n, o: F.exists(F.col(f"{o}_spots"), lambda p: holds(F.col(f"{n}_edges"), F.col(f"{n}_inside"), west, south, p))
    inside = lambda n, o: F.when((F.col(f"{n}_kind") != "polygon") | (F.size(f"{o}_spots") == 0), False).when(F.size(f"{n}_edges") == 0, F.col(f"{n}_inside")).otherwise(held(n, o))
    crossing = F.when((F.size("left_edges") == 0) | (F.size("right_edges") == 0), False).otherwise(F.exists("left_edges", lambda e: F.exists("right_edges", lambda f: geom.cross(e["a"], e["b"], f["a"], f["b"]))))
    # a corner inside two polygons, or what passes a cell that is inside as a whole, is common to both
    within = lambda n, o: (F.col(f"{n}_kind") == "polygon") & F.col(f"{n}_inside") & (F.col(f"{o}_inside") | ((F.size(f"{n}_edges") == 0) & (F.size(f"{o}_spots") > 0)))
    pairs = met.where(F.when(within("left", "right") | within("right", "left"), True).otherwise(inside("left", "right") | inside("right", "left") | crossing)).select("left_id", "right_id")
    return pairs.distinct()


def meeting(left: DataFrame, right: DataFrame, ascending: bool = False) -> DataFrame:
    """(left_id, right_id): the pairs of features of two tables (id, kind, parts) that meet; with `ascending` those whose left number is the smaller.
    One table as both sides, `ascending`, is cut up once, and each pair is tested one way round."""
    alike = ascending and left is right
    a, of_a = shapes(left)
    b, of_b = (a, of_a) if alike else shapes(right)
    n = sum(of_a.values()) + sum(of_b.values())
    only = lambda rows, *how: rows.where(F.col("how").isin(*how))
    polygons = lambda rows: rows.where("how <> 'point' AND kind = 'polygon'")
    swapped = lambda pairs: pairs.select(F.col("right_ids").alias("left_ids"), F.col("left_ids").alias("right_ids"), "same")
    with_ids = lambda pairs: pairs.join(a.select(F.col("id").alias("left_id"), F.col("ids").alias("left_ids")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("ids").alias("right_ids")), "right_id").select("left_ids", "right_ids", (F.col("left_id") == F.col("right_id")).alias("same"))
    shaped = lambda of: of.keys() - {"point"}
    found = []
    if "point" in of_b and shaped(of_a):
        found.append(points_within(polygons(a), only(b, "point"), n))
    if "point" in of_a and shaped(of_b) and not alike:
        found.append(swapped(points_within(polygons(b), only(a, "point"), n)))
    if "few" in of_a and "few" in of_b:
        found.append(few_meeting(only(a, "few"), only(b, "few"), n, alike))
    if "many" in of_a and shaped(of_b):
        cut = cut_meeting(only(a, "many"), only(b, "few", "many"))
        found.append(with_ids(cut.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct() if alike else cut))
    if "many" in of_b and "few" in of_a and not alike:
        found.append(with_ids(cut_meeting(only(a, "few"), only(b, "many"))))
    if not found:
        return left.limit(0).select(F.col("id").alias("left_id")).crossJoin(right.limit(0).select(F.col("id").alias("right_id")))
    rows = functools.reduce(DataFrame.unionByName, found)
    pairs = rows.select("same", F.explode("left_ids").alias("left_id"), "right_ids").select("same", "left_id", F.explode("right_ids").alias("right_id"))
    if alike:
        pairs = pairs.where((F.col("left_id") < F.col("right_id")) | (~F.col("same") & (F.col("left_id") > F.col("right_id")))).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    else:
        pairs = (pairs.where("left_id < right_id") if ascending else pairs).select("left_id", "right_id")
    return pairs if single(left) and single(right) else pairs.distinct()


def single(features: DataFrame) -> bool:
    """Whether each number is given once."""
    return not features.groupBy("id").count().where("count > 1").limit(1).count()


def once(polygons: DataFrame, points: DataFrame) -> bool:
    """Whether each pair shares one cell only: single points against polygons, each number given once."""
    if polygons.where("kind <> 'polygon'").limit(1).count() or points.where("kind <> 'point' OR n > 1").limit(1).count():
        return False
    return single(polygons) and single(points)
