"""Polygons laid over one another: buffers, unions, intersections and differences of rings of any shape.

Edges are a table (shape, layer, x0, y0, x1, y1) in whole grid units, so every test of a side is exact. The overlay goes
in four steps, each a join on small keys:

1. edges that share a cell of a grid over their shape are tested against each other and cut where they meet, until no
   rounded crossing makes another;
2. equal pieces become one with the sum of their directions, by layer;
3. the winding number beside each piece is the sum over the pieces below its middle, found by strips;
4. pieces with the wanted region on one side only are its border: each is followed by the piece that turns off first at
   its end, and pointer doubling ranks the pieces of each ring.

So a ring is never walked by one process, and a shape of many edges is spread over the cluster. Shapes of few edges take the
same steps many at a time within a task (`compact.py`), without joins. Coordinates of a shape
may span up to 2**30 units: with the unit of 2**-10 that is 1000 km of metres; beyond it Spark reports an overflow.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..session import checkpointed, ship, spread
from . import compact

#: Grid units of metres, and of degrees.
METRES, DEGREES = 2.0**-10, 2.0**-22
ENDS = ("x0", "y0", "x1", "y1")


def edges_of(shapes: DataFrame, parts: Column, layer: int | Column = 0, unit: float = METRES) -> DataFrame:
    """The edges of `shapes` (shape; `parts`: an array of rings), in grid units; those without length are left out."""
    snap = lambda v: F.round(v / unit).cast("long")
    each = shapes.select("shape", F.lit(layer).alias("layer"), F.explode(parts).alias("r")).select("shape", "layer", F.explode(geom.edges(F.col("r"))).alias("e"))
    return each.select("shape", "layer", *[snap(F.col(f"e.{p}.{c}")).alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"]).where("x0 <> x1 OR y0 <> y1")


def side(a: str, b: str, p: str) -> Column:
    """Positive where point `p` is left of the line from `a` to `b`, zero on it. Names are prefixes and numbers, as in p0."""
    x, y = (lambda n: F.col(f"{n[0]}x{n[1]}")), (lambda n: F.col(f"{n[0]}y{n[1]}"))
    return (x(b) - x(a)) * (y(p) - y(a)) - (y(b) - y(a)) * (x(p) - x(a))


def extents(edges: DataFrame) -> DataFrame:
    """Per shape: its west side and width, and how many edges it has."""
    lo, hi = lambda c: F.min(F.least(f"{c}0", f"{c}1")), lambda c: F.max(F.greatest(f"{c}0", f"{c}1"))
    return edges.groupBy("shape").agg(lo("x").alias("west"), lo("y").alias("south"), (hi("x") - lo("x")).alias("width"), (hi("y") - lo("y")).alias("height"), F.count("*").alias("n"))


def in_cells(edges: DataFrame) -> DataFrame:
    """`edges` (id and ends) once for each grid cell they pass, with a unit to spare: columns cx and cy."""
    about = extents(edges).select("shape", "west", "south", F.greatest(F.lit(4), F.ceil(F.greatest("width", "height") / F.least(F.lit(4096), F.greatest(F.lit(1.0), 2 * F.sqrt("n"))))).cast("long").alias("cell"))
    placed = edges.join(about, "shape")
    column = lambda v: F.floor((v - F.col("west")) / F.col("cell")).cast("int")
    row = lambda v: F.floor((v - F.col("south")) / F.col("cell")).cast("int")
    across = placed.withColumn("cx", F.explode(F.sequence(column(F.least("x0", "x1") - 1), column(F.greatest("x0", "x1") + 1))))
    at = lambda x: F.col("y0") + (F.greatest(F.least("x0", "x1"), F.least(F.greatest("x0", "x1"), x)) - F.col("x0")) * ((F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0)))
    left = F.col("west") + F.col("cx") * F.col("cell")
    ends = [F.coalesce(at(left - 1), F.col("y0")), F.coalesce(at(left + F.col("cell") + 1), F.col("y1"))]
    return across.withColumn("cy", F.explode(F.sequence(row(F.least(*ends) - 1), row(F.greatest(*ends) + 1)))).select("shape", "id", *ENDS, "cx", "cy")


def meetings(edges: DataFrame) -> DataFrame:
    """(id, t, x, y): where edges are met by others between their ends, t growing along the edge."""
    cells = in_cells(edges)
    a = cells.select("shape", "cx", "cy", *[F.col(c).alias(f"a{c}") for c in ("id", *ENDS)])
    b = cells.select("shape", "cx", "cy", *[F.col(c).alias(f"b{c}") for c in ("id", *ENDS)])
    near = [F.least(f"a{c}0", f"a{c}1") <= F.greatest(f"b{c}0", f"b{c}1") for c in "xy"] + [F.least(f"b{c}0", f"b{c}1") <= F.greatest(f"a{c}0", f"a{c}1") for c in "xy"]
    pairs = a.join(b, ["shape", "cx", "cy"]).where("aid < bid").where(near[0] & near[1] & near[2] & near[3])
    sides = {"a0": side("b0", "b1", "a0"), "a1": side("b0", "b1", "a1"), "b0": side("a0", "a1", "b0"), "b1": side("a0", "a1", "b1")}
    known = pairs.select("*", *[v.alias(f"s{k}") for k, v in sides.items()])
    opposite = lambda e: F.signum(f"s{e}0") * F.signum(f"s{e}1") < 0
    t = F.col("sa0").cast("double") / (F.col("sa0").cast("double") - F.col("sa1").cast("double"))
    cross = F.struct(*[F.round(F.col(f"a{c}0") + t * (F.col(f"a{c}1") - F.col(f"a{c}0"))).cast("long").alias(c) for c in "xy"])
    spot = lambda e, x, y: F.struct(F.col(f"{e}id").alias("id"), *[F.col(f"{e}{c}").alias(c) for c in ENDS], x.alias("x"), y.alias("y"))
    proper = F.when(opposite("a") & opposite("b"), F.array(spot("a", cross["x"], cross["y"]), spot("b", cross["x"], cross["y"])))
    touch = lambda e, o, i: F.when(F.col(f"s{o}{i}") == 0, spot(e, F.col(f"{o}x{i}"), F.col(f"{o}y{i}")))
    touches = F.array_compact(F.array(*[touch(e, o, i) for e, o in ("ab", "ba") for i in (0, 1)]))
    found = known.select(F.explode(F.coalesce(proper, touches)).alias("m")).select("m.*")
    along = (F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))
    whole = (F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))
    at_end = lambda i: (F.col("x") == F.col(f"x{i}")) & (F.col("y") == F.col(f"y{i}"))
    return found.select("id", along.alias("t"), "x", "y", whole.alias("whole"), (at_end(0) | at_end(1)).alias("end")).where((F.col("t") > 0) & (F.col("t") < F.col("whole")) & ~F.col("end")).select("id", "t", "x", "y").distinct()


def cut(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """The edges in pieces that meet at their ends only."""
    for _ in range(rounds):
        edges = checkpointed(edges.select("shape", "layer", *ENDS).withColumn("id", F.monotonically_increasing_id()))
        found = checkpointed(meetings(edges))
        if found.limit(1).count() == 0:
            return edges
        spots = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("spots"))
        ends = lambda i: F.array(F.struct(F.lit(0).cast("long").alias("t"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")))
        line = F.concat(ends(0), F.coalesce("spots", F.array().cast("array<struct<t:long,x:long,y:long>>")), ends(1))
        pieces = edges.join(spots, "id", "left").select("shape", "layer", F.explode(geom.let(line, lambda r: geom.edges(r, False))).alias("e"))
        edges = pieces.select("shape", "layer", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"]).where("x0 <> x1 OR y0 <> y1")
    raise RuntimeError("overlay: rounded crossings keep making others; take a smaller unit")


def wound(pieces: DataFrame, layers: int) -> DataFrame:
    """(shape, ends, left0, right0, left1, ...): each piece once, from its smaller end to its larger, with the winding number of each layer on both sides."""
    ahead = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    turned = pieces.select("shape", "layer", *[F.when(ahead, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(ENDS, ("x1", "y1", "x0", "y0"), strict=True)], F.when(ahead, 1).otherwise(-1).alias("m"))
    sums = [F.sum(F.when(F.col("layer") == k, F.col("m")).otherwise(0)).alias(f"m{k}") for k in range(layers)]
    some = " OR ".join(f"m{k} <> 0" for k in range(layers))
    one = checkpointed(turned.groupBy("shape", *ENDS).agg(*sums).where(some).withColumn("id", F.monotonically_increasing_id()))
    about = extents(one).select("shape", "west", F.greatest(F.lit(1), F.ceil(F.col("width") / F.least(F.lit(65_536), F.greatest(F.lit(1), F.col("n") / 2)))).cast("long").alias("strip"))
    known = one.join(about, "shape")
    strip = lambda v: F.floor((v - F.col("west")) / F.col("strip")).cast("int")
    flat = known.where("x0 < x1").select("shape", F.explode(F.sequence(strip(F.col("x0")), strip(F.col("x1")))).alias("s"), *[F.col(c).alias(f"f{c}") for c in (*ENDS, *(f"m{k}" for k in range(layers)))])
    middles = known.select("shape", "id", (F.col("x0") + F.col("x1")).alias("mx"), (F.col("y0") + F.col("y1")).alias("my"), (F.col("x0") == F.col("x1")).alias("upright"), strip((F.col("x0") + F.col("x1")) / 2).alias("s"))
    here = F.when(F.col("upright"), (2 * F.col("fx0") < F.col("mx")) & (F.col("mx") <= 2 * F.col("fx1"))).otherwise((2 * F.col("fx0") <= F.col("mx")) & (F.col("mx") < 2 * F.col("fx1")))
    below = (F.col("fx1") - F.col("fx0")) * (F.col("my") - 2 * F.col("fy0")) - (F.col("fy1") - F.col("fy0")) * (F.col("mx") - 2 * F.col("fx0")) > 0
    under = middles.join(flat, ["shape", "s"]).where(here & below).groupBy("id").agg(*[F.sum(f"fm{k}").alias(f"w{k}") for k in range(layers)])
    w, m = lambda k: F.coalesce(f"w{k}", F.lit(0)), lambda k: F.col(f"m{k}")
    upright = F.col("x0") == F.col("x1")
    both = [v for k in range(layers) for v in (F.when(upright, w(k)).otherwise(w(k) + m(k)).alias(f"left{k}"), F.when(upright, w(k) - m(k)).otherwise(w(k)).alias(f"right{k}"))]
    return one.join(under, "id", "left").select("shape", *ENDS, *both)


def border(edges: DataFrame, inside: Callable[..., Column], layers: int = 1) -> DataFrame:
    """(shape, ends): the border of the region whose winding numbers, one a layer, `inside` accepts; the region is on the left."""
    sides = wound(cut(edges), layers)
    left, right = inside(*[F.col(f"left{k}") for k in range(layers)]), inside(*[F.col(f"right{k}") for k in range(layers)])
    kept = sides.where(left != right)
    return kept.select("shape", *[F.when(left, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(ENDS, ("x1", "y1", "x0", "y0"), strict=True)])


def ranked(pointers: DataFrame) -> DataFrame:
    """(id, root, ahead) for pointers (id, to) that form cycles: the cycle's smallest id and the number of steps to it."""
    state = pointers.select("id", F.col("to").alias("jump"), F.col("id").alias("root"), F.lit(0).cast("long").alias("ahead"))
    state = checkpointed(state)
    for k in range(62):
        other = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("ahead").alias("_ahead"))
        lower = F.col("_root") < F.col("root")
        after = checkpointed(state.join(other, "jump").select("id", F.col("_jump").alias("jump"), F.least("root", "_root").alias("root"), F.when(lower, F.col("_ahead") + (1 << k)).otherwise(F.col("ahead")).alias("ahead"), lower.alias("new")))
        if after.where("new").limit(1).count() == 0:
            return state.select("id", "root", "ahead")
        state = after.drop("new")
    raise RuntimeError("ranked: the pointers are no cycles")


def rings(directed: DataFrame) -> DataFrame:
    """(shape, points, twice): the rings of border pieces with the region on their left, as arrays of struct<x, y> of whole
    numbers from the smallest point on, without points amid straight lines; `twice` is twice the area, negative for holes.

    Where several rings touch at a point, each piece goes on with the one that turns off first to the left, so parts that
    touch at a corner stay apart.
    """
    d = checkpointed(directed.select("shape", *ENDS).withColumn("id", F.monotonically_increasing_id()))
    out = d.select("shape", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("nx"), F.col("y1").alias("ny"), F.col("id").alias("to"))
    back, forth = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")), F.atan2(F.col("ny") - F.col("y1"), F.col("nx") - F.col("x1"))
    bend = F.pmod(back - forth, F.lit(2 * math.pi))
    pointers = d.join(out, ["shape", "x1", "y1"]).groupBy("id").agg(F.min_by("to", F.when(bend <= 0, 7.0).otherwise(bend)).alias("to"))
    placed = ranked(checkpointed(pointers)).join(d, "id")
    lines = placed.groupBy("shape", "root").agg(F.array_sort(F.collect_list(F.struct((-F.col("ahead")).alias("o"), F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("p"))
    # the root, nought steps ahead of itself, is the last of the order and stands first in the ring: the ring is the same
    points = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    corners = lambda r: F.filter(r, lambda p, i: turn(F.get(r, F.pmod(i - 1, F.size(r))), p, F.get(r, F.pmod(i + 1, F.size(r)))) != 0)
    first = lambda r: F.array_position(r, F.array_min(r)).cast("int")
    started = lambda r: geom.let(first(r), lambda k: F.concat(F.slice(r, k, F.size(r)), F.slice(r, F.lit(1), k - 1)))
    kept = lines.select("shape", geom.let(geom.let(points, corners), started).alias("points")).where(F.size("points") > 2)
    shifted = geom.let(F.get("points", F.lit(0)), lambda o: F.transform("points", lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y"))))
    twice = geom.let(shifted, lambda r: F.aggregate(F.zip_with(r, geom.following(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0).cast("long"), lambda s, v: s + v))
    return kept.select("shape", "points", twice.alias("twice"))


def polygons(found: DataFrame, unit: float = METRES) -> DataFrame:
    """(shape, parts, area): a shape's rings, outer ones turning left and holes turning right, the largest first."""
    each = F.struct((-F.abs("twice")).alias("o"), F.transform("points", lambda p: geom.point(p["x"] * unit, p["y"] * unit)).alias("r"))
    return found.groupBy("shape").agg(F.array_sort(F.collect_list(each)).alias("s"), (F.sum("twice") * (unit * unit / 2)).alias("area")).select("shape", F.transform("s", lambda v: v["r"]).alias("parts"), "area")


def named(shapes: DataFrame, key: str) -> DataFrame:
    return shapes.withColumnRenamed(key, "shape") if key != "shape" else shapes


def left_turning(ring: Column) -> Column:
    return geom.let(ring, lambda r: F.when(geom.signed_area(r) >= 0, r).otherwise(F.reverse(r)))


def outlined(rows: DataFrame, parts: Callable[[Column], Column], most: Column, inside: Callable, layers: int, unit: float) -> DataFrame:
    """(shape, parts, area): the region that `inside` accepts, for `rows` (shape, layer, given) of whose `given` the function
    `parts` makes rings, of `most` edges at most. Shapes of few edges are held as one row each; of the others no row holds all."""
    known = checkpointed(rows.where("given IS NOT NULL").withColumn("most", most.cast("long")))
    many = checkpointed(known.groupBy("shape").agg(F.sum("most").alias("all")).where(F.coalesce("all", F.lit(0)) > compact.FEW).select("shape"))
    general = lambda r: polygons(rings(border(edges_of(r.select("shape", "layer", parts(F.col("given")).alias("parts")), F.col("parts"), F.col("layer"), unit), inside, layers)), unit)
    none_many = many.limit(1).count() == 0
    few = known if none_many else known.join(many, "shape", "left_anti")
    ship(known.sparkSession)
    snap = lambda v: F.round(v / unit).cast("long")
    ends = lambda layer, r: F.transform(geom.edges(r), lambda e: F.struct(layer.alias("layer"), *[snap(e[p][c]).alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"]))
    held = spread(few.where("shape IS NOT NULL").select("shape", "layer", "given"), "shape", rows=10_000).groupBy("shape").agg(F.collect_list(F.struct("layer", "given")).alias("g"))
    whole = lambda r: F.filter(r, lambda v: v.isNotNull())
    lines = F.flatten(F.flatten(whole(F.transform("g", lambda g: F.transform(whole(parts(g["given"])), lambda r: ends(g["layer"], r))))))
    cut = held.select("shape", F.filter(lines, lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"])).alias("edges"))
    kind = dict(cut.dtypes)["shape"]
    done = cut.mapInArrow(lambda batches: compact.overlaid(batches, inside, layers, unit), f"shape {kind}, parts array<array<struct<x:double,y:double>>>, area double")
    return done if none_many else done.unionByName(general(known.join(many, "shape", "left_semi")))


def dissolved(shapes: DataFrame, key: str = "shape", unit: float = METRES) -> DataFrame:
    """(shape, parts, area): the union of all rings of each key. `shapes` has `parts`, whose outer rings turn left and holes right."""
    rows = named(shapes, key).select("shape", F.lit(0).alias("layer"), F.col("parts").alias("given"))
    return outlined(rows, lambda g: g, F.size(F.flatten("given")), lambda w: w > 0, 1, unit).withColumnRenamed("shape", key)


def combined(left: DataFrame, right: DataFrame, how: str = "intersection", key: str = "shape", unit: float = METRES) -> DataFrame:
    """(shape, parts, area): `left` and `right` (key, parts) of equal keys. A point is in a polygon where it is inside an odd
    number of its rings, so their directions don't matter; `how` is intersection, union, difference or either (but not both)."""
    rule = {"intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "either": lambda a, b: a != b}[how]
    rows = named(left, key).select("shape", F.lit(0).alias("layer"), F.col("parts").alias("given")).unionByName(named(right, key).select("shape", F.lit(1).alias("layer"), F.col("parts").alias("given")))
    odd = lambda w: w % 2 != 0
    return outlined(rows, lambda g: g, F.size(F.flatten("given")), lambda a, b: rule(odd(a), odd(b)), 2, unit).withColumnRenamed("shape", key)


def buffered(shapes: DataFrame, radius: Column, key: str = "shape", ring: str = "ring", per_quarter: int = 16, unit: float = METRES) -> DataFrame:
    """(shape, parts, area): all within `radius` of simple rings of any shape, without the ring in `parts` being convex.

    The edges move outwards, joined by arcs where the ring turns left and by way of the corner where it turns right; of
    this curve, which may cross itself, the parts with a positive winding number are the buffer. Arcs are cut into
    `per_quarter` pieces a quarter, whose corners lie on the true line.
    """
    rows = named(shapes.withColumn("_given", F.struct(F.col(ring).alias("ring"), radius.alias("radius"))), key).select("shape", F.lit(0).alias("layer"), F.col("_given").alias("given"))
    curve = lambda g: F.array(geom.offset_curve(g["ring"], g["radius"], per_quarter))
    return outlined(rows, curve, F.size("given.ring") * (2 * per_quarter + 2), lambda w: w > 0, 1, unit).withColumnRenamed("shape", key)
