"""Plane geometry on rings, arrays of struct<x, y> without the closing point, in higher-order functions."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def bound(f):
    """Binds the first argument of a ring function, so that nested calls don't compute it again and again."""

    @functools.wraps(f)
    def with_ring(ring: Column, *rest, **named) -> Column:
        return let(ring, lambda r: f(r, *rest, **named))

    return with_ring


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north))


def following(ring: Column) -> Column:
    """The ring turned by one: the end of the edge that starts at each point."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


@bound
def signed_area(ring: Column) -> Column:
    cross = F.zip_with(ring, following(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


@bound
def area(ring: Column) -> Column:
    """Shoelace area. The ring is moved to its first point, which keeps large coordinates from eating digits."""
    near = let(F.get(ring, F.lit(0)), lambda first: F.transform(ring, lambda p: point(p["x"] - first["x"], p["y"] - first["y"])))
    return F.when(F.size(ring) >= 3, F.abs(signed_area(near))).otherwise(0.0)


@bound
def length(line: Column, closed: bool = False) -> Column:
    ends = following(line) if closed else F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    starts = line if closed else F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(starts, ends, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(0.0), lambda s, v: s + v)


@bound
def bounds(ring: Column) -> Column:
    """struct<west, south, east, north>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


@bound
def centroid(ring: Column) -> Column:
    cross = F.zip_with(ring, following(ring), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda of: F.aggregate(cross, F.lit(0.0), lambda s, v: s + of(v))
    return point(total(lambda v: v["c"] * v["x"]) / (6 * signed_area(ring)), total(lambda v: v["c"] * v["y"]) / (6 * signed_area(ring)))


def circle(x: Column, y: Column, radius: Column, per_quarter: int = 32) -> Column:
    turn = math.pi / (2 * per_quarter)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * per_quarter - 1)), lambda k: point(x + radius * F.cos(-turn * k), y + radius * F.sin(-turn * k)))


def capsule(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, per_quarter: int = 16) -> Column:
    """All within `width` of a segment: two half circles joined by the sides."""
    turn, heading = math.pi / (2 * per_quarter), F.atan2(y1 - y0, x1 - x0)
    half = lambda x, y, start: F.transform(F.sequence(F.lit(0), F.lit(2 * per_quarter)), lambda k: point(x + width * F.cos(heading + start + turn * k), y + width * F.sin(heading + start + turn * k)))
    return F.concat(half(x1, y1, -math.pi / 2), half(x0, y0, math.pi / 2))


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - x0 - t * dx, py - y0 - t * dy)


@bound
def densify(ring: Column, step: float) -> Column:
    """The ring with points every `step` or less along its edges."""

    def split(a: Column, b: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: point(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n))

    return F.flatten(F.zip_with(ring, following(ring), split))


@bound
def half_plane(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """Sutherland-Hodgman: the part of a ring on one side of a line along an axis."""
    other = "y" if axis == "x" else "x"
    inside = (lambda p: p[axis] >= limit) if keep_above else (lambda p: p[axis] <= limit)

    def edge(a: Column, b: Column) -> Column:
        t = F.try_divide(limit - a[axis], b[axis] - a[axis])
        v = a[other] + t * (b[other] - a[other])
        cut = point(limit, v) if axis == "x" else point(v, limit)
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cut)).when(inside(b), F.array(cut, b)).otherwise(F.array().cast(POINTS))

    return F.flatten(F.zip_with(ring, following(ring), edge))


def clip_to_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The ring inside a box. Its area is exact for any simple ring; rings that fall apart stay joined along the box."""
    for axis, limit, above in (("x", west, True), ("x", east, False), ("y", south, True), ("y", north, False)):
        ring = half_plane(ring, axis, limit, above)
    return ring


@bound
def overlap_area(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The area of a simple ring within a box: along every edge the height above the box's south side, kept within the box,
    is integrated over the part of the edge between its west and east sides."""
    into = lambda v, lo, hi: F.greatest(lo, F.least(hi, v))

    def strip(q: Column) -> Column:
        lo, hi = F.least(q["y0"], q["y1"]), F.greatest(q["y0"], q["y1"])
        a, b = into(lo, south, north), into(hi, south, north)
        mean = ((b - a) * ((a + b) / 2 - south) + F.greatest(F.lit(0.0), hi - F.greatest(lo, north)) * (north - south)) / (hi - lo)
        return q["dx"] * F.when(hi > lo, mean).otherwise(a - south)

    def edge(a: Column, b: Column) -> Column:
        x0, x1 = into(a["x"], west, east), into(b["x"], west, east)
        at = lambda x: a["y"] + (x - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
        return F.when(x0 == x1, 0.0).otherwise(let(F.struct((x1 - x0).alias("dx"), at(x0).alias("y0"), at(x1).alias("y1")), strip))

    return F.abs(F.aggregate(F.zip_with(ring, following(ring), edge), F.lit(0.0), lambda s, v: s + v))


@bound
def edge_meets(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an edge of a ring has a point in a box or on its sides."""

    def slab(start: Column, step: Column, lo: Column, hi: Column, last: bool) -> Column:
        a, b = F.try_divide(lo - start, step), F.try_divide(hi - start, step)
        inside = start.between(lo, hi)
        return F.when(step == 0, F.when(inside, 1.0).otherwise(-1.0) if last else F.when(inside, 0.0).otherwise(2.0)).otherwise(F.greatest(a, b) if last else F.least(a, b))

    def meets(a: Column, b: Column) -> Column:
        first = F.greatest(F.lit(0.0), slab(a["x"], b["x"] - a["x"], west, east, False), slab(a["y"], b["y"] - a["y"], south, north, False))
        last = F.least(F.lit(1.0), slab(a["x"], b["x"] - a["x"], west, east, True), slab(a["y"], b["y"] - a["y"], south, north, True))
        return first <= last

    return F.exists(F.zip_with(ring, following(ring), meets), lambda m: m)


def meet(p: Column, q: Column, r: Column, radius: Column) -> Column:
    """The corner of the lines at `radius` outside of the edges p-q and q-r of a ring that turns left."""
    ux, uy = (q["x"] - p["x"]) / F.hypot(q["x"] - p["x"], q["y"] - p["y"]), (q["y"] - p["y"]) / F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    vx, vy = (r["x"] - q["x"]) / F.hypot(r["x"] - q["x"], r["y"] - q["y"]), (r["y"] - q["y"]) / F.hypot(r["x"] - q["x"], r["y"] - q["y"])
    k = radius / (1 + ux * vx + uy * vy)
    return point(q["x"] + k * (uy + vy), q["y"] - k * (ux + vx))


def is_convex(ring: Column) -> Column:
    """Whether a ring turns to one side only."""

    def turns(r: Column) -> Column:
        n = F.size(r)

        def bend(p: Column, q: Column, s: Column) -> Column:
            sine = ((q["x"] - p["x"]) * (s["y"] - q["y"]) - (q["y"] - p["y"]) * (s["x"] - q["x"])) / (F.hypot(q["x"] - p["x"], q["y"] - p["y"]) * F.hypot(s["x"] - q["x"], s["y"] - q["y"]))
            return F.when(sine > 1e-9, 1).when(sine < -1e-9, -1).otherwise(0)  # corners of round shapes may be straight but for rounding

        return F.transform(r, lambda q, i: bend(F.get(r, F.pmod(i - 1, n)), q, F.get(r, F.pmod(i + 1, n))))

    return let(let(ring, distinct_corners), lambda r: let(turns(r), lambda t: ~(F.array_contains(t, 1) & F.array_contains(t, -1))))


def offset_curve(ring: Column, radius: Column, per_quarter: int = 16) -> Column:
    """The line at `radius` outside of a simple ring: edges moved outwards, joined by arcs at corners that turn left and by way of
    the corner itself at those that turn right. Of rings that aren't convex it may cross itself; the buffer is where it winds at least once."""
    turned = let(ring, lambda r: F.when(signed_area(r) >= 0, r).otherwise(F.reverse(r)))
    turn = math.pi / (2 * per_quarter)

    def corners(r: Column) -> Column:
        n = F.size(r)
        trio = lambda i, q: (F.get(r, F.pmod(i - 1, n)), q, F.get(r, F.pmod(i + 1, n)))

        def arc(p: Column, q: Column, s: Column) -> Column:
            start = F.atan2(q["y"] - p["y"], q["x"] - p["x"]) - math.pi / 2
            bend = F.pmod(F.atan2(s["y"] - q["y"], s["x"] - q["x"]) - math.pi / 2 - start, F.lit(2 * math.pi))
            steps = F.when((bend > 1e-9) & (bend < math.pi + 1e-9), F.ceil(bend / turn - 1e-9)).otherwise(0).cast("int")
            spot = lambda a: point(q["x"] + radius * F.cos(a), q["y"] + radius * F.sin(a))
            along = lambda g: F.transform(F.sequence(F.lit(0), g["n"]), lambda k: spot(g["a"] + F.when(g["n"] > 0, g["b"] * k / g["n"]).otherwise(0.0)))
            inward = lambda g: F.array(spot(g["a"]), point(q["x"], q["y"]), spot(g["a"] + g["b"]))
            right = lambda g: (g["b"] >= math.pi + 1e-9) & (g["b"] < 2 * math.pi - 1e-9)
            return let(F.struct(start.alias("a"), bend.alias("b"), steps.alias("n")), lambda g: F.when(right(g), inward(g)).otherwise(along(g)))

        return F.flatten(F.transform(r, lambda q, i: arc(*trio(i, q))))

    return let(let(turned, distinct_corners), corners)


def buffered(ring: Column, radius: Column, per_quarter: int = 16, mitre: bool = False) -> Column:
    """All within `radius` of a convex ring: its edges moved outwards, joined by arcs or, with `mitre`, by corners.

    Another ring is an error; `overlay.buffered` takes rings of any shape.
    """

    def moved(r: Column) -> Column:
        n = F.size(r)
        return F.transform(r, lambda q, i: meet(F.get(r, F.pmod(i - 1, n)), q, F.get(r, F.pmod(i + 1, n)), radius))

    def grown(r: Column) -> Column:
        if not mitre:
            return offset_curve(r, radius, per_quarter)
        return let(let(F.when(signed_area(r) >= 0, r).otherwise(F.reverse(r)), distinct_corners), moved)

    return let(ring, lambda r: F.when(is_convex(r), grown(r)).otherwise(F.raise_error(F.lit("buffered: the ring is not convex")).cast(POINTS)))


def distinct_corners(ring: Column) -> Column:
    """The ring without points that repeat the one before."""
    return F.filter(ring, lambda p, i: let(F.get(ring, F.pmod(i - 1, F.size(ring))), lambda q: (p["x"] != q["x"]) | (p["y"] != q["y"])))


@bound
def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by ray casting; points on the edge may go either way."""
    crossed = F.zip_with(ring, following(ring), lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.coalesce(F.try_divide(y - a["y"], b["y"] - a["y"]), F.lit(0.0)) + a["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, ring: Column) -> Column:
    """struct<t0, t1>, the part of a segment inside a convex ring (Cyrus-Beck); null where none of it is."""
    orient = F.when(signed_area(ring) >= 0, 1.0).otherwise(-1.0)

    def limit(a: Column, b: Column) -> Column:
        nx, ny = orient * (a["y"] - b["y"]), orient * (b["x"] - a["x"])
        den, num = nx * (x1 - x0) + ny * (y1 - y0), nx * (a["x"] - x0) + ny * (a["y"] - y0)
        t = F.try_divide(num, den)
        return F.struct(F.when(den > 0, t).when((den == 0) & (num > 0), 2.0).otherwise(0.0).alias("lo"), F.when(den < 0, t).otherwise(1.0).alias("hi"))

    limits = F.zip_with(ring, following(ring), limit)
    lo = F.greatest(F.lit(0.0), F.array_max(F.transform(limits, lambda v: v["lo"])))
    hi = F.least(F.lit(1.0), F.array_min(F.transform(limits, lambda v: v["hi"])))
    return F.when(lo < hi, F.struct(lo.alias("t0"), hi.alias("t1")))


def edges(ring: Column, closed: bool = True) -> Column:
    """array<struct<a, b>>: the edges of a ring, or of a line."""
    ends = following(ring) if closed else F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    starts = ring if closed else F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def within_parts(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a polygon of several rings: holes count as outside."""
    return F.aggregate(parts, F.lit(0), lambda s, ring: s + contains(ring, x, y).cast("int")) % 2 == 1


def cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments have a point in common; segments on one line are left to tests of their ends."""
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    return (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0) & ((side(a, b, c) != 0) | (side(a, b, d) != 0))


def intersects(kind: Column, parts: Column, ring: Column) -> Column:
    """Whether a point, line or polygon (parts: lists of points) meets a simple ring."""

    def meets(r: Column) -> Column:
        vertex = F.exists(F.flatten(parts), lambda p: contains(r, p["x"], p["y"]))
        around = (kind == "polygon") & F.exists(F.slice(r, 1, 1), lambda p: within_parts(parts, p["x"], p["y"]))
        crossing = lambda es: F.exists(parts, lambda line: F.exists(edges(line, False), lambda e: F.exists(es, lambda f: cross(e["a"], e["b"], f["a"], f["b"]))))
        return vertex | around | ((kind != "point") & let(edges(r), crossing))

    return let(ring, meets)


def clipped_lines(parts: Column, ring: Column) -> Column:
    """The parts of lines inside a simple ring, convex or not, as lines; what leaves the ring and comes back falls apart."""

    def inner(a: Column, b: Column, r: Column, es: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def at(e: Column) -> Column:
            ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
            den = dx * ey - dy * ex
            t = F.try_divide((e["a"]["x"] - a["x"]) * ey - (e["a"]["y"] - a["y"]) * ex, den)
            s = F.try_divide((e["a"]["x"] - a["x"]) * dy - (e["a"]["y"] - a["y"]) * dx, den)
            return F.when(s.between(0, 1) & (t > 0) & (t < 1), t)

        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(es, at), lambda t: t.isNotNull()))))
        spans = let(cuts, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
        kept = F.filter(spans, lambda v: contains(r, a["x"] + dx * (v["p"] + v["q"]) / 2, a["y"] + dy * (v["p"] + v["q"]) / 2))
        end = lambda t: F.when(t == 1.0, point(b["x"], b["y"])).otherwise(point(a["x"] + dx * t, a["y"] + dy * t))
        return F.transform(kept, lambda v: F.array(end(v["p"]), end(v["q"])))

    def joined(pieces: Column) -> Column:
        def add(lines: Column, piece: Column) -> Column:
            last = F.element_at(lines, -1)
            goes_on = F.when(F.size(lines) > 0, F.element_at(last, -1) == piece[0]).otherwise(False)
            return F.when(goes_on, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.slice(piece, 2, 1))))).otherwise(F.concat(lines, F.array(piece)))

        return F.aggregate(pieces, F.array().cast(f"array<{POINTS}>"), add)

    cut = lambda r, es: F.flatten(F.transform(parts, lambda line: joined(F.flatten(F.transform(edges(line, False), lambda e: inner(e["a"], e["b"], r, es))))))
    return let(ring, lambda r: let(edges(r), lambda es: cut(r, es)))
