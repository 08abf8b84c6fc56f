"""Overlays, masks as polygons and spatial joins against plain geometry on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import geom
from talweg.operators import hydro, layers, masks, overlay, spatial

RING = "array<struct<x:double,y:double>>"


def inside(parts, x, y):
    """By ray casting; odd is inside."""
    hit = np.zeros(np.shape(x), int)
    for r in parts:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if y0 != y1:
                hit += ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * ((y - y0) / (y1 - y0)) + x0)
    return hit % 2 == 1


def distance(ring, x, y):
    best = np.full(np.shape(x), np.inf)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0, 1)
        best = np.minimum(best, np.hypot(x - x0 - t * dx, y - y0 - t * dy))
    return np.where(inside([ring], x, y), 0, best)


def star(r, n, low=0.3):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(1000 * r.uniform(low, 1) * math.cos(a), 1000 * r.uniform(low, 1) * math.sin(a)) for a in turns]


def simple(ring):
    side = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
    es = list(zip(ring, ring[1:] + ring[:1]))
    return not any(side(*a, b[0]) * side(*a, b[1]) < 0 and side(*b, a[0]) * side(*b, a[1]) < 0 for i, a in enumerate(es) for b in es[:i])


def shapes(spark, rows):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in parts]) for k, parts in rows], f"shape int, parts array<{RING}>").withColumn("ring", F.get("parts", F.lit(0)))


def collected(df, key="shape"):
    return {r[key]: ([[(p["x"], p["y"]) for p in part] for part in r["parts"]], r["area"]) for r in df.collect()}


NOTCHED = {
    0: ([(0, 0), (1000, 0), (1000, 1000), (520, 1000), (520, 300), (480, 300), (480, 1000), (0, 1000)], 100),  # a slot that closes
    1: ([(0, 0), (1000, 0), (1000, 1000), (700, 1000), (700, 300), (300, 300), (300, 1000), (0, 1000)], 100),  # one that stays open
    2: ([(0, 0), (1000, 0), (1000, 1000), (550, 1000), (550, 900), (900, 900), (900, 100), (100, 100), (100, 900), (450, 900), (450, 1000), (0, 1000)], 100),  # its mouth closes: a hole stays
    3: ([(0, 1000), (0, 0), (600, 0), (600, 400), (250, 400), (250, 1000)][::-1], 150),  # turning right
}


def test_buffers_of_any_ring_agree_with_distances(spark):
    r = random.Random(4)
    cases = dict(NOTCHED)
    while len(cases) < 12:
        ring = star(r, r.randint(5, 25))
        if simple(ring):
            cases[len(cases)] = (ring, r.choice([20, 90, 300]))
    table = shapes(spark, [(k, [ring]) for k, (ring, _) in cases.items()])
    radius = F.element_at(F.create_map(*[F.lit(v) for k, (_, w) in cases.items() for v in (k, float(w))]), F.col("shape"))
    got = collected(overlay.buffered(table, radius))
    g = np.random.default_rng(1)
    for k, (ring, w) in cases.items():
        x, y = g.uniform(-1400, 1400, 10_000), g.uniform(-1400, 1400, 10_000)
        d = distance(ring, x, y)
        sure = abs(d - w) > 0.005 * w  # arcs of 16 pieces a quarter lie up to 0.12 % within the circle
        assert (inside(got[k][0], x, y) == (d <= w))[sure].all(), k
    assert len(got[2][0]) == 2 and len(got[0][0]) == 1
    assert not spark.range(1).select(geom.is_convex(F.array(*[geom.point(float(x), float(y)) for x, y in NOTCHED[0][0]])).alias("c")).first()["c"]
    with pytest.raises(Exception, match="not convex"):
        table.select(geom.buffered(F.col("ring"), F.lit(5.0))).collect()


def test_combined_polygons_agree_with_points(spark):
    r = random.Random(8)
    hole = [(200, 200), (200, 400), (400, 400), (400, 200)]
    left = [(0, [[(0, 0), (600, 0), (600, 600), (0, 600)], hole]), (1, [[(0, 0), (100, 0), (100, 100), (0, 100)]]), (2, [[(0, 0), (100, 0), (100, 100), (0, 100)]])]
    right = [(0, [[(300, 100), (900, 100), (900, 500), (300, 500)], [(10, 10), (50, 10), (50, 50)]]), (1, [[(100, 0), (200, 0), (200, 100), (100, 100)]]), (2, [[(0, 0), (100, 0), (100, 100), (0, 100)]])]
    for k in range(3, 9):
        a, b = star(r, 12), star(r, 9)
        left.append((k, [a])), right.append((k, [b]))
    g = np.random.default_rng(2)
    for how, rule in {"intersection": np.logical_and, "union": np.logical_or, "difference": lambda a, b: a & ~b, "either": np.not_equal}.items():
        got = collected(overlay.combined(shapes(spark, left), shapes(spark, right), how))
        for (k, a), (_, b) in zip(left, right):
            x, y = g.uniform(-1000, 1000, 20_000), g.uniform(-1000, 1000, 20_000)
            want = rule(inside(a, x, y), inside(b, x, y))
            assert (inside(got[k][0], x, y) == want).mean() > 0.9999 if k in got else not want.any(), (how, k)
    touching = collected(overlay.combined(shapes(spark, left), shapes(spark, right), "union"))
    assert touching[1] == ([[(0.0, 0.0), (200.0, 0.0), (200.0, 100.0), (0.0, 100.0)]], 20_000.0) and touching[2][1] == 10_000.0


def test_dissolved(spark):
    squares = [(i // 4, [[(x, 0), (x + 15, 0), (x + 15, 10), (x, 10)]]) for i in range(8) for x in [10 * (i % 4)]]
    assert collected(overlay.dissolved(shapes(spark, squares))) == {k: ([[(0.0, 0.0), (45.0, 0.0), (45.0, 10.0), (0.0, 10.0)]], 450.0) for k in (0, 1)}
    corner = shapes(spark, [(0, [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]])])
    assert sorted(map(len, collected(overlay.dissolved(corner))[0][0])) == [4, 4]  # parts that touch at a corner stay apart


def components(cells):
    left, out = set(cells), []
    while left:
        part, edge = set(), [min(left)]
        while edge:
            c = edge.pop()
            if c in left:
                left.discard(c)
                part.add(c)
                edge += [(c[0] + a, c[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        out.append(part)
    return out


@pytest.mark.parametrize("block", [4, 7, 256])
def test_masks_as_polygons(spark, block):
    r = random.Random(block)
    cells = {(i, j) for i in range(-3, 22) for j in range(-5, 26) if r.random() < 0.62}
    table = spark.createDataFrame(sorted(cells) + sorted(cells)[:3], "row int, col int").repartition(3)
    want = {min(p)[0] * hydro.ROW + min(p)[1]: p for p in components(cells)}
    got = {(x["row"], x["col"]): x["label"] for x in masks.labelled(table, block).collect()}
    assert got == {c: k for k, p in want.items() for c in p}
    polygons = {x["label"]: x for x in masks.polygons(table, block=block).collect()}
    assert set(polygons) == set(want)
    for k, part in want.items():
        sides = sum((c[0] + a, c[1] + b) not in part for c in part for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        rings = [[(p["x"], p["y"]) for p in ring] for ring in polygons[k]["parts"]]
        row, col = np.array(sorted(part)).T
        i, j = np.meshgrid(np.arange(-5, 25), np.arange(-7, 30), indexing="ij")
        assert polygons[k]["area"] == len(part) and polygons[k]["outline"] == sides
        assert {(a, b) for a, b in zip(i.ravel().tolist(), j.ravel().tolist()) if inside(rings, b + 0.5, -a - 0.5)} == part
        pairs = sum((a + 1, b) in part for a, b in part) + sum((a, b + 1) in part for a, b in part)
        quads = sum({(a + 1, b), (a, b + 1), (a + 1, b + 1)} <= part for a, b in part)
        assert polygons[k]["holes"] == 1 - (len(part) - pairs + quads)
    assert masks.polygons(table.limit(0)).count() == 0


def meets(a, b):
    (ka, pa), (kb, pb) = a, b
    side = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
    es = lambda k, ps: [] if k == "point" else [e for r in ps for e in zip(r, r[1:] + (r[:1] if k == "polygon" else []))]
    if ka == "polygon" and any(inside(pa, *p) for r in pb for p in r) or kb == "polygon" and any(inside(pb, *p) for r in pa for p in r):
        return True
    return {ka, kb} <= {"polygon", "line"} and any(side(*e, f[0]) * side(*e, f[1]) <= 0 and side(*f, e[0]) * side(*f, e[1]) <= 0 for e in es(ka, pa) for f in es(kb, pb))


def test_spatial_join_equals_all_pairs(spark):
    r = random.Random(6)

    def feature(i):
        kind = ["polygon", "line", "point", "polygon"][i % 4]
        x, y, s = r.uniform(0, 5000), r.uniform(0, 5000), 10 ** r.uniform(0, 3.3)
        n = 2000 if i % 29 == 0 and kind != "point" else r.randint(3, 12)
        ring = [(x + s * (0.5 + 0.5 * r.random()) * math.cos(2 * math.pi * k / n), y + s * (0.5 + 0.5 * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return kind, ([[(x, y)]] if kind == "point" else [ring, [(x + (u - x) / 4, y + (v - y) / 4) for u, v in ring[:12]]] if kind == "polygon" and i % 3 else [ring])

    left, right = [feature(i) for i in range(90)], [feature(i + 1) for i in range(90)]
    kind = f"id int, kind string, parts array<{RING}>"
    table = lambda fs: spark.createDataFrame([(i, k, [[{"x": x, "y": y} for x, y in p] for p in ps]) for i, (k, ps) in enumerate(fs)], kind)
    got = sorted(map(tuple, spatial.meeting(table(left), table(right)).collect()))
    assert got == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if meets(a, b)]
    assert spatial.meeting(table([]), table(right)).count() == 0


def test_a_large_feature_is_spread_over_cells(spark):
    n = 4000
    ring = [(1e5 * math.cos(2 * math.pi * k / n), 1e5 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    kind = f"id int, kind string, parts array<{RING}>"
    table = spark.createDataFrame([(1, "polygon", [[{"x": x, "y": y} for x, y in ring]])], kind)
    sizes = spatial.in_cells(spatial.levelled(table), []).select(F.size("edges").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert sizes[0] < 60 and sizes[1] > 10_000


def test_clip_of_points_lines_and_polygons(spark):
    """Every kind within a notched ring, polygons also where they hold the ring, a hole of it, or lie in its notch."""
    ring = [(0, 0), (100, 0), (100, 100), (60, 100), (60, 40), (40, 40), (40, 100), (0, 100)]
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    rows = [
        ("point", [[(50, 50)]], 1), ("point", [[(50, 20)]], 2), ("line", [[(-10, 50), (110, 50)]], 3), ("polygon", [box(10, 10, 20, 20)], 4), ("polygon", [box(30, 50, 70, 60)], 5), ("polygon", [box(45, 60, 55, 70)], 6),
        ("polygon", [box(-50, -50, 150, 150), box(45, 60, 55, 70), box(10, 10, 20, 20)], 7), ("polygon", [box(80, 80, 200, 200), box(90, 90, 120, 120)], 8), ("polygon", [box(500, 500, 600, 600)], 9),
    ]
    table = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in p] for p in ps], i) for k, ps, i in rows], f"kind string, parts array<{RING}>, _id int")
    got = {r["_id"]: [[(p["x"], p["y"]) for p in part] for part in r["parts"]] for r in layers.clip(table, ring, overlay.METRES).collect()}
    assert set(got) == {2, 3, 4, 5, 7, 8} and got[3] == [[(0.0, 50.0), (40.0, 50.0)], [(60.0, 50.0), (100.0, 50.0)]]
    g = np.random.default_rng(3)
    x, y = g.uniform(-20, 220, 20_000), g.uniform(-20, 220, 20_000)
    for kind, parts, i in rows:
        if kind == "polygon":
            want = inside(parts, x, y) & inside([ring], x, y)
            assert (inside(got[i], x, y) == want).all() if i in got else not want.any(), i
    assert layers.clip(table.limit(0), ring).count() == 0


def test_joins_of_many_features_test_few_edges(spark, sf):
    """Larger polygons have more cells, pairs of points and polygons need no distinct, and `ascending` leaves out the mirrored half."""
    from talweg.operators import spatial
    from talweg.plans.fixtures import areas, places

    rows = spatial.levelled(areas(spark, sf)).selectExpr("own", "greatest(b.east - b.west, b.north - b.south) / pow(2, own) AS across").collect()
    assert all(2 <= r["across"] <= 16 for r in rows) and max(r["across"] for r in rows) >= 8
    pairs = spatial.meeting(areas(spark, sf), areas(spark, sf))
    assert sorted(pairs.where("left_id < right_id").collect()) == sorted(spatial.meeting(areas(spark, sf), areas(spark, sf), ascending=True).collect())
    assert spatial.once(areas(spark, sf).withColumn("n", F.lit(5)), places(spark, sf).withColumn("n", F.lit(1)))
    assert not spatial.once(areas(spark, sf).withColumn("n", F.lit(5)), areas(spark, sf).withColumn("n", F.lit(5)))
    found = spatial.meeting(areas(spark, sf), places(spark, sf))
    assert found.count() == found.distinct().count()


def test_copies_of_a_shape_are_tested_once_and_pairs_made_last(spark):
    """Features of equal parts share a row, up to a bound; pairs are whole and come once, without a distinct, also one way round within a table."""
    r = random.Random(8)
    ring = lambda x, y, s, n: [(x + s * r.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + s * r.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = [("polygon", [ring(0, 0, 80, 9)]), ("polygon", [ring(10, 5, 20, 5), ring(10, 5, 4, 3)]), ("line", [ring(5, 5, 30, 6), ring(40, 0, 9, 2)]), ("line", [ring(6, 3, 25, 4)]), ("line", [[(3.0, 2.0)]]), ("polygon", [ring(500, 0, 70, 7)]), ("polygon", [ring(560, 20, 60, 60), ring(0, 0, 9, 9)])]
    some = [shapes[i] for i in [0] * 70 + [1] * 3 + [2] * 4 + [3, 4, 5, 5, 6, 6]]
    r.shuffle(some)
    kind = f"id long, kind string, parts array<{RING}>"
    table = lambda rows: spark.createDataFrame([(i, k, [[{"x": x, "y": y} for x, y in p] for p in ps]) for i, (k, ps) in rows], kind)
    one = table(enumerate(some))
    want = [(i, j) for i, a in enumerate(some) for j, b in enumerate(some) if i < j and meets(a, b)]
    known, count = spatial.shapes(one)
    assert sum(count.values()) == known.count() == len(shapes) + 1 and max(len(x["ids"]) for x in known.collect()) == spatial.COPIES
    each = spatial.meeting(one, one, ascending=True)
    assert sorted(map(tuple, each.collect())) == want
    assert sorted(map(tuple, spatial.meeting(one, table(enumerate(some)), ascending=True).collect())) == want
    few = spatial.meeting(*[one.where(F.size(F.flatten("parts")) <= spatial.FEW)] * 2, ascending=True)
    assert "Aggregate(keys=[left_id" not in few._jdf.queryExecution().executedPlan().toString()
    # a number that is given twice, and none
    named = [(1, shapes[0]), (1, shapes[1]), (None, shapes[1]), (2, shapes[5])]
    got = spatial.meeting(table(named), table([(7, shapes[0]), (8, shapes[2]), (8, shapes[3])])).collect()
    assert sorted(map(tuple, got), key=str) == sorted({(i, j) for i, a in named for j, b in ((7, shapes[0]), (8, shapes[2]), (8, shapes[3])) if meets(a, b)}, key=str)


def test_points_of_one_spot_are_tested_once(spark):
    """Copies of points and polygons are a row each; cells with one edge or none are tested without lambdas; pairs are whole and come once."""
    r = random.Random(9)
    star = lambda x, y, s, n: [(x + s * r.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + s * r.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = [star(r.uniform(0, 100), r.uniform(0, 100), r.choice([4, 9, 60]), r.choice([3, 5, 90])) for _ in range(12)]
    spots = [(r.uniform(-10, 110), r.uniform(-10, 110)) for _ in range(60)]
    kind = f"id int, kind string, parts array<{RING}>"
    table = lambda rows, k: spark.createDataFrame([(i, k, [[{"x": x, "y": y} for x, y in p]]) for i, p in rows], kind)
    areas, places = table([(i, rings[i % 12]) for i in range(36)], "polygon"), table([(i, [spots[i % 60]]) for i in range(180)], "point")
    found = spatial.meeting(areas, places)
    want = sorted((i, j) for i in range(36) for j in range(180) if inside([rings[i % 12]], *spots[j % 60]))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    assert sorted((j, i) for i, j in spatial.meeting(places, areas).collect()) == want
    (a, _), (b, of_b) = spatial.shapes(areas), spatial.shapes(places)
    assert a.count() == 12 and of_b == {"point": 60}
    plan = spatial.points_within(a, b, 72)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "level" in line]
    assert len(joins) == 3 and sum("lambda" in line for line in joins) == 1


def test_shapes_of_few_edges_are_overlaid_within_tasks(spark, sf, monkeypatch):
    """Rows of the same parts and areas as by joins, in one stage after the shapes are dealt: no shuffle of edges, no rounds."""
    from talweg.plans.fixtures import angles

    rng = random.Random(5)
    star = lambda: [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(7)]
    kind = "id int, parts array<array<struct<x:double,y:double>>>"
    a, b = (spark.createDataFrame([(i, [star(), star()]) for i in range(12)], kind) for _ in range(2))
    some = angles(spark, sf).where("id < 40")
    runs = [lambda: overlay.buffered(some, F.col("radius"), "id"), *[lambda how=how: overlay.combined(a, b, how, "id") for how in ("intersection", "either")]]
    few = [sorted(run().collect()) for run in runs]
    plan = runs[0]()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(overlay.compact, "FEW", 0)
    for found, run in zip(few, runs, strict=True):
        assert found and found == sorted(run().collect())
