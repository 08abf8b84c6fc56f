"""Thematic layers: spatial selection, hierarchies, nearest places, image ranking and map tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geom, text
from ..schemas import PLACES, WATERCOURSES, WATERWAYS
from ..session import checkpointed
from . import overlay


def inside(points: DataFrame, ring: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Points in a ring: its box first, which a reader can use to skip files, then the exact test."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    shape = F.array(*[geom.point(*p) for p in ring])
    return points.where(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))).where(geom.contains(shape, F.col(x), F.col(y)))


def clip(features: DataFrame, ring: list[tuple[float, float]], unit: float = overlay.DEGREES) -> DataFrame:
    """`features` (kind, parts, attributes) within a simple ring: points inside it, the parts of lines inside it, and polygons cut
    by it. Only polygons whose border the ring crosses are overlaid; the others are inside as a whole, around the ring, or out.
    `unit` is the overlay's grid: degrees, or `overlay.METRES`."""
    shape = F.array(*[geom.point(float(x), float(y)) for x, y in ring])
    first = F.get(F.get("parts", F.lit(0)), F.lit(0))
    points = features.where("kind = 'point'").where(geom.contains(shape, first["x"], first["y"]))
    lines = features.where("kind = 'line'").withColumn("parts", geom.clipped_lines(F.col("parts"), shape)).where(F.size("parts") > 0)
    polygons = features.where("kind = 'polygon'").where(geom.intersects(F.col("kind"), F.col("parts"), shape))
    crossing = geom.let(geom.edges(shape), lambda es: F.exists("parts", lambda r: F.exists(geom.edges(r), lambda e: F.exists(es, lambda f: geom.cross(e["a"], e["b"], f["a"], f["b"])))))
    around = geom.within_parts(F.col("parts"), F.lit(float(ring[0][0])), F.lit(float(ring[0][1])))
    known = checkpointed(polygons.withColumn("_n", F.monotonically_increasing_id()).withColumn("_cross", crossing))
    whole = known.where("NOT _cross").withColumn("parts", F.when(around, F.concat(F.array(shape), F.filter("parts", lambda r: geom.contains(shape, F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"])))).otherwise(F.col("parts")))
    parted = known.where("_cross")
    left = parted.select("_n", "parts")
    cut = overlay.combined(left, parted.select("_n", F.array(shape).alias("parts")), "intersection", "_n", unit).select("_n", F.col("parts").alias("_cut"))
    inner = parted.join(cut, "_n").withColumn("parts", F.col("_cut")).select(*features.columns)
    return points.unionByName(lines).unionByName(whole.select(*features.columns)).unionByName(inner)


def clip_lines(lines: DataFrame, ring: Column) -> DataFrame:
    """Each segment of `lines` (line) inside a convex ring, as rows x0, y0, x1, y1 and place in the line."""
    cols = [c for c in lines.columns if c != "line"]
    parts = lines.where(F.size("line") > 1).select(*cols, F.posexplode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("place", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    cut = parts.withColumn("t", geom.clip_segment(a["x"], a["y"], b["x"], b["y"], ring)).where("t IS NOT NULL")
    at = lambda t, k: a[k] + (b[k] - a[k]) * F.col(t)
    return cut.select(*cols, "place", at("t.t0", "x").alias("x0"), at("t.t0", "y").alias("y0"), at("t.t1", "x").alias("x1"), at("t.t1", "y").alias("y1"))


def cascade(levels: list[tuple[DataFrame, str, str | None]], chosen: DataFrame) -> list[DataFrame]:
    """Levels (table, key, parent key) from the top down. `chosen` holds keys of the first; each next level keeps the
    children of what the one above kept, a chain of semi-joins. Nothing chosen leaves every level empty."""
    out, keys = [], chosen
    for i, (table, key, parent) in enumerate(levels):
        on = key if i == 0 else parent
        kept = table.join(keys.select(F.col(keys.columns[0]).alias("_k")), table[on] == F.col("_k"), "left_semi")
        out.append(kept)
        keys = kept.select(key)
    return out


def nearest(points: DataFrame, places: DataFrame, key: str = "id", name: str = "name", cell: float | None = None) -> DataFrame:
    """(key, name, place_id, distance): the nearest place of each point, however far; the lowest place_id among equals.

    Places are found in the grid cells around a point, an equality join in place of all pairs. Within one cell's length a
    find is sure; points without one ask again on a grid of eight times the cell, until none is left. Unset, the first cell
    is one of few places, so that a point meets no more of them where there are more in all. Points without finite
    coordinates, and all points where there are no places, give no row.
    """
    left = points.select(key, "x", "y").where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & ~F.isnan("x") & ~F.isnan("y"))
    # of places on one spot the lowest number is the nearest to every point
    there = checkpointed(places.groupBy(F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min(F.struct("place_id", name)).alias("p")).select("p.place_id", f"p.{name}", "px", "py"))
    edges = there.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    cell = cell or sparse_cell(there)
    found = None
    while True:
        best = checkpointed(within(left, there, key, name, cell))
        sure = best.where(F.col("distance") <= cell)
        found = sure if found is None else found.unionByName(sure)
        left = checkpointed(left.join(sure.select(key), key, "left_anti"))
        rest = left.agg(F.count("*"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
        if edges[0] is None or not rest[0] or cell > 4 * (rest[1] + max(map(abs, edges))):
            return found
        cell *= 8


def sparse_cell(places: DataFrame, most: float = 4.0) -> float:
    """The side of a grid cell in which a place has `most` others or fewer on average: two a cell where they lie evenly, smaller where they crowd."""
    finite = places.where((F.abs("px") < float("inf")) & (F.abs("py") < float("inf")))
    b = finite.agg(F.count("*").alias("n"), (F.max("px") - F.min("px")).alias("width"), (F.max("py") - F.min("py")).alias("height")).first()
    if not b["n"] or not max(b["width"], b["height"]):
        return 20_000.0
    cell = max(math.sqrt(2 * b["width"] * b["height"] / b["n"]), 2 * max(b["width"], b["height"]) / b["n"])
    for _ in range(24):
        n = F.col("n").cast("double")
        crowd = finite.groupBy(F.floor(F.col("px") / cell), F.floor(F.col("py") / cell)).agg(F.count("*").alias("n")).agg(F.sum(n * n) / F.sum(n)).first()[0]
        if crowd <= most + 1:
            break
        cell /= 4
    return cell


def within(points: DataFrame, places: DataFrame, key: str, name: str, cell: float) -> DataFrame:
    """The best place of each point among those in its grid cell and the eight around it: each place is dealt to nine cells, a point to one."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = points.select(key, "x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    dealt = places.select("*", F.explode(steps).alias("s")).select("place_id", name, "px", "py", (F.floor(F.col("px") / cell) + F.col("s.i")).alias("gx"), (F.floor(F.col("py") / cell) + F.col("s.j")).alias("gy"))
    d = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    best = asked.join(dealt, ["gx", "gy"]).groupBy(key).agg(F.min(F.struct(d.alias("distance"), F.col("place_id"), F.col(name))).alias("b"))
    return best.select(key, f"b.{name}", "b.place_id", "b.distance")


def by_distance(places: DataFrame, x: float, y: float, *ties: str) -> DataFrame:
    """`places` (x, y) with dist_m from a point, to a tenth of a metre, the nearest first; `ties` order equals."""
    return places.withColumn("dist_m", F.round(F.hypot(F.col("x") - x, F.col("y") - y), 1)).orderBy("dist_m", *ties)


def gazetteer(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Settlements, waters and relief of a box, with the kind in words and whether it is a watercourse."""
    kept = rows.where(F.col("class").isin("P", "H", "T") & F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return kept.withColumn("kind", text.place_class(F.col("class"))).withColumn("watercourse", F.col("code").isin(WATERCOURSES))


def rank_scenes(scenes: DataFrame, *by: str) -> DataFrame:
    """`scenes` (complete, cloudy, seen, date, place) with rank: complete ones first, then less cloud by whole per mille, then later, then in given order."""
    per_mille = F.expr("(cloudy * 1000 + greatest(seen, 1) div 2) div greatest(seen, 1)")
    return scenes.withColumn("per_mille", per_mille).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("complete"), "per_mille", F.desc("date"), "place")))


def early_stop(scenes: DataFrame, *by: str) -> DataFrame:
    """The scenes up to the first complete one under one percent of cloud, in given order: later ones are never read."""
    clear = (F.col("complete") & (100 * F.col("cloudy") < F.greatest(F.col("seen"), F.lit(1)))).cast("int")
    before = F.max(clear).over(W.partitionBy(*by).orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return scenes.withColumn("_stop", before).where(F.coalesce("_stop", F.lit(0)) == 0).drop("_stop")


def usable_scenes(scenes: DataFrame, *by: str, most: int = 5, cloud: float = 30.0) -> DataFrame:
    """The first scenes of each request by cloud of the whole scene, under a limit: complete ones only, where there are any."""
    some = F.max(F.col("complete").cast("int")).over(W.partitionBy(*by))
    kept = scenes.where(F.col("scene_cloud") < cloud).withColumn("_some", some).where((F.col("_some") == 0) | F.col("complete"))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("scene_cloud", "scene"))).where(F.col("place") <= most).drop("_some")


def map_features(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waterways (ways of two points or more) and places (nodes) of map elements (kind, osm_id, tags JSON, line), with name and type."""
    tagged = elements.withColumn("name", text.tag(F.col("tags"), "name"))
    water = tagged.withColumn("type", text.tag(F.col("tags"), "waterway")).where((F.col("kind") == "way") & (F.size("line") > 1) & F.col("type").isin(WATERWAYS))
    places = tagged.withColumn("type", text.tag(F.col("tags"), "place")).where((F.col("kind") == "node") & F.col("type").isin(PLACES))
    return water, places
