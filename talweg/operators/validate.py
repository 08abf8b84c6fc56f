"""Checks of input points. Errors are codes in a column, the first that applies; nothing stops the other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, geom
from ..schemas import COUNTRIES, REGIONS

TOLERANCE_DEG = 1.5


def in_box(lon: Column, lat: Column, west, south, east, north) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def country_test(lon: Column, lat: Column, country: str) -> Column:
    box = next((c[1:] for c in COUNTRIES if c[0] == (country or "").upper()), None)
    return in_box(lon, lat, *box) if box else F.lit(True)


def point_error(x: Column, y: Column, epsg: Column, country: str = "PER") -> Column:
    """number, range, area_of_use or country; null where the point is fine."""
    meridian = crs.central_meridian(epsg)
    south, north = F.when(crs.is_south(epsg), -80.0).otherwise(0.0), F.when(crs.is_south(epsg), 0.0).otherwise(84.0)
    ranged = F.when(crs.is_geographic(epsg), x.between(-180, 180) & y.between(-90, 90)).otherwise(x.between(100_000, 900_000) & y.between(0, 10_000_000))
    used = lambda ll: crs.is_geographic(epsg) | in_box(ll["lon"], ll["lat"], meridian - 3 - TOLERANCE_DEG, south - TOLERANCE_DEG, meridian + 3 + TOLERANCE_DEG, north + TOLERANCE_DEG)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    placed = lambda ll: F.when(~used(ll), "area_of_use").when(~country_test(ll["lon"], ll["lat"], country), "country")
    return F.when(bad(x) | bad(y), "number").when(~ranged, "range").otherwise(geom.let(crs.to_lonlat(x, y, epsg), placed))


def validate(requests: DataFrame, country: str = "PER") -> DataFrame:
    """`requests` (x, y, epsg, head_x, head_y) with distance_m, `error` (outlet first, then headwater, then distance) and `warning`."""
    x, y, hx, hy, e = (F.col(c) for c in ("x", "y", "head_x", "head_y", "epsg"))
    planar = F.hypot(hx - x, hy - y)
    d = F.when(crs.is_geographic(e), F.hypot((hx - x) * 111_320 * F.cos(F.radians(y)), (hy - y) * 110_570)).otherwise(planar)
    far = F.when(d < 60, "same_point").when(d > 1_000_000, "too_far")
    head = F.when(hx.isNotNull() | hy.isNotNull(), point_error(hx, hy, e, country))
    error = F.coalesce(point_error(x, y, e, country), head, far)
    return requests.withColumn("distance_m", d).withColumn("error", error).withColumn("warning", F.when(error.isNull() & (d < 300), "close_points"))


def on_land(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """`points` (lon, lat, …) with on_land: an elevation tile of the catalogue (lat0, lon0) holds them."""
    tiles = catalogue.select(F.col("lat0").alias("_lat0"), F.col("lon0").alias("_lon0"), F.lit(True).alias("_land")).distinct()
    joined = points.join(tiles, (F.floor("lat") == F.col("_lat0")) & (F.floor("lon") == F.col("_lon0")), "left")
    return joined.select(*points.columns, F.col("_land").isNotNull().alias("on_land"))


def suggest_zone(points: DataFrame, catalogue: DataFrame | None = None, key: str = "id", country: str = "PER") -> DataFrame:
    """(key, zone): of the zones up to three away, the nearest in which the point is in the country and on land; the lower of two."""
    z = crs.zone_of(F.col("epsg"))
    others = F.filter(F.sequence(F.greatest(F.lit(1), z - 3), F.least(F.lit(60), z + 3)), lambda k: k != z)
    tried = points.where(crs.is_utm(F.col("epsg"))).select(key, "x", "y", z.alias("own"), (F.col("epsg") - z).alias("base"), F.explode(others).alias("zone"))
    placed = tried.withColumn("ll", crs.to_lonlat(F.col("x"), F.col("y"), F.col("base") + F.col("zone"))).select(key, "own", "zone", "ll.lon", "ll.lat").where(country_test(F.col("lon"), F.col("lat"), country))
    if catalogue is not None:
        placed = on_land(placed, catalogue).where("on_land")
    best = placed.groupBy(key).agg(F.min_by("zone", F.struct(F.abs(F.col("zone") - F.col("own")), F.col("zone"))).alias("zone"))
    return points.select(key).join(best, key, "left")


def river_region(lon: Column, lat: Column, forced: Column | None = None) -> Column:
    """The region of the river network: forced, South America by its short cut, or the one box that holds the point; null if not exactly one does."""
    hits = F.filter(F.array(*[F.when(in_box(lon, lat, *r[1:]), r[0]) for r in REGIONS]), lambda r: r.isNotNull())
    found = F.when((lon <= -32) & (lat < 5) & F.array_contains(hits, "sa"), "sa").when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    return found if forced is None else F.coalesce(F.lower(forced), found)
