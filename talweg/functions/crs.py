"""UTM to longitude and latitude and back, as column expressions: the third-order Krüger series in n."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geom import let

SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


class Ellipsoid:
    """An ellipsoid with the coefficients of its series."""

    def __init__(self, axis: float, flattening: float) -> None:
        n = flattening / (2 - flattening)
        self.axis, self.e2 = axis, flattening * (2 - flattening)
        self.radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
        self.first = 2 * math.sqrt(n) / (1 + n)


WGS84, INTERNATIONAL = Ellipsoid(6378137.0, 1 / 298.257223563), Ellipsoid(6378388.0, 1 / 297.0)
RADIUS, FORWARD, INVERSE, LATITUDE, FIRST = WGS84.radius, WGS84.forward, WGS84.inverse, WGS84.latitude, WGS84.first
# Geocentric shift of PSAD56 to WGS 84 for Peru, in metres.
PSAD56_SHIFT = (-279.0, 175.0, -379.0)
# Codes of longitude and latitude that agree with WGS 84 to centimetres.
GEOGRAPHIC = (4326, 4674)
# UTM codes, as (first, last, zone of code 0, south).
UTM_RANGES = [(32601, 32660, 32600, False), (32701, 32760, 32700, True), (31965, 31976, 31954, False), (31977, 31985, 31960, True), (24817, 24821, 24800, False), (24877, 24882, 24860, True)]


def is_geographic(epsg: Column) -> Column:
    return epsg.isin(*GEOGRAPHIC)


def is_psad56(epsg: Column) -> Column:
    return epsg.between(24817, 24821) | epsg.between(24877, 24882)


def is_utm(epsg: Column) -> Column:
    """UTM codes of WGS 84, SIRGAS 2000 (taken as WGS 84, which it matches to centimetres) and PSAD56."""
    return zone_of(epsg).isNotNull()


def zone_of(epsg: Column) -> Column:
    return F.coalesce(*[F.when(epsg.between(a, z), epsg - base) for a, z, base, _ in UTM_RANGES]).cast("int")


def is_south(epsg: Column) -> Column:
    return F.coalesce(*[F.when(epsg.between(a, z), F.lit(south)) for a, z, _, south in UTM_RANGES], F.lit(False))


def central_meridian(epsg: Column) -> Column:
    return zone_of(epsg) * 6.0 - 183.0


def unprojected(x: Column, y: Column, meridian: Column, south: Column, on: Ellipsoid) -> Column:
    """struct<lon, lat> on an ellipsoid; every step is bound, so none is written out twice."""

    def spread(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        xi_ = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(on.inverse)), F.lit(0.0))
        eta_ = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(on.inverse)), F.lit(0.0))
        return F.struct(xi_.alias("xi"), eta_.alias("eta"))

    def angles(q: Column) -> Column:
        lat = lambda chi: F.degrees(chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(on.latitude)), F.lit(0.0)))
        lon = meridian + F.degrees(F.atan2(F.sinh(q["eta"]), F.cos(q["xi"])))
        return F.struct(lon.alias("lon"), let(F.asin(F.sin(q["xi"]) / F.cosh(q["eta"])), lat).alias("lat"))

    scaled = F.struct(((y - F.when(south, FALSE_NORTH).otherwise(0.0)) / (SCALE * on.radius)).alias("xi"), ((x - FALSE_EAST) / (SCALE * on.radius)).alias("eta"))
    return let(scaled, lambda p: let(spread(p), angles))


def shifted(ll: Column, source: Ellipsoid, target: Ellipsoid, by: tuple[float, float, float]) -> Column:
    """struct<lon, lat> on another datum, by way of geocentric coordinates (Bowring's closed form back)."""

    def moved(a: Column) -> Column:
        v = source.axis / F.sqrt(1 - source.e2 * F.sin(a["lat"]) * F.sin(a["lat"]))
        return F.struct((v * F.cos(a["lat"]) * F.cos(a["lon"]) + by[0]).alias("x"), (v * F.cos(a["lat"]) * F.sin(a["lon"]) + by[1]).alias("y"), (v * (1 - source.e2) * F.sin(a["lat"]) + by[2]).alias("z"))

    def back(g: Column) -> Column:
        b = target.axis * math.sqrt(1 - target.e2)
        p = F.hypot(g["x"], g["y"])
        lat = lambda t: F.degrees(F.atan2(g["z"] + target.e2 / (1 - target.e2) * b * F.pow(F.sin(t), F.lit(3)), p - target.e2 * target.axis * F.pow(F.cos(t), F.lit(3))))
        return F.struct(F.degrees(F.atan2(g["y"], g["x"])).alias("lon"), let(F.atan2(g["z"] * target.axis, p * b), lat).alias("lat"))

    return let(F.struct(F.radians(ll["lon"]).alias("lon"), F.radians(ll["lat"]).alias("lat")), lambda a: let(moved(a), back))


def to_lonlat(x: Column, y: Column, epsg: Column) -> Column:
    """struct<lon, lat> in WGS 84: geographic coordinates as they are, UTM ones by the inverse series, others null."""
    meridian, south = central_meridian(epsg), is_south(epsg)
    old = shifted(unprojected(x, y, meridian, south, INTERNATIONAL), INTERNATIONAL, WGS84, PSAD56_SHIFT)
    plain = F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    return F.when(is_geographic(epsg), plain).when(is_psad56(epsg), old).when(is_utm(epsg), unprojected(x, y, meridian, south, WGS84))


def projected(lon: Column, lat: Column, meridian: Column, south: Column, on: Ellipsoid) -> Column:
    """struct<x, y> of longitude and latitude on an ellipsoid."""
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))

    def sphere(s: Column) -> Column:
        t, d = F.sinh(atanh(s) - on.first * atanh(on.first * s)), F.radians(lon - meridian)
        return let(F.struct(t.alias("t"), d.alias("d")), lambda q: F.struct(F.atan2(q["t"], F.cos(q["d"])).alias("xi"), atanh(F.sin(q["d"]) / F.sqrt(1 + q["t"] * q["t"])).alias("eta")))

    def plane(p: Column) -> Column:
        xi = p["xi"] + sum((a * F.sin(2 * (j + 1) * p["xi"]) * F.cosh(2 * (j + 1) * p["eta"]) for j, a in enumerate(on.forward)), F.lit(0.0))
        eta = p["eta"] + sum((a * F.cos(2 * (j + 1) * p["xi"]) * F.sinh(2 * (j + 1) * p["eta"]) for j, a in enumerate(on.forward)), F.lit(0.0))
        return F.struct((FALSE_EAST + SCALE * on.radius * eta).alias("x"), (F.when(south, FALSE_NORTH).otherwise(0.0) + SCALE * on.radius * xi).alias("y"))

    return let(let(F.sin(F.radians(lat)), sphere), plane)


def unshifted(lon: Column, lat: Column) -> Column:
    """struct<lon, lat> in PSAD56 of WGS 84. Either way drops a height of some metres, which leaves millimetres; one step back takes these out."""
    back = tuple(-v for v in PSAD56_SHIFT)
    ll = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    near = shifted(ll(lon, lat), WGS84, INTERNATIONAL, back)
    return let(near, lambda p: let(shifted(p, INTERNATIONAL, WGS84, PSAD56_SHIFT), lambda q: ll(p["lon"] + (lon - q["lon"]), p["lat"] + (lat - q["lat"]))))


def from_lonlat(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct<x, y> in the UTM system `epsg`, of WGS 84 or PSAD56; null for other systems."""
    meridian, south = central_meridian(epsg), is_south(epsg)
    old = let(unshifted(lon, lat), lambda p: projected(p["lon"], p["lat"], meridian, south, INTERNATIONAL))
    return F.when(is_psad56(epsg), old).when(is_utm(epsg), projected(lon, lat, meridian, south, WGS84))


def known(epsg: int) -> bool:
    """Whether a code is one of the systems that coordinates can be brought to."""
    return epsg in GEOGRAPHIC or any(a <= epsg <= z for a, z, *_ in UTM_RANGES)


def resolve_system(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """`requests` (epsg, zone, hemisphere, datum; each may be null) with resolved_epsg and an `error` code.

    The hemisphere's first letter counts. Codes, the first that applies: hemisphere (neither N nor S), zone (not 1 to 60),
    missing (no code, and zone or hemisphere absent), datum (none for that hemisphere), not_utm (neither UTM nor
    geographic), zone_mismatch, hemisphere_mismatch.
    """
    hemi = F.upper(F.substring(F.trim("hemisphere"), 1, 1))
    datum = F.upper(F.regexp_replace(F.coalesce("datum", F.lit("WGS84")), "[ -]", ""))
    r = requests.alias("r").join(F.broadcast(bases.withColumnRenamed("datum", "_d").withColumnRenamed("hemisphere", "_h")), (datum == F.col("_d")) & (hemi == F.col("_h")), "left")
    code = F.coalesce("epsg", F.col("base") + F.col("zone"))
    own = F.when(is_south(code), "S").otherwise("N")
    error = (
        F.when(F.col("hemisphere").isNotNull() & ~hemi.isin("N", "S"), "hemisphere")
        .when(~F.col("zone").between(1, 60), "zone")
        .when(F.col("epsg").isNull() & (F.col("zone").isNull() | hemi.isNull()), "missing")
        .when(F.col("epsg").isNull() & F.col("base").isNull(), "datum")
        .when(~is_geographic(code) & ~is_utm(code), "not_utm")
        .when(is_utm(code) & (F.col("zone") != zone_of(code)), "zone_mismatch")
        .when(is_utm(code) & (hemi != own), "hemisphere_mismatch")
    )
    return r.select("r.*", F.when(error.isNull(), code).alias("resolved_epsg"), error.alias("error"))
