"""Geographic inputs derived from the driver's tables by rules, for the registered queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

UNIT = 1048576

#: Rows of a table that a task makes cells of.
ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, epsg): customers spread over zone 18 south."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (300000 + k * 7919 % 400000).cast("double").alias("x"), (8600000 + k * 104729 % 400000).cast("double").alias("y"), F.lit(32718).alias("epsg"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a headwater for two in three and an area for some of the others."""
    i = F.col("id")
    head = lambda v, m, s: F.when(i % 3 != 0, v + (i % m - 3) * s)
    return points(spark, sf_dir).select("*", head(F.col("x"), 7, 2000.0).cast("double").alias("head_x"), head(F.col("y"), 5, 3000.0).cast("double").alias("head_y"), F.when(i % 6 == 0, (i % 500 + 1).cast("double")).alias("area_km2"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring_ll): boxes in degrees."""
    from ..functions import geom

    k = F.col("c_custkey")
    w, s = -81.0 + (k * 31 % 1200) / 100.0, -18.0 + (k * 17 % 1700) / 100.0
    return table(spark, sf_dir, "customer").select(k.alias("id"), geom.box(w, s, w + (k % 9 + 1) / 4.0, s + (k % 7 + 1) / 4.0).alias("ring_ll"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, parts): customers as notched pentagons of 1 to 5 km, some of 60 km more, that overlap here and there."""
    from ..functions import geom

    k = F.col("c_custkey")
    x, y = 300000 + k * 7919 % 400000, 8600000 + k * 104729 % 400000
    s = (k * 131 % 1000 + 200) * 4 + F.when(k % 97 == 0, 60000).otherwise(0)
    corners = [(x - s + 0.5, y - s + 0.25), (x + s + 0.125, y - s / 2 + 0.5), (x + s / 4 + 0.25, y + 0.75), (x + s + 0.5, y + s + 0.125), (x - s / 2 + 0.75, y + s + 0.625)]
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("polygon").alias("kind"), F.array(F.array(*[geom.point(a, b) for a, b in corners])).alias("parts"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, parts): parts of the table `part` as points over the same ground."""
    from ..functions import geom

    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.lit("point").alias("kind"), F.array(F.array(geom.point((300000 + k * 6151 % 400000).cast("double"), (8600000 + k * 92821 % 400000).cast("double")))).alias("parts"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring, radius): customers as L-shaped rings of 400 to 1600 m."""
    from ..functions import geom

    k = F.col("c_custkey")
    x, y, s = k * 7919 % 400000, k * 104729 % 400000, k * 37 % 1200 + 400
    a = F.floor(s / 3)
    corners = [(x, y), (x + s, y), (x + s, y + a), (x + a, y + a), (x + a, y + s), (x, y + s)]
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array(*[geom.point(p.cast("double"), q.cast("double")) for p, q in corners]).alias("ring"), (k % 90 + 10).cast("double").alias("radius"))


def catalogue(spark: SparkSession) -> DataFrame:
    """(lat0, lon0): tiles of the region but for a fifth of them."""
    lat, lon = spark.range(-90, 90).withColumnRenamed("id", "lat0"), F.explode(F.sequence(F.lit(-180), F.lit(179))).alias("lon0")
    return lat.select(F.col("lat0").cast("int").alias("lat0"), lon).where((F.col("lat0") * 31 + F.col("lon0")) % 5 != 0)


def side(rows: int) -> int:
    """The side of the grid of a table: about ten rows for each cell, 40 at least."""
    return max(40, math.isqrt(rows // 10) // 8 * 8)


def dem(spark: SparkSession, sf_dir: str, unit: int = UNIT) -> DataFrame:
    """(row, col, z): a square grid of whole elevations that grows with the table; places without a row are holes.

    Few rows of a cell lie together, so rows are dealt to more tasks the more there are, to bound what a task holds. The
    lowest price is rounded, not every one: rounding keeps their order.
    """
    li = table(spark, sf_dir, "lineitem")
    width = side(li.count())
    rows = li.select((F.col("l_orderkey") % width).cast("int").alias("row"), (F.col("l_partkey") % width).cast("int").alias("col"), "l_extendedprice")
    return spread(rows, "row", "col", rows=ROWS).groupBy("row", "col").agg((F.round(F.min("l_extendedprice")).cast("long") * unit).alias("z"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, scene, complete, scene_cloud, date, place, cloudy, seen): events as the class cells of images."""
    from pyspark.sql.window import Window as W

    from ..operators import raster

    u = F.col("user_id")
    cells = table(spark, sf_dir, "events").select((u % 50).alias("request"), u.alias("scene"), (F.col("event_id") % 12).cast("int").alias("class"), F.to_date("ts").alias("day"))
    counted = raster.cloud_counts(cells, "request", "scene").drop("cloud_pct")
    days = cells.groupBy("scene").agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("date"))
    s = F.col("scene")
    return counted.join(days, "scene").select("request", "scene", (s % 3 != 0).alias("complete"), (s % 40).cast("double").alias("scene_cloud"), "date", F.row_number().over(W.partitionBy("request").orderBy("scene")).alias("place"), "cloudy", "seen")
