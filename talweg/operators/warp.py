"""Raster files brought to the grid of an area: window, mosaic, resampling by blocks and mask as one job."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geom
from ..sources import rasters
from . import raster

Ring = list[tuple[float, float]]


@dataclasses.dataclass(frozen=True)
class Grid:
    x0: float
    y1: float
    width: int
    height: int
    cell: float
    epsg: int


def grid_over(ring: Ring, cell: float, epsg: int, most: int = 30_000_000) -> Grid:
    """The grid of whole cells over a ring's bounds; more than `most` cells are an error."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    x0, y1 = math.floor(min(xs) / cell) * cell, math.ceil(max(ys) / cell) * cell
    width, height = max(1, math.ceil((max(xs) - x0) / cell)), max(1, math.ceil((y1 - min(ys)) / cell))
    if width * height > most:
        raise ValueError(f"{width} x {height} cells are more than {most}")
    return Grid(x0, y1, width, height, cell, epsg)


def shape(ring: Ring) -> Column:
    return F.array(*[geom.point(float(x), float(y)) for x, y in ring])


def between(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y> of a point of one system in another; an unknown system is an error."""
    if unknown := [e for e in (source, target) if not crs.known(e)]:
        raise ValueError(f"unknown coordinate system {unknown[0]}")
    if source == target:
        return geom.point(x, y)
    ll = crs.to_lonlat(x, y, F.lit(source))
    return geom.let(ll, lambda p: geom.point(p["lon"], p["lat"]) if target in crs.GEOGRAPHIC else crs.from_lonlat(p["lon"], p["lat"], F.lit(target)))


def box_in(spark: SparkSession, ring: Ring, source: int, target: int, pad: float = 0.0) -> tuple[float, float, float, float]:
    """The bounds of a ring in another system, its edges followed in 21 steps at least, with a pad."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    step = max(max(xs) - min(xs), max(ys) - min(ys), 1e-9) / 21
    turned = F.transform(geom.densify(F.col("ring"), step), lambda p: between(p["x"], p["y"], source, target))
    b = spark.range(1).select(shape(ring).alias("ring")).select(geom.bounds(turned).alias("b")).first()["b"]
    return b["west"] - pad, b["south"] - pad, b["east"] + pad, b["north"] + pad


def warped(spark: SparkSession, paths: list[str], ring: Ring, epsg: int, cell: float, how: str = "bilinear", most: int = 30_000_000, band: int = 0, skip: float | None = None) -> tuple[DataFrame, Grid]:
    """(cells row, col, z; grid): files in the grid of a ring, cells outside of it missing, never 0.

    Only blocks that meet the ring's box are read. Of overlapping files the first with a valid cell counts. Files of one
    lattice are resampled together, so that no seam shows where tiles meet; lattices that differ are resampled each and
    laid over one another in the order of their first files. `skip` is a value that is missing too (class 0). Files of an
    unknown system are taken as geographic.
    """
    grid = grid_over(ring, cell, epsg, most)
    number = F.col("id")
    # 512 x 512 target cells a group at most, however coarse the files are.
    piece = F.floor(number / grid.width / 512) * (grid.width // 512 + 1) + F.floor(number % grid.width / 512)
    area = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ring]])], f"area int, parts array<{geom.POINTS}>")
    inside = raster.covered(area, grid.x0, grid.y1, cell, grid.height, grid.width, "area")
    target = inside.select((F.col("row").cast("long") * grid.width + F.col("col")).alias("id"), "row", "col", raster.centre(F.col("row"), F.col("col"), grid.x0, grid.y1, cell).alias("p"))
    lattices: dict[tuple, list[str]] = {}
    for path in dict.fromkeys(paths):
        a = rasters.layout(path)
        phase = lambda v, step: round(v / step % 1, 3) % 1
        lattices.setdefault((a.epsg or 4326, a.dx, a.dy, phase(a.x0, a.dx), phase(a.y1, a.dy)), []).append(path)
    layers = None
    for place, ((system, dx, dy, *_), files) in enumerate(lattices.items()):
        first = rasters.layout(files[0])
        box = box_in(spark, ring, epsg, system, 0.01 if system == 4326 else 2 * dx)
        order = F.create_map(*[v for i, f in enumerate(files) for v in (F.lit(f), F.lit(i))])
        cells = rasters.read(spark, files, box, band).where(F.lit(True) if skip is None else F.col("z") != skip)
        source = raster.mosaic(cells.select(F.round((first.y1 - F.col("y")) / dy - 0.5).cast("int").alias("row"), F.round((F.col("x") - first.x0) / dx - 0.5).cast("int").alias("col"), "z", order[F.col("path")].alias("priority")))
        q = target.withColumn("q", between(F.col("p.x"), F.col("p.y"), epsg, system)).select("id", ((F.col("q.x") - first.x0) / dx).alias("u"), ((first.y1 - F.col("q.y")) / dy).alias("v"))
        found = raster.sampled(q, source, "id", how, piece=piece).select("id", "z", F.lit(place).alias("priority"))
        layers = found if layers is None else layers.unionByName(found)
    if layers is None:
        raise ValueError("no files to warp")
    if len(lattices) > 1:
        layers = layers.groupBy("id").agg(F.min_by("z", "priority").alias("z"))
    return layers.select(F.floor(number / grid.width).cast("int").alias("row"), (number % grid.width).cast("int").alias("col"), "z"), grid
