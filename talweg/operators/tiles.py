"""Areas of interest and the grid tiles that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, geom, text
from ..schemas import SHEET_WEST, Parameters
from ..session import checkpointed, spread
from . import overlay

TILE_TOLERANCE, SHEET_TOLERANCE = 1e-9, 1e-10
TILE = "array<struct<lat0:int,lon0:int,size:int>>"


def preliminary_aoi(requests: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """`requests` (x, y, epsg, head_x, head_y, area_km2; the last three may be null) with `ring`, `method` and `margin_m`.

    With a headwater: a rectangle or corridor around both points; with an area: a circle by Hack's law; else a fixed circle.
    """
    x, y, hx, hy, a = (F.col(c) for c in ("x", "y", "head_x", "head_y", "area_km2"))
    width = F.greatest(F.lit(params.buffer_minimo_m), params.k_corredor * F.hypot(hx - x, hy - y))
    by_area = F.greatest(params.factor_radio_area * text.hack_length_km(a) * 1000.0, F.lit(params.buffer_minimo_m))
    margin = F.when(hx.isNotNull(), width).when(a > 0, by_area).otherwise(params.radio_sin_cabecera_m)
    m = F.col("margin_m")
    shape = geom.box(F.least(x, hx) - m, F.least(y, hy) - m, F.greatest(x, hx) + m, F.greatest(y, hy) + m) if params.forma_aoi == "rectangulo" else geom.capsule(x, y, hx, hy, m)
    method = F.when(hx.isNotNull(), params.forma_aoi).when(a > 0, "radio_hack").otherwise("radio_fijo")
    return requests.withColumn("margin_m", margin).withColumn("method", method).withColumn("ring", F.when(hx.isNotNull(), shape).otherwise(geom.circle(x, y, m)))


def widened(aois: DataFrame, metres: Column, key: str = "id") -> DataFrame:
    """`aois` with `ring` grown to all within `metres` (a column) of it. Convex rings are grown in place, the others by an
    overlay; of these the outer line counts, so an enclosed hole is part of the area."""
    marked = aois.withColumn("_metres", metres).withColumn("_round", geom.is_convex(F.col("ring")))
    convex = marked.where("_round").withColumn("ring", geom.buffered(F.col("ring"), F.col("_metres"))).select(*aois.columns)
    other = checkpointed(marked.where("NOT _round"))
    if other.limit(1).count() == 0:
        return convex
    grown = overlay.buffered(other.select(key, "ring", "_metres"), F.col("_metres"), key).select(key, F.get("parts", F.lit(0)).alias("_ring"))
    return convex.unionByName(other.join(grown, key).withColumn("ring", F.col("_ring")).select(*aois.columns))


def enlarged(ring: Column, factor: float) -> Column:
    """All within the equal-area radius times (factor - 1) of a convex ring; another ring is an error."""
    return geom.let(ring, lambda r: geom.buffered(r, F.sqrt(geom.area(r) / F.pi()) * (factor - 1)))


def enlarged_areas(aois: DataFrame, factor: float, key: str = "id") -> DataFrame:
    """`aois` with `ring`, of any shape, grown by its equal-area radius times (factor - 1)."""
    return widened(aois, F.sqrt(geom.area(F.col("ring")) / F.pi()) * (factor - 1), key)


def final_area(basins: DataFrame, params: Parameters = Parameters(), key: str = "id") -> DataFrame:
    """`basins` (key, ring) with `margin_m` and the ring grown by it: a share of the diagonal of its bounds, a minimum at least."""
    b = geom.bounds(F.col("ring"))
    margin = F.greatest(F.lit(float(params.margen_final_min_m)), params.margen_final_frac * F.hypot(b["east"] - b["west"], b["north"] - b["south"]))
    return widened(basins.withColumn("margin_m", margin), F.col("margin_m"), key)


def to_lonlat(aois: DataFrame, step: float = 250.0) -> DataFrame:
    """`aois` with `ring_ll`: the ring in degrees, with points every 250 m so that its edges stay where they are."""
    ring = F.when(crs.is_geographic(F.col("epsg")), F.col("ring")).otherwise(geom.densify(F.col("ring"), step))
    turned = F.transform(ring, lambda p: crs.to_lonlat(p["x"], p["y"], F.col("epsg")))
    return aois.withColumn("ring_ll", F.transform(turned, lambda p: geom.point(p["lon"], p["lat"])))


def candidates(b: Column, size: int = 1) -> Column:
    """array<struct<lat0, lon0, size>>: tiles that meet a box. A border on a grid line adds none; a box without extent has one."""
    lo = lambda v: (F.floor(v / size) * size).cast("int")
    hi = lambda v: (F.ceil(v / size) * size).cast("int")
    steps = lambda a, z: F.sequence(lo(a), F.greatest(hi(z), lo(a) + size) - size, F.lit(size))
    lats = F.filter(steps(b["south"], b["north"]), lambda v: (v >= -90) & (v < 90))
    cell = lambda lat: F.transform(steps(b["west"], b["east"]), lambda lon: F.struct(lat.alias("lat0"), (F.pmod(lon + 180, F.lit(360)) - 180).cast("int").alias("lon0"), F.lit(size).alias("size")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lats, cell)))).cast(TILE)


def select(aois: DataFrame, catalogue: DataFrame | None = None, key: str = "id", size: int = 1) -> DataFrame:
    """A row per area and candidate tile: lat0, lon0, fraction of the area, and status needed, touching, outside or missing.

    `catalogue` (lat0, lon0): tiles that exist; without one all do. It is joined by equality; the optimizer broadcasts it
    where its size allows.
    """
    rows = spread(aois.select(key, "ring_ll"), key).select(key, F.col("ring_ll"), geom.area(F.col("ring_ll")).alias("total"), geom.bounds(F.col("ring_ll")).alias("b"))
    tiles = rows.select(key, "ring_ll", "total", "b", F.explode(candidates(F.col("b"), size)).alias("t"))
    w, s = F.col("t.lon0").cast("double"), F.col("t.lat0").cast("double")
    inter = tiles.select(key, "total", "t.lat0", "t.lon0", geom.overlap_area(F.col("ring_ll"), w, s, w + size, s + size).alias("inter"), geom.edge_meets(F.col("ring_ll"), w, s, w + size, s + size).alias("meets"))
    if catalogue is not None:
        inter = inter.join(catalogue.select("lat0", "lon0", F.lit(True).alias("exists")).distinct(), ["lat0", "lon0"], "left")
    else:
        inter = inter.withColumn("exists", F.lit(True))
    status = F.when(F.col("inter") <= TILE_TOLERANCE, F.when(F.col("meets"), "touching").otherwise("outside")).when(F.col("exists").isNull(), "missing").otherwise("needed")
    return inter.select(key, "lat0", "lon0", F.coalesce(F.try_divide("inter", "total"), F.lit(0.0)).alias("fraction"), status.alias("status"))


def coverage(selected: DataFrame, key: str = "id") -> DataFrame:
    """Per area: tiles found, needed and dropped, percent covered and percent without data."""
    part = lambda s: F.coalesce(100 * F.sum(F.when(F.col("status") == s, F.col("fraction"))), F.lit(0.0))
    return selected.groupBy(key).agg(F.count("*").alias("found"), F.count_if(F.col("status") == "needed").alias("needed"), F.count_if(F.col("status") != "needed").alias("dropped"), part("needed").alias("covered_pct"), part("missing").alias("missing_pct"))


def dem_metres(area_km2: Column, params: Parameters = Parameters()) -> Column:
    """30 or 90 m: the coarse model for large areas, unless set."""
    if params.resolucion_dem != "auto":
        return F.lit(int(params.resolucion_dem))
    return F.when(area_km2 > params.umbral_glo90_km2, 90).otherwise(30)


def sheets(aois: DataFrame, key: str = "id") -> DataFrame:
    """(key, sheet): the 1:100 000 sheets that an area meets."""
    b = geom.bounds(F.col("ring_ll"))
    top = F.least(F.lit(0.0), F.ceil(b["north"] / 0.5) * 0.5)
    rows = F.greatest(F.lit(0), F.ceil((top - b["south"]) / 0.5)).cast("int")
    left = SHEET_WEST + F.floor((b["west"] - SHEET_WEST) / 0.5) * 0.5
    cols = F.greatest(F.lit(0), F.ceil((b["east"] - left) / 0.5)).cast("int")
    grid = spread(aois.select(key, "ring_ll"), key).where((rows > 0) & (cols > 0)).select(key, "ring_ll", top.alias("top"), left.alias("left"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), cols.alias("cols"))
    cells = grid.select(key, "ring_ll", (F.col("top") - 0.5 * F.col("i")).alias("n"), "left", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j")).select(key, "ring_ll", "n", (F.col("left") + 0.5 * F.col("j")).alias("w"))
    met = cells.where(geom.overlap_area(F.col("ring_ll"), F.col("w"), F.col("n") - 0.5, F.col("w") + 0.5, F.col("n")) > SHEET_TOLERANCE)
    return met.select(key, text.sheet_code(F.col("w") + 0.25, F.col("n") - 0.25).alias("sheet")).where("sheet IS NOT NULL").distinct()
