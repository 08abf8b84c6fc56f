"""A project from request to basin: plan without data, then delineation with a growing area."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import hydro, tiles, validate
from ..schemas import InputError, Parameters, active_providers

#: The numbered folders of a project, by what they hold.
FOLDERS = {k: f"{i:02d}_{k}" for i, k in enumerate(["input", "area", "dem", "basin", "units", "rivers", "admin", "places", "images", "record"], 1)}


@dataclasses.dataclass
class Plan:
    aoi: DataFrame
    tiles: DataFrame
    metres: int
    providers: list[str]
    failures: dict[str, str]
    plans: dict[str, object]
    warnings: list[str]


def request_frame(spark: SparkSession, outlet: tuple[float, float], epsg: int, headwater: tuple[float, float] | None = None, area_km2: float | None = None) -> DataFrame:
    hx, hy = headwater or (None, None)
    return spark.createDataFrame([(1, float(outlet[0]), float(outlet[1]), epsg, hx, hy, area_km2)], "id int, x double, y double, epsg int, head_x double, head_y double, area_km2 double")


def analyse(request: DataFrame, params: Parameters = Parameters(), catalogue: DataFrame | None = None, planners: dict[str, Callable[[DataFrame], object]] | None = None) -> Plan:
    """Everything that can be decided before data is read. A planner that fails becomes a message, the others go on."""
    params = params.check()
    checked = validate.validate(request, params.pais).first()
    if checked["error"]:
        raise InputError(checked["error"])
    aoi = tiles.to_lonlat(tiles.preliminary_aoi(request, params))
    padded = tiles.to_lonlat(tiles.widened(aoi.drop("ring_ll"), F.lit(float(params.relleno_tiles_m))))
    metres = aoi.select(tiles.dem_metres(geom.area(F.col("ring")) / 1e6, params).alias("m")).first()["m"]
    names, plans, failures = active_providers(params), {}, {}
    for name in names:
        if planner := (planners or {}).get(name):
            try:
                plans[name] = planner(aoi)
            except (OSError, ValueError, RuntimeError) as e:
                failures[name] = f"{type(e).__name__}: {e}"
    return Plan(aoi, tiles.select(padded, catalogue), metres, names, failures, plans, [checked["warning"]] if checked["warning"] else [])


def delineate_growing(read_cells: Callable[[tuple[float, float, float, float]], tuple[DataFrame, tuple[float, float], float]], box: tuple[float, float, float, float], outlet: tuple[float, float], headwater: tuple[float, float] | None = None, params: Parameters = Parameters()) -> tuple[hydro.Delineation, tuple[float, float, float, float], int]:
    """Delineates within a box (west, south, east, north) and enlarges it until the basin fits or the limit is reached.

    `read_cells` gives cells, north-west corner and cell size for a box. Returns the basin, the last box and the enlargements.
    """
    for rounds in range(params.max_iteraciones + 1):
        cells, origin, size = read_cells(box)
        found = hydro.delineate(cells, origin, size, outlet, headwater, params.umbral_cauce_km2, params.radio_ajuste_m)
        if not found.truncated or rounds == params.max_iteraciones:
            return found, box, rounds
        r = ((box[2] - box[0]) * (box[3] - box[1]) / 3.141592653589793) ** 0.5 * (params.factor_expansion - 1)
        box = (box[0] - r, box[1] - r, box[2] + r, box[3] + r)
    raise AssertionError
