"""A whole project: elevation of a preliminary area, the basin in it, the area enlarged until the basin fits, the final area
around the basin, all layers of it, and the record of what was decided, fetched and made."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import hydro, masks, tiles, validate, warp
from ..schemas import InputError, Parameters
from ..sources import rasters, vectors
from . import project as preliminary
from . import providers

SHAPE = "kind string, parts array<array<struct<x:double,y:double>>>"
# The layers of a delineation, by folder and name.
LAYERS = {"points": ("points", "puntos_entrada"), "areas": ("points", "areas_de_analisis"), "basin": ("derived", "cuenca_delineada"), "outlet": ("derived", "salida_ajustada"), "channel": ("derived", "cauce_principal")}


@dataclasses.dataclass
class Result:
    context: providers.Context
    project: providers.Project
    basin: hydro.Delineation | None
    enlargements: int
    work_area: warp.Ring
    final_area: warp.Ring


def start(spark, folder: str, cache: str, outlet: tuple[float, float], epsg: int, headwater: tuple[float, float] | None = None, area_km2: float | None = None, params: Parameters = Parameters(), **more) -> providers.Context:
    """The context of a project with its preliminary area; a request that can't be run is an error."""
    request = preliminary.request_frame(spark, outlet, epsg, headwater, area_km2)
    checked = validate.validate(request, params.check().pais).first()
    if checked["error"]:
        raise InputError(checked["error"])
    ring = tiles.preliminary_aoi(request, params).first()["ring"]
    ctx = providers.Context(spark, folder, cache, epsg, [(p["x"], p["y"]) for p in ring], outlet, params, **more)
    ctx.warnings += [checked["warning"]] if checked["warning"] else []
    return ctx


def measures(ctx: providers.Context, ring: warp.Ring) -> tuple[float, float]:
    """Square kilometres and kilometres around."""
    r = ctx.spark.range(1).select(geom.area(warp.shape(ring)).alias("a"), geom.length(warp.shape(ring), True).alias("l")).first()
    return r["a"] / 1e6, r["l"] / 1e3


def regrown(ctx: providers.Context, ring: warp.Ring, grow) -> tuple[warp.Ring, dict]:
    """A ring through a function of a table of areas (id, ring), and what else its row holds."""
    row = grow(ctx.spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring])], f"id int, ring {geom.POINTS}")).first().asDict(recursive=True)
    return [(p["x"], p["y"]) for p in row.pop("ring")], row


def elevation(ctx: providers.Context) -> providers.Output:
    resources = providers.dem_plan(ctx)
    if not resources:
        raise ValueError("no elevation tile covers the area")
    # the resolution of the first area holds for the later ones
    ctx.params = dataclasses.replace(ctx.params, resolucion_dem=str(resources[0].extra["metres"]))
    return providers.dem_run(ctx, resources, work=True)[0]


def delineated(ctx: providers.Context, headwater: tuple[float, float] | None) -> tuple[hydro.Delineation, int]:
    """The basin of the outlet; its area is enlarged in `ctx` while the basin touches the border of what has elevations."""
    p = ctx.params
    for rounds in range(p.max_iteraciones + 1):
        path = elevation(ctx).path
        a = rasters.layout(path)
        cells = rasters.read(ctx.spark, [path]).select("row", "col", "z")
        found = hydro.delineate(cells, (a.x0, a.y1), a.dx, ctx.outlet, headwater, p.umbral_cauce_km2, p.radio_ajuste_m)
        if not found.truncated:
            return found, rounds
        if rounds == p.max_iteraciones:
            ctx.warnings.append(f"the basin still touches the border after {rounds} enlargements and may be incomplete")
            return found, rounds
        ctx.ring, _ = regrown(ctx, ctx.ring, lambda t: tiles.enlarged_areas(t, p.factor_expansion))
        ctx.decisions.append(f"enlargement {rounds + 1}: the basin touched the border in {found.edge_cells} cells; the area is now {measures(ctx, ctx.ring)[0]:.1f} km²")
    raise AssertionError


def feature(ctx: providers.Context, kind: str, parts: list[warp.Ring], **attributes) -> DataFrame:
    types = {str: "string", float: "double", int: "long"}
    row = (kind, [[{"x": float(x), "y": float(y)} for x, y in line] for line in parts], *attributes.values())
    return ctx.spark.createDataFrame([row], ", ".join([SHAPE, *(f"{k} {types[type(v)]}" for k, v in attributes.items())]))


def saved(ctx: providers.Context, name: str, rows: DataFrame, label: str) -> providers.Output:
    path, n = vectors.write(rows, ctx.place(*LAYERS[name]), ctx.epsg, ctx.params.formato_vector)
    return providers.Output("delineation", path, label, n)


def outline(ctx: providers.Context, found: hydro.Delineation) -> list[warp.Ring]:
    """The rings of the basin's largest part, the outer one first."""
    best = masks.polygons(found.mask, found.origin, found.cell).orderBy(F.desc("area")).limit(1).first()
    return [[(p["x"], p["y"]) for p in ring] for ring in best["parts"]]


def layers_of(ctx: providers.Context, found: hydro.Delineation, parts: list[warp.Ring], work: warp.Ring) -> list[providers.Output]:
    spot = (found.origin[0] + (found.outlet[1] + 0.5) * found.cell, found.origin[1] - (found.outlet[0] + 0.5) * found.cell)
    channel = [(r["x"], r["y"]) for r in found.channel_points().orderBy(F.desc("step")).collect()]  # one river's cells, from the head down
    length = sum(math.dist(a, b) for a, b in zip(channel, channel[1:])) / 1e3
    around = sum(math.dist(a, b) for ring in parts for a, b in zip(ring, ring[1:] + ring[:1])) / 1e3
    ctx.facts["basin"] = {"km2": round(found.area_km2, 4), "outline_km": round(around, 3), "channel_km": round(length, 3), "outlet_m": round(found.outlet_z, 1), "shift_m": round(found.shift_m, 1), "headwater_drains": found.headwater_drains, "contained": not found.truncated}
    areas = feature(ctx, "polygon", [work], area="trabajo (DEM)", km2=round(measures(ctx, work)[0], 2)).unionByName(feature(ctx, "polygon", [ctx.ring], area="final (capas)", km2=round(measures(ctx, ctx.ring)[0], 2)))
    out = [
        saved(ctx, "basin", feature(ctx, "polygon", parts, area_km2=round(found.area_km2, 4), perim_km=round(around, 3), metodo="D8 + Priority-Flood"), "delineated basin"),
        saved(ctx, "outlet", feature(ctx, "point", [[spot]], desplaz_m=round(found.shift_m, 1), cota_m=round(found.outlet_z, 1)), "snapped outlet"),
        saved(ctx, "areas", areas, "areas of the analysis"),
    ]
    if len(channel) > 1:
        out.append(saved(ctx, "channel", feature(ctx, "line", [channel], long_km=round(length, 3)), "main channel"))
    ctx.outlet = spot
    return out


def run(ctx: providers.Context, headwater: tuple[float, float] | None = None) -> Result:
    """Everything from the preliminary area to the report. Without `delinear` the preliminary area is the final one."""
    first = measures(ctx, ctx.ring)[0]
    ctx.decisions.append(f"preliminary area: {first:.1f} km²")
    points = feature(ctx, "point", [[ctx.outlet]], punto="salida", x=float(ctx.outlet[0]), y=float(ctx.outlet[1]))
    if headwater:
        points = points.unionByName(feature(ctx, "point", [[headwater]], punto="cabecera", x=float(headwater[0]), y=float(headwater[1])))
    made, found, rounds, work = [saved(ctx, "points", points, "points of the request")], None, 0, ctx.ring
    if ctx.params.delinear:
        found, rounds = delineated(ctx, headwater)
        ctx.warnings += found.warnings
        parts, work = outline(ctx, found), ctx.ring
        ctx.basin = parts[0]
        ctx.ring, final = regrown(ctx, parts[0], lambda t: tiles.final_area(t, ctx.params))
        ctx.decisions.append(f"the outlet was moved {found.shift_m:.0f} m to the channel")
        ctx.decisions.append(f"final area: basin and a margin of {final['margin_m'] / 1e3:.2f} km, {measures(ctx, ctx.ring)[0]:.1f} km², {100 * measures(ctx, ctx.ring)[0] / first:.0f} % of the preliminary one")
        made += layers_of(ctx, found, parts, work)
    else:
        ctx.decisions.append("no delineation: the preliminary area is the final one")
    planned = providers.plan(ctx)
    planned.outputs += made
    providers.publish(ctx.place("results", "plan.txt"), planned.text(ctx).encode())
    return Result(ctx, providers.run(ctx, planned), found, rounds, work, ctx.ring)
