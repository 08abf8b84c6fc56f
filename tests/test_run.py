"""A whole project against a local server: the area grows until the basin fits; and masks of large rings."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from talweg.functions import geom
from talweg.operators import raster
from talweg.plans import providers, run
from talweg.schemas import InputError, Parameters
from talweg.sources import rasters, vectors
from test_providers import grid, put, served  # noqa: F401

EPSG, OUTLET = 32718, (459_000.0, 8_769_000.0)


def test_from_outlet_to_layers(spark, served, tmp_path):  # noqa: F811
    server, base = served
    dem = "Copernicus_DSM_COG_10_S12_00_W076_00_DEM"
    put(server, "dem/tileList.txt", f"{dem}\n")
    ctx = run.start(spark, str(tmp_path / "project"), str(tmp_path / "store"), OUTLET, EPSG, params=Parameters(radio_sin_cabecera_m=1500.0, buffer_minimo_m=500.0, excluir=frozenset({"unidades", "rios", "limites", "toponimia", "imagen"})), addresses={"dem30": f"{base}/dem"}, pause=0.0)
    lon, lat = ctx.point_ll()
    n = 1200
    u, v = F.abs((-76 + (F.col("col") + 0.5) / n - lon) * 109_300), (-11 - (F.col("row") + 0.5) / n - lat) * 110_600
    along = F.when(v > 2500, 5000 - v).otherwise(v)  # a ridge 2.5 km up the valley, others 1 km aside
    z = 1000 + 0.05 * along + F.when(u > 1000, 200 - 0.1 * u).otherwise(0.1 * u)
    tif = rasters.write(grid(spark, n, n, F.lit(0)).withColumn("z", z.cast("double")), str(tmp_path / "dem.tif"), n, n, -76.0, -11.0, 1 / n, 4326)
    put(server, f"dem/{dem}/{dem}.tif", open(tif, "rb").read())
    done = run.run(ctx)
    assert not done.project.errors and done.enlargements == 2 and not done.basin.truncated
    assert 3 < done.basin.area_km2 < 5 and done.basin.shift_m < 150
    made = {o.label: o for o in done.project.outputs}
    assert {"points of the request", "delineated basin", "snapped outlet", "areas of the analysis", "main channel", "elevation, 30 m"} == set(made)
    read = lambda label: vectors.read(spark, made[label].path)
    basin = read("delineated basin").first()
    assert abs(basin["area_km2"] - done.basin.area_km2) < 1e-3
    final, work = (spark.range(1).select(geom.area(F.array(*[geom.point(x, y) for x, y in ring])).alias("a")).first()["a"] / 1e6 for ring in (done.final_area, done.work_area))
    assert sorted(round(r["km2"], 2) for r in read("areas of the analysis").collect()) == sorted((round(final, 2), round(work, 2)))
    # everything within the margin of the basin, and nothing else: the final area is the basin's buffer
    margin = max(1000.0, 0.1 * math.hypot(*(max(p[i] for p in ctx.basin) - min(p[i] for p in ctx.basin) for i in (0, 1))))
    assert abs(max(p[1] for p in done.final_area) - max(p[1] for p in ctx.basin) - margin) < 0.01 * margin
    channel = read("main channel").first()
    assert 1.5 < channel["long_km"] < 3.5 and channel["parts"][0][-1]["y"] < channel["parts"][0][0]["y"]
    folder = f"{ctx.folder}/10_Resultados"
    kept = json.load(open(f"{folder}/manifest.json"))
    assert sum("enlargement" in d for d in kept["decisions"]) == 2 and len(kept["products"]) == 6
    text = open(f"{folder}/report.md").read()
    assert open(f"{folder}/plan.txt").read().startswith("dem: 1 resources") and kept["services"] == []
    assert "Basin" in text and "Main channel" in text and os.path.exists(f"{ctx.folder}/01_Coordenadas/puntos_entrada.gpkg")
    with pytest.raises(InputError):
        run.start(spark, str(tmp_path), str(tmp_path), (1.0, 2.0), EPSG)


def test_masks_by_rows_equal_tests_of_each_cell(spark):
    import random

    r = random.Random(3)
    shapes = []
    for k in range(6):
        ring = [(r.uniform(-5, 45), r.uniform(-5, 35)) for _ in range(r.choice([3, 8, 40]))]
        shapes.append((k, [ring, [(10, 10), (10, 20), (20, 20), (20, 10)]]))
    table = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in p] for p in ps]) for k, ps in shapes], f"id int, parts array<{geom.POINTS}>")
    got = {tuple(x) for x in raster.covered(table, 0.0, 30.0, 0.5, 60, 80).collect()}
    at = spark.range(4800).select(F.floor(F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    each = at.crossJoin(table).where(geom.within_parts(F.col("parts"), (F.col("col") + 0.5) * 0.5, 30 - (F.col("row") + 0.5) * 0.5))
    assert got == {tuple(x) for x in each.select("id", "row", "col").collect()}
    assert raster.covered(table.limit(0), 0.0, 30.0, 0.5, 60, 80).count() == 0


def test_a_ring_of_many_vertices_over_ten_million_cells(spark):
    n, size = 10_000, 3200
    bend = lambda k: 1500 * (1 + 0.05 * math.sin(40 * math.pi * k / n))
    ring = [(1600 + bend(k) * math.cos(2 * math.pi * k / n), 1600 + bend(k) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    table = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], f"id int, parts array<{geom.POINTS}>")
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    cells = raster.covered(table, 0.0, float(size), 1.0, size, size).count()
    assert abs(cells - area) < 1e-4 * area
