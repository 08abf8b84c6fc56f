"""Analytic answers: projections, areas, tiles, checks, flow, grids, layers, records."""

import heapq
import http.server
import json
import math
import random
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import crs, geom, text
from talweg.operators import hydro, layers, provenance, raster, tiles, validate, warp
from talweg.plans import project
from talweg.schemas import InputError, Parameters, active_providers, load_request, utm_bases
from talweg.sources import files, http as web

OUTLET, HEAD = (459329.724, 8769071.156), (458566.19, 8764100.15)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_projection_of_a_known_place(spark):
    p = one(spark, crs.to_lonlat(F.lit(OUTLET[0]), F.lit(OUTLET[1]), F.lit(32718)))
    assert abs(p["lon"] + 75.3725) < 1e-3 and abs(p["lat"] + 11.1350) < 1e-3
    q = one(spark, crs.from_lonlat(F.lit(p["lon"]), F.lit(p["lat"]), F.lit(32718)))
    assert math.hypot(q["x"] - OUTLET[0], q["y"] - OUTLET[1]) < 1e-3


def test_systems(spark):
    rows = [(None, 18, "S", "WGS84"), (None, 18, "south", "PSAD56"), (32718, 17, None, None), (4326, None, None, None), (3857, None, None, None), (None, 99, "S", None)]
    got = [(r["resolved_epsg"], r["error"]) for r in crs.resolve_system(spark.createDataFrame(rows, "epsg int, zone int, hemisphere string, datum string").coalesce(1), utm_bases(spark)).collect()]
    assert sorted(got, key=str) == sorted([(32718, None), (24878, None), (None, "zone_mismatch"), (4326, None), (None, "not_utm"), (None, "zone")], key=str)


def test_point_checks(spark):
    rows = [(1, *OUTLET, 32718, *HEAD), (2, OUTLET[1], OUTLET[0], 32718, None, None), (3, *OUTLET, 32718, OUTLET[0] + 10, OUTLET[1]), (4, *OUTLET, 32718, OUTLET[0] + 200, OUTLET[1]), (5, float("nan"), OUTLET[1], 32718, None, None)]
    got = {r["id"]: (r["error"], r["warning"]) for r in validate.validate(spark.createDataFrame(rows, "id int, x double, y double, epsg int, head_x double, head_y double")).collect()}
    assert got == {1: (None, None), 2: ("range", None), 3: ("same_point", None), 4: (None, "close_points"), 5: ("number", None)}


def broken(_):
    raise OSError("down")


def test_area_of_interest_and_growth(spark):
    req = project.request_frame(spark, OUTLET, 32718, HEAD)
    aoi = tiles.preliminary_aoi(req)
    r = aoi.select(geom.area(F.col("ring")).alias("a"), geom.contains(F.col("ring"), F.lit(OUTLET[0]), F.lit(OUTLET[1])).alias("in"), geom.area(tiles.enlarged(F.col("ring"), 1.6)).alias("b")).first()
    assert abs(r["a"] / 1e6 - 74.8) < 0.1 and r["in"] and r["b"] > 1.8 * r["a"]
    plan = project.analyse(req, planners={"rios": broken})
    assert plan.failures == {"rios": "OSError: down"} and plan.metres == 30 and plan.tiles.where("status = 'needed'").count() >= 1
    with pytest.raises(InputError):
        project.analyse(project.request_frame(spark, (1.0, 2.0), 32718))


def test_diagonal_corridor_leaves_out_a_tile(spark):
    a = spark.range(1).select("id", geom.capsule(*[F.lit(v) for v in (-75.9, -11.6, -74.4, -10.1)], F.lit(0.08)).alias("ring_ll"))
    got = {(r["lat0"], r["lon0"]): r["status"] for r in tiles.select(a).collect()}
    assert len(got) == 4 and sum(s == "needed" for s in got.values()) == 3
    edge = spark.range(1).select("id", geom.box(*[F.lit(float(v)) for v in (-76, -12, -75, -11)]).alias("ring_ll"))
    assert [(r["lat0"], r["lon0"]) for r in tiles.select(edge).collect()] == [(-12, -76)]


def test_clipping_and_shapes(spark):
    assert abs(one(spark, geom.overlap_area(geom.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0)), *[F.lit(float(v)) for v in (0, 0, 2, 2)])) - math.pi / 4) < 2e-3
    assert abs(one(spark, geom.area(geom.capsule(*[F.lit(float(v)) for v in (0, 0, 3, 4)], F.lit(1.0)))) - 10 - math.pi) < 0.02
    assert one(spark, geom.clip_segment(*[F.lit(float(v)) for v in (-1, 0.5, 2, 0.5)], geom.box(*[F.lit(float(v)) for v in (0, 0, 1, 1)]))).asDict() == pytest.approx({"t0": 1 / 3, "t1": 2 / 3})
    assert one(spark, geom.clip_segment(*[F.lit(float(v)) for v in (-1, 5, 2, 5)], geom.box(*[F.lit(float(v)) for v in (0, 0, 1, 1)]))) is None


def test_names_and_parsing(spark):
    assert one(spark, text.dem_name(F.lit(-12), F.lit(-76), F.lit(30))) == "Copernicus_DSM_COG_10_S12_00_W076_00_DEM"
    for lon, lat, sheet in [(-75.32, -11.06, "23-m"), (-75.4, -10.57, "22-m"), (-70.02, -15.84, "32-v"), (0.0, 10.0, None)]:
        assert one(spark, text.sheet_code(F.lit(lon), F.lit(lat))) == sheet
    assert one(spark, text.number(F.lit(" 1 234,5"))) == 1234.5 and one(spark, text.number(F.lit("1,5.2"))) is None
    assert one(spark, text.size_label(F.lit(2_500_000.0))) == "2.5 MB" and one(spark, text.known_suffix(F.lit("a.tif.part"))) == "raster"
    assert one(spark, validate.river_region(F.lit(-75.0), F.lit(-11.0))) == "sa" and one(spark, validate.river_region(F.lit(40.0), F.lit(20.0))) is None


def valley(spark, side=60, change=lambda r, c, z: z):
    return spark.createDataFrame([(r, c, change(r, c, 1000.0 - 5 * r + 3 * abs(c - 30))) for r in range(side) for c in range(side)], "row int, col int, z double")


def heap_fill(z, up=lambda v: math.nextafter(v, math.inf)):
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    f = {k: v for k, v in z.items() if any((k[0] + a, k[1] + b) not in z for a, b in near)}
    heap = [(v, k) for k, v in f.items()]
    heapq.heapify(heap)
    while heap:
        v, (r, c) = heapq.heappop(heap)
        for a, b in near:
            n = (r + a, c + b)
            if n in z and n not in f:
                f[n] = max(z[n], up(v))
                heapq.heappush(heap, (f[n], n))
    return f


def test_fill_in_blocks_equals_one_heap(spark):
    r = random.Random(4)
    z = {(i, j): float(r.randint(0, 8)) for i in range(22) for j in range(22) if r.random() > 0.05}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    got = {(x["row"], x["col"]): x["f"] for x in hydro.fill(cells, 8).collect()}
    assert got == heap_fill(z)


def test_valley_basin_channel_and_outline(spark):
    d = hydro.delineate(valley(spark), (0.0, 1800.0), 30.0, (30 * 30.0 + 15, 1800 - 50 * 30.0 - 15), (30 * 30.0 + 15, 1800 - 20 * 30.0 - 15), channel_km2=0.02, block=32)
    cells = {(r["row"], r["col"]) for r in d.mask.collect()}
    assert cells == {(r, c) for r in range(60) for c in range(60) if r + abs(c - 30) <= 50} and d.headwater_drains and d.truncated and d.outlet == (50, 30)
    assert [r["step"] for r in d.channel.orderBy("step").collect()][:3] == [0, 1, 2]
    ring = hydro.ring(d.mask)
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2) == len(cells)
    with pytest.raises(ValueError):
        hydro.delineate(valley(spark, 5), (0.0, 1800.0), 30.0, (-50.0, 0.0))


def test_pointers(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, None), (3, 2)], "node long, down long")
    pairs = spark.createDataFrame([(0, 2), (2, 0), (3, 3)], "source long, target long")
    assert {(r["source"], r["target"]): r["drains"] for r in hydro.drains_to(edges, pairs).collect()} == {(0, 2): True, (2, 0): False, (3, 3): True}
    assert {r["node"]: r["acc"] for r in hydro.accumulation(edges).collect()} == {0: 1, 1: 2, 2: 4, 3: 1}


def test_growing_until_contained(spark):
    def read(box):
        w, s, e, n = (math.floor(v / 30) for v in box)
        return spark.createDataFrame([(n - 1 - y, x - w, 1000.0 + abs(x - 100) * 3 + (y - 100) * 5 if 80 < y else 2000.0) for x in range(w, e) for y in range(s, n)], "row int, col int, z double"), (w * 30.0, n * 30.0), 30.0

    _, box, rounds = project.delineate_growing(read, (2700.0, 2700.0, 3300.0, 3300.0), (3015.0, 3015.0), params=Parameters(max_iteraciones=1, umbral_cauce_km2=0.002))
    assert rounds == 1 and box[0] < 2700.0



def test_resampling_by_blocks_equals_that_by_joins(spark):
    rng = np.random.default_rng(5)
    n = 3000
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-12, 32, (n, 2)))]
    spots += [(n + i, float(x), float(y)) for i, (x, y) in enumerate((a / 2, b / 2) for a in range(-20, 60, 3) for b in range(-20, 60, 3))]  # on centres and edges
    spots += [(-i - 1, 3.25, 4.75) for i in range(2000)] + [(-9000, None, 1.0), (-9001, 1.0, None), (-9002, float("nan"), 1.0)]  # a crowd in one block, and no place
    points = spark.createDataFrame(spots, "id long, u double, v double")
    cells = spark.createDataFrame([(r, c, None if (r * 7 + c) % 50 == 1 else float(rng.integers(-500, 500))) for r in range(-10, 30) for c in range(-10, 30) if (r * r + c) % 9], "row int, col int, z double")
    for how, plain in (("bilinear", raster.bilinear), ("nearest", raster.nearest)):
        want = {r["id"]: r["z"] for r in plain(points.where("NOT isnan(u) AND u IS NOT NULL AND v IS NOT NULL"), cells.where("z IS NOT NULL")).collect()}
        for block, piece in ((8, F.col("id") % 3), (256, None)):
            got = raster.sampled(points, cells, "id", how, block, piece).collect()
            assert len(got) == len(want) and max(abs(r["z"] - want[r["id"]]) for r in got) < 1e-9
    whole = raster.sampled(points, cells.where("z IS NOT NULL").withColumn("z", F.col("z").cast("int")), "id", "nearest", 8)
    assert dict(whole.dtypes)["z"] == "int" and whole.count() == len(want)
    assert raster.sampled(points, cells.limit(0)).count() == 0 and raster.sampled(points.limit(0), cells).count() == 0


def test_grids(spark):
    cells = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, 20.0)], "row int, col int, z double")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, 0.5, 0.5)], "id int, u double, v double")
    assert {r["id"]: r["z"] for r in raster.bilinear(at, cells).collect()} == {1: 10.0, 3: 0.0}
    parts = spark.createDataFrame([(0, 0, -9999.0, 1), (0, 0, 5.0, 2), (0, 0, 6.0, 3)], "row int, col int, z double, priority int")
    assert raster.mosaic(parts).first()["z"] == 5.0
    classes = spark.createDataFrame([(1, c) for c in (0, 3, 4, 9)], "scene int, class int")
    assert raster.cloud_counts(classes, "scene").first().asDict() == {"scene": 1, "cloudy": 2, "seen": 3, "cloud_pct": pytest.approx(66.6667, abs=1e-3)}


def test_layers(spark):
    top, low = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(10, 1), (20, 2)], "b int, a_of int")
    kept = layers.cascade([(top, "a", None), (low, "b", "a_of")], spark.createDataFrame([(2,)], "k int"))
    assert [x.collect()[0][0] for x in kept] == [2, 20]
    places = spark.createDataFrame([(1, "near", 10.0, 0.0), (2, "far", 30.0, 0.0), (3, "tie", -10.0, 0.0)], "place_id long, name string, x double, y double")
    assert layers.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), places, cell=20.0).first()["name"] == "near"
    e = spark.createDataFrame([("way", 1, '{"waterway":"river","name":"R"}', [(0.0, 0.0), (2.0, 2.0)]), ("way", 2, '{"waterway":"river"}', [(0.0, 0.0)]), ("node", 3, '{"place":"town"}', None)], "kind string, osm_id long, tags string, line array<struct<x:double,y:double>>")
    water, towns = layers.map_features(e)
    assert [(r["osm_id"], r["name"]) for r in water.collect()] == [(1, "R")] and towns.first()["name"] == ""
    assert layers.clip_lines(water, geom.box(*[F.lit(float(v)) for v in (0, 0, 1, 1)])).first()["x1"] == 1.0


def test_records(spark):
    f = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "seq int, path string, content string")
    assert {r["path"]: r["duplicate"] for r in provenance.duplicates(provenance.digests(f)).collect()} == {"a": False, "b": True, "c": False}
    d = spark.createDataFrame([("u", 5)], "url string, bytes long")
    assert provenance.manifest_csv(d) == "﻿url,bytes\r\nu,5\r\n".encode()
    assert json.loads(provenance.manifest_json({"name": "n"}, ["d"], d, d, d, "now"))["downloads"] == [{"url": "u", "bytes": 5}]
    s = spark.createDataFrame([(1, "A", True), (2, "B", False), (3, "C", True)], "place int, title string, kept boolean")
    assert "## 2. C" in provenance.report("R", s, spark.createDataFrame([(1, 1, "x")], "place int, seq int, line string"))


def test_requests_and_providers():
    req, p = load_request('nombre = "h"\ndatum = "SIRGAS2000"\nincluir = ["osm"]\n[parametros]\nk_corredor = 0.8\n', {"excluir": ["rios"], "k_corredor": None})
    assert req == {"nombre": "h", "datum": "SIRGAS2000"} | {k: v for k, v in req.items() if k == "excluir"} and p.k_corredor == 0.8 and p.incluir == {"osm"}
    assert "osm" in active_providers(p) and "rios" not in active_providers(p)
    with pytest.raises(TypeError):
        load_request("[parametros]\nnope = 1\n")
    with pytest.raises(ValueError):
        active_providers(Parameters(excluir=frozenset({"dem"})))


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Copernicus_DSM_COG_10_S12_00_W076_00_DEM\nCopernicus_DSM_COG_10_N01_00_E009_00_DEM\n")
    assert {tuple(r) for r in files.catalogue_tiles(files.catalogue(spark, str(tmp_path / "list.txt"))).collect()} == {(-12, -76), (1, 9)}
    with zipfile.ZipFile(tmp_path / "PE.zip", "w") as z:
        z.writestr("PE.txt", "\t".join(["1", 'a "q"', "", "", "-11.5", "-75.5", "P", "PPL", "PE", *[""] * 5, "7", "", "3", "", ""]) + "\n")
        z.writestr("readme.txt", "no")
    g = files.gazetteer(spark, str(tmp_path / "PE.zip")).collect()
    assert [(r["geonameid"], r["name"], r["lat"], r["population"]) for r in g] == [(1, 'a "q"', -11.5, 7)]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n-9999 5\n")
    spark.dataSource.register(files.GridSource)
    assert [(r["row"], r["col"], r["z"]) for r in spark.read.format("asc").load(str(tmp_path / "g.asc")).collect()] == [(0, 1, 5.0)]
    assert files.short_names(spark.createDataFrame([(1, 2)], "abcdefghijkl int, abcdefghijkm int")).columns == ["abcdefghij", "abcdefgh_1"]
    assert files.cache_index(spark, str(tmp_path / "none.json")).count() == 0
    lines = [r["line"] for r in files.ascii_grid(spark.createDataFrame([(0, 1, 5.0)], "row int, col int, z double"), 2, 1, 0.0, 1.0, 1.0).orderBy("row").collect()]
    assert lines[0] == "ncols 2" and lines[-1] == "-9999.0 5.0"


def test_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path == "/good"
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(b"body" if ok else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(web.UrlSource)
    got = {r["url"]: (r["state"], r["bytes"]) for r in spark.read.format("urls").option("urls", json.dumps([f"{base}/good", f"{base}/none"])).option("pause", "0").load().collect()}
    server.shutdown()
    assert got == {f"{base}/good": ("downloaded", 4), f"{base}/none": ("failed", None)}
    assert web.first_answer(["a", "b"], "q", ask=lambda m, d: {"m": m} if m == "b" else (_ for _ in ()).throw(OSError("x"))) == {"m": "b"}


def test_flow_in_blocks_equals_plain_walks(spark):
    r = random.Random(6)
    z = {(i, j): float(r.randint(0, 30)) for i in range(30) for j in range(30) if r.random() > 0.04}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    f = heap_fill(z)
    down = {}
    for (i, j), v in f.items():
        best = max(((v - f[i + a, j + b]) / math.hypot(a, b), -k, (i + a, j + b)) for k, (a, b) in enumerate(hydro.NEIGHBOURS) if (i + a, j + b) in f) if any((i + a, j + b) in f for a, b in hydro.NEIGHBOURS) else (0, 0, None)
        down[i, j] = best[2] if best[0] > 0 else None
    ways = {}
    for k in f:
        ways[k], at = [k], down[k]
        while at is not None:
            ways[k].append(at)
            at = down[at]
    number = lambda k: k[0] * hydro.ROW + k[1]
    for block in (7, 64):
        arrows = hydro.directions(hydro.fill(cells, block), block=block).persist()
        assert {r["node"]: r["down"] for r in arrows.collect()} == {number(k): v and number(v) for k, v in down.items()}
        acc = {r["node"]: r["acc"] for r in hydro.accumulation(arrows, block).collect()}
        assert acc == {number(k): sum(k in w for w in ways.values()) for k in f}
        outlets = sorted(f, key=lambda k: (-acc[number(k)], k))[:6]
        got = {r["node"]: r["outlet"] for r in hydro.upstream(arrows, spark.createDataFrame([(number(k),) for k in outlets], "node long"), block).collect()}
        assert got == {number(k): number(next(c for c in w if c in outlets)) for k, w in ways.items() if any(c in outlets for c in w)}


def test_pointers_with_a_cycle_fail(spark):
    with pytest.raises(Exception, match="cycle"):
        hydro.accumulation(spark.createDataFrame([(0, 1), (1, 0)], "node long, down long")).count()


def test_systems_by_rule(spark):
    rows = [(None, 17, "S", "SIRGAS 2000"), (31977, 17, "sur", None), (4326, 99, None, None), (4326, None, "X", None), (4674, 18, "S", None), (None, 18, "N", "SIRGAS2000"), (24878, None, None, None), (31970, 16, "N", None)]
    got = [(r["resolved_epsg"], r["error"]) for r in crs.resolve_system(spark.createDataFrame(rows, "epsg int, zone int, hemisphere string, datum string").coalesce(1), utm_bases(spark)).collect()]
    assert sorted(got, key=str) == sorted([(31977, None), (31977, None), (None, "zone"), (None, "hemisphere"), (4674, None), (None, "datum"), (24878, None), (31970, None)], key=str)
    old, new = (one(spark, crs.to_lonlat(F.lit(OUTLET[0]), F.lit(OUTLET[1]), F.lit(e))) for e in (24878, 32718))
    away = math.hypot((old["lon"] - new["lon"]) * 109_300, (old["lat"] - new["lat"]) * 110_600)
    assert 350 < away < 520 and old["lat"] < new["lat"]


def test_regions_need_their_box(spark):
    assert [one(spark, validate.river_region(F.lit(x), F.lit(y))) for x, y in ((-150.0, -40.0), (-100.0, 0.0), (-75.0, -11.0), (-80.0, 10.0))] == [None, None, "sa", None]


def test_nearest_of_far_and_lonely_points(spark):
    r = random.Random(8)
    places = [(i, f"p{i}", r.uniform(0, 1e5), r.uniform(0, 1e5)) for i in range(60)]
    points = [(i, r.uniform(-2e5, 3e5), r.uniform(-2e5, 3e5)) for i in range(80)] + [(900, 5e7, 0.0), (901, float("nan"), 1.0)]
    got = {x["id"]: x["place_id"] for x in layers.nearest(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(places, "place_id long, name string, x double, y double"), cell=500.0).collect()}
    assert got == {i: min(places, key=lambda p: (math.hypot(p[2] - x, p[3] - y), p[0]))[0] for i, x, y in points if i != 901}
    assert layers.nearest(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame([], "place_id long, name string, x double, y double")).count() == 0


def test_growth_and_contact(spark):
    square = geom.box(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    round_, mitre = one(spark, geom.area(geom.buffered(square, F.lit(2.0), 64))), one(spark, geom.buffered(square, F.lit(2.0), mitre=True))
    assert abs(round_ - (100 + 80 + 4 * math.pi)) < 1e-2 and {(p["x"], p["y"]) for p in mitre} == {(-2, -2), (12, -2), (12, 12), (-2, 12)}
    circle = geom.circle(F.lit(0.0), F.lit(0.0), F.lit(5.0))
    assert abs(one(spark, geom.area(tiles.enlarged(circle, 1.6))) / one(spark, geom.area(circle)) - 2.56) < 0.01
    along = geom.box(*[F.lit(float(v)) for v in (-1, 10, 11, 20)])
    assert [one(spark, geom.edge_meets(r, *[F.lit(float(v)) for v in (0, 0, 10, 10)])) for r in (along, geom.box(*[F.lit(float(v)) for v in (-1, 10.1, 11, 20)]))] == [True, False]
    r = random.Random(3)
    for _ in range(5):
        pts = [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(3)]
        ring = F.array(*[geom.point(*p) for p in pts])
        w, s = r.uniform(-2, 0), r.uniform(-2, 0)
        side = [F.lit(v) for v in (w, s, w + 2.5, s + 2.0)]
        assert abs(one(spark, geom.overlap_area(ring, *side)) - one(spark, geom.area(geom.clip_to_box(ring, *side)))) < 1e-12


def test_plan_of_a_corridor_leaves_out_the_corner_tile(spark):
    """The area is padded as it is, not by its rectangle."""
    a = spark.range(1).select("id", F.lit(32718).alias("epsg"), geom.capsule(*[F.lit(float(v)) for v in (401_000, 8_717_000, 564_000, 8_883_000)], F.lit(9_000.0)).alias("ring"))
    padded = tiles.to_lonlat(a.withColumn("ring", geom.buffered(F.col("ring"), F.lit(100.0))))
    got = {(x["lat0"], x["lon0"]): x["status"] for x in tiles.select(padded).collect()}
    assert len(got) == 4 and sum(s == "needed" for s in got.values()) == 3


def test_areas_of_any_shape_grow(spark):
    """A notched ring grows as its distance says, a basin by its final margin; the column form refuses such rings."""
    notched = [(0, 0), (1000, 0), (1000, 1000), (520, 1000), (520, 500), (480, 500), (480, 1000), (0, 1000)]
    whole = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
    rows = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, ring in enumerate((notched, whole))], "id int, ring array<struct<x:double,y:double>>")
    area = lambda df: {r["id"]: r["a"] for r in df.select("id", geom.area(F.col("ring")).alias("a")).collect()}
    grown = area(tiles.widened(rows, F.lit(100.0)))
    full = 1000 * 1000 + 4000 * 100 + 4 * 16 * 100 * 100 / 2 * math.sin(math.pi / 32)
    assert abs(grown[1] - full) < 1 and full - 100 < grown[0] < full
    assert area(tiles.enlarged_areas(rows, 1.6))[0] > 1.6 * 980_000
    final = tiles.final_area(rows, Parameters(margen_final_min_m=10.0, margen_final_frac=0.05))
    assert abs(final.first()["margin_m"] - 0.05 * 1000 * math.sqrt(2)) < 1e-9 and final.columns == ["id", "ring", "margin_m"]
    with pytest.raises(Exception, match="not convex"):
        rows.select(tiles.enlarged(F.col("ring"), 1.6)).collect()


def test_old_datum_both_ways(spark):
    rows = spark.createDataFrame([(z, x, y) for z in (24877, 24878, 24879, 24818) for x in (250_000.0, 500_000.0, 780_000.0) for y in (1e6, 8.7e6)], "epsg int, x double, y double")
    back = rows.select("x", "y", "epsg", crs.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("p")).select("x", "y", crs.from_lonlat(F.col("p.lon"), F.col("p.lat"), F.col("epsg")).alias("q"))
    assert back.agg(F.max(F.hypot(F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")))).first()[0] < 1e-3
    with pytest.raises(ValueError, match="unknown"):
        warp.between(F.lit(1.0), F.lit(2.0), 4326, 3857)


@pytest.mark.parametrize("spill", [True, False])
def test_fill_by_a_graph_of_passes(spark, spill):
    """Both ways on grids with holes, plateaus and steps of one unit, against a heap over all cells."""
    r = random.Random(9)
    for k in range(4):
        n, gap, high = r.randint(12, 34), [1, 1 << 20][k % 2], r.choice([4, 90])
        z = {(i - 5, j - 9): r.randint(0, high) * gap for i in range(n) for j in range(n) if r.random() > 0.02}
        cells = spark.createDataFrame([(*p, v) for p, v in z.items()], "row int, col int, z long")
        got = {(x["row"], x["col"]): x["f"] for x in hydro.fill(cells, 8, True, spill).collect()}
        assert got == heap_fill(z, lambda v: v + 1)
    assert hydro.fill(cells.limit(0), 8, True, spill).count() == 0


def test_records_are_added_once(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    rows = spark.createDataFrame([(9, "b"), (8, "c")], "n int, url string")
    assert sorted(map(tuple, provenance.upsert(index, rows).collect())) == [("a", 1), ("b", 9), ("c", 8)]
    registry = spark.createDataFrame([("x", "old")], "sha256 string, path string")
    files_ = spark.createDataFrame([(2, "later", "y"), (1, "first", "y"), (3, "new", "x")], "seq int, path string, sha256 string")
    assert sorted(map(tuple, provenance.registered(registry, files_).collect())) == [("x", "old"), ("y", "first")]
    assert provenance.unit_note(50.0, 9.0) and provenance.unit_note(40.0, 9.0) is None and provenance.unit_note(40.0, None) is None
    near = layers.by_distance(spark.createDataFrame([(2, 3.0, 4.0), (1, 4.0, 3.0), (3, 0.0, 0.04)], "id int, x double, y double"), 0.0, 0.0, "id")
    assert [(r["id"], r["dist_m"]) for r in near.collect()] == [(3, 0.0), (1, 5.0), (2, 5.0)]
