"""The providers end to end against a server of generated files, and the download store."""

import http.server
import io
import json
import os
import re
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from talweg import progress
from talweg.operators import warp
from talweg.plans import providers
from talweg.schemas import Parameters
from talweg.sources import rasters, scenes, store, vectors

OUTLET, EPSG = (459_329.7, 8_769_071.2), 32718
RING = [(458_000.0, 8_768_000.0), (460_500.0, 8_768_000.0), (460_500.0, 8_770_000.0), (459_000.0, 8_769_500.0), (458_000.0, 8_770_000.0)]  # not convex
SHAPE = vectors.GEOMETRY


class Files(http.server.BaseHTTPRequestHandler):
    """A folder with byte ranges; `answers` of posts by path, or functions of their bodies; every request is noted."""

    def handle_one(self, body: bool) -> None:
        path = os.path.join(self.server.root, self.path.lstrip("/"))
        self.server.asked.append((self.command, self.path))
        if not os.path.isfile(path):
            self.send_response(404)
            return self.end_headers()
        data = open(path, "rb").read()
        span = re.match(r"bytes=(\d+)-(\d*)", self.headers.get("Range") or "")
        part = data[int(span[1]) : int(span[2]) + 1 if span[2] else None] if span else data
        self.send_response(206 if span else 200)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        if body:
            self.wfile.write(part)

    def do_GET(self):
        self.handle_one(True)

    def do_HEAD(self):
        self.handle_one(False)

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        self.server.asked.append((self.command, self.path))
        answer = self.server.answers.get(self.path)
        answer = answer(json.loads(body)) if callable(answer) else answer
        self.send_response(200 if answer else 504)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode() if answer else b"")

    def log_message(self, *a):
        pass


@pytest.fixture
def served(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Files)
    server.root, server.asked, server.answers = str(tmp_path / "www"), [], {}
    os.makedirs(server.root)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def put(server, path, data):
    where = os.path.join(server.root, path)
    os.makedirs(os.path.dirname(where), exist_ok=True)
    with open(where, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def shape_zip(spark, tmp_path, layers):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, df in layers.items():
            vectors.write(df, str(tmp_path / "make" / name), 4326, "shp")
            for ext in ("shp", "shx", "dbf", "prj"):
                z.write(tmp_path / "make" / f"{name}.{ext}", f"{name}.{ext}")
    return out.getvalue()


def square(w, s, e, n):
    return [[{"x": x, "y": y} for x, y in ((w, s), (w, n), (e, n), (e, s), (w, s))]]


def line(*points):
    return [[{"x": x, "y": y} for x, y in points]]


def grid(spark, width, height, z):
    at = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return at.withColumn("z", z.cast("double"))


def test_store(spark, served, tmp_path):
    server, base = served
    put(server, "a.json", "[1]")
    put(server, "b.json", "[1]")
    put(server, "bad.json", "[1")
    put(server, "bad.zip", b"PK no archive")
    wanted = spark.createDataFrame([(f"{base}/{n}", "f", None) for n in ("a.json", "b.json", "bad.json", "bad.zip", "none.json", "a.json")] + [(None, "f", None)], "url string, folder string, expected long")
    root = str(tmp_path / "store")
    first = {os.path.basename(r["url"]): r for r in store.obtain(wanted, root, 2, 0.0).collect()}
    assert {k: r["state"] for k, r in first.items()} == {"a.json": "downloaded", "b.json": "downloaded, duplicate", "bad.json": "failed", "bad.zip": "failed", "none.json": "failed"}
    assert first["b.json"]["first_path"] == first["a.json"]["path"] == f"{root}/f/a.json"
    assert sorted(os.listdir(f"{root}/f")) == ["a.json", "b.json"]  # nothing half done is left
    again = {os.path.basename(r["url"]): r["state"] for r in store.obtain(wanted.where("url LIKE '%/a.json' OR url LIKE '%/b.json'"), root, 2, 0.0).collect()}
    assert again == {"a.json": "reused", "b.json": "reused"}
    with open(f"{root}/f/a.json", "w") as f:
        f.write("[")
    assert store.obtain(wanted.where("url LIKE '%/a.json'"), root, 2, 0.0).first()["state"] == "downloaded"
    sized = spark.createDataFrame([(f"{base}/a.json", "g", 99)], "url string, folder string, expected long")
    assert "99" in store.obtain(sized, root, 1, 0.0).first()["error"]


def test_store_keeps_files_of_one_name_apart(spark, served, tmp_path):
    server, base = served
    for folder in ("a", "b", "c"):
        put(server, f"{folder}/map.txt", f"map of {folder}")
    wanted = lambda *names: spark.createDataFrame([(f"{base}/{n}/map.txt", "f", None) for n in names], "url string, folder string, expected long")
    root = str(tmp_path / "store")
    for state, names in (("downloaded", "ab"), ("reused", "ab"), ("reused", "b")):
        got = store.obtain(wanted(*names), root, 1, 0.0).collect()
        assert {r["state"] for r in got} == {state} and {open(r["path"]).read() for r in got} == {f"map of {n}" for n in names}
        assert all(open(r["path"]).read() == f"map of {r['url'].split('/')[-2]}" for r in got)
    assert {r["state"] for r in store.obtain(wanted("c", "a"), root, 1, 0.0).collect()} == {"downloaded", "reused"}
    with open(f"{root}/f/map.txt", "w") as f:
        f.write("map of X")  # as long as before
    again = {r["url"]: r for r in store.obtain(wanted("a", "b", "c"), root, 1, 0.0).collect()}
    assert all(open(r["path"]).read() == f"map of {u.split('/')[-2]}" for u, r in again.items()) and sorted(r["state"] for r in again.values()) == ["downloaded", "reused", "reused"]


def test_store_index_reads_its_buckets_and_survives_failures_and_compaction(spark, served, tmp_path):
    server, base = served
    names = [f"{i}.txt" for i in range(12)]
    for n in names:
        put(server, n, f"text {int(n[:-4]) % 5}")
    ask = lambda some, folder="f": spark.createDataFrame([(f"{base}/{n}", folder, None) for n in some], "url string, folder string, expected long")
    root = str(tmp_path / "store")
    assert store.index(spark, root).count() == 0 and store.obtain(ask(names).limit(0), root, 1, 0.0).count() == 0
    store.compact(spark, str(tmp_path / "none"))
    assert store.generations(str(tmp_path / "none")) == []
    store.obtain(ask(names[:6]), root, 1, 0.0).collect()
    last = store.obtain(ask([*names[6:], "none.txt"]), root, 1, 0.0).collect()
    assert {r["state"] for r in last} == {"downloaded, duplicate", "failed"}
    # a run that fails in one of its tasks leaves no record
    broken = store.index(spark, root).withColumn("sha256", F.when(F.col("url").endswith("/7.txt"), F.raise_error(F.lit("lost"))).otherwise(F.col("sha256")))
    with pytest.raises(Exception, match="lost"):
        store.append(broken, root)
    assert store.index(spark, root).count() == 13
    # what lies in other buckets isn't read
    of = lambda n: spark.range(1).select(store.bucket(F.lit(n))).first()[0]
    mine, kept = of("3.txt"), {}
    for where, _, found in os.walk(f"{root}/_index/0"):
        for n in found:
            if n.startswith("part-") and not where.endswith(f"bucket={mine}"):
                kept[f"{where}/{n}"] = open(f"{where}/{n}", "rb").read()
                open(f"{where}/{n}", "wb").write(b"broken")
                if os.path.exists(f"{where}/.{n}.crc"):
                    os.remove(f"{where}/.{n}.crc")
    assert kept and f"{base}/3.txt" in {r["url"] for r in store.index(spark, root, [mine]).collect()}
    for where, data in kept.items():
        open(where, "wb").write(data)
    # compaction keeps what decides: the same states, paths and first paths before and after it
    store.obtain(ask(names[:3]), root, 1, 0.0).collect()
    told = lambda: sorted(tuple(r[c] for c in ("url", "path", "state", "first_path")) for r in store.obtain(ask([*names, "none.txt"]), root, 1, 0.0).collect())
    before = told()
    for generation in (1, 2):
        store.compact(spark, root)
        assert store.generations(root) == [generation - 1, generation] and store.index(spark, root).count() == len(names) + 5  # and the first records of five contents
        assert told() == before
    put(server, "other/3.txt", "text of another")
    assert {r["path"].startswith(f"{root}/f/") and r["path"] != f"{root}/f/3.txt" for r in store.obtain(ask(["other/3.txt"]), root, 1, 0.0).collect()} == {True}


def test_scenes_by_spans_and_pages(spark, served):
    server, base = served
    box = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    made = [{"id": f"s{i:02}", "geometry": {"type": "Polygon" if i else "MultiPolygon", "coordinates": [box] if i else [[box]]}, "properties": {"datetime": f"2024-01-{i + 1:02}T00:00:00Z", "eo:cloud_cover": i}, "assets": {"visual": {"href": f"v{i}"}, "none": {}}} for i in range(20)]
    seen = []

    def answer(body):
        seen.append(body)
        inside = [f for f in made if "datetime" not in body or body["datetime"].split("/")[0] <= f["properties"]["datetime"].replace("Z", "+00:00") <= body["datetime"].split("/")[1]]
        at = body.get("token", 0)
        links = [{"rel": "self", "href": "x"}] + ([{"rel": "next", "href": f"{base}/search", "method": "POST", "merge": True, "body": {"token": at + 4}}] if at + 4 < len(inside) else [])
        return {"features": inside[at : at + 4], "links": links}

    server.answers["/search"] = answer
    over = scenes.spans("2024-01-01", "2024-01-18", 7)
    assert [b for _, b in over] == ["2024-01-08T00:00:00+00:00", "2024-01-15T00:00:00+00:00", "2024-01-18T00:00:00+00:00"]
    got = scenes.search(spark, f"{base}/search", {"limit": 4}, over, pause=0.0)
    assert got.rdd.getNumPartitions() == 3
    rows = sorted(got.collect(), key=lambda r: r["scene"])
    assert [r["scene"] for r in rows] == [f"s{i:02}" for i in range(17)]  # each once, also at the ends of spans, and none of the 18th
    assert rows[0]["ring"] is None and len(rows[1]["ring"]) == 5 and rows[3]["assets"] == {"visual": "v3"} and rows[3]["scene_cloud"] == 3.0
    assert len(seen) == 2 + 2 + 1 and all(b["limit"] == 4 for b in seen)
    seen.clear()
    assert [r["scene"] for r in scenes.search(spark, f"{base}/search", {}, most=6).collect()] == [f"s{i:02}" for i in range(6)] and len(seen) == 2
    server.answers["/loop"] = {"features": made[:1], "links": [{"rel": "next", "href": f"{base}/loop", "method": "POST", "merge": True}]}
    looped = scenes.search(spark, f"{base}/loop", {"a": 1}, attempts=1).collect()
    assert [r["scene"] for r in looped] == ["s00", None] and "earlier" in looped[1]["error"]
    assert "504" in scenes.search(spark, f"{base}/gone", {}, attempts=2, pause=0.0).first()["error"]
    assert scenes.search(spark, f"{base}/search", {}, [("2030-01-01", "2030-01-02")]).count() == 0


def test_progress_tells_of_tasks_and_bytes(spark, served, tmp_path):
    server, base = served
    for i in range(6):
        put(server, f"{i}.txt", b"x" * 1000 * (i + 1))
    wanted = spark.createDataFrame([(f"{base}/{i}.txt", "f", None) for i in range(6)], "url string, folder string, expected long")
    said = []
    spark.sparkContext.setLocalProperty(progress.GROUP, "mine")
    with progress.watched(spark, said.append, 0.05):
        store.obtain(wanted, str(tmp_path / "store"), 1, 0.0).collect()
    assert spark.sparkContext.getLocalProperty(progress.GROUP) == "mine"
    spark.sparkContext.setLocalProperty(progress.GROUP, None)
    last = said[-1]
    assert last.bytes_fetched == 21_000 and last.jobs >= 2 and last.running == 0 and 0 < last.tasks_done <= last.tasks
    assert all(a.tasks_done <= b.tasks_done and a.bytes_fetched <= b.bytes_fetched for a, b in zip(said, said[1:])) and "21000 bytes" in str(last)
    quiet = []
    with pytest.raises(KeyError), progress.watched(spark, quiet.append, 0.05):
        raise KeyError
    assert quiet[-1].jobs == 0


def test_ranges_are_asked_for_again(served, monkeypatch):
    server, base = served
    put(server, "x.bin", bytes(range(200)))
    broken = {"n": 2}
    plain = rasters.fetched_range

    def sometimes(*a):
        if broken["n"]:
            broken["n"] -= 1
            raise ConnectionResetError("gone")
        return plain(*a)

    monkeypatch.setattr(rasters, "fetched_range", sometimes)
    assert rasters.read_range(f"{base}/x.bin", 50, 3, pause=0.0) == bytes([50, 51, 52])
    broken["n"] = 3
    with pytest.raises(ConnectionResetError):
        rasters.read_range(f"{base}/x.bin", 50, 3, pause=0.0)
    broken["n"] = 0
    with pytest.raises(Exception, match="404"):
        rasters.read_range(f"{base}/none.bin", 0, 3)
    monkeypatch.setattr(server.RequestHandlerClass, "handle_one", lambda self, body: (server.asked.append(("GET", self.path)), self.send_response(200), self.end_headers(), self.wfile.write(bytes(range(200)))))
    server.asked.clear()
    assert [rasters.read_range(f"{base}/whole.bin", a, 2) for a in (10, 100)] == [bytes([10, 11]), bytes([100, 101])] and len(server.asked) == 1


def test_warp_joins_tiles_without_a_seam(spark, tmp_path):
    cell = 1 / 120
    paths = []
    for k, lon in enumerate((-76.0, -75.0)):
        z = 100 * (lon + (F.col("col") + 0.5) * cell) + 1000 * (-11 - (F.col("row") + 0.5) * cell)
        paths.append(rasters.write(grid(spark, 120, 120, F.lit(0)).withColumn("z", z), str(tmp_path / f"{k}.tif"), 120, 120, lon, -11.0, cell, 4326, kind="<f8"))
    ring = [(498_000.0, 8_760_000.0), (502_000.0, 8_760_000.0), (502_000.0, 8_764_000.0), (498_000.0, 8_764_000.0)]  # across 75 degrees west
    cells, g = warp.warped(spark, paths, ring, 32718, 500.0)
    assert (g.width, g.height, g.x0, g.y1) == (8, 8, 498_000, 8_764_000)
    at = cells.withColumn("q", warp.between(g.x0 + (F.col("col") + 0.5) * 500, g.y1 - (F.col("row") + 0.5) * 500, 32718, 4326))
    off = at.agg(F.count("*"), F.max(F.abs(F.col("z") - 100 * F.col("q.x") - 1000 * F.col("q.y")))).first()
    assert off[0] == 64 and off[1] < 1e-6
    with pytest.raises(ValueError, match="more than"):
        warp.warped(spark, paths, ring, 32718, 500.0, most=63)


def test_every_provider(spark, served, tmp_path):
    server, base = served
    dem = "Copernicus_DSM_COG_10_S12_00_W076_00_DEM"
    put(server, "dem/tileList.txt", f"{dem}\n")
    step = 1 / 360
    tif = rasters.write(grid(spark, 360, 360, F.col("row") * 2 + F.col("col")), str(tmp_path / "dem.tif"), 360, 360, -76.0, -11.0, step, 4326)
    put(server, f"dem/{dem}/{dem}.tif", open(tif, "rb").read())
    unit = "PFAF_ID long, UP_AREA double, HYBAS_ID long"
    units = spark.createDataFrame([("polygon", square(-75.5, -11.5, -75.3, -11.0), 11, 900.5, 1), ("polygon", square(-75.366, -11.5, -75.0, -11.0), 12, 7.0, 2), ("polygon", square(-70.0, -5.0, -69.0, -4.0), 13, 1.0, 3)], f"{SHAPE}, {unit}")
    put(server, "basins/hybas_sa_lev12_v1c.zip", shape_zip(spark, tmp_path, {"hybas_sa_lev12_v1c": units}))
    rivers = spark.createDataFrame([("line", line((-75.5, -11.14), (-75.2, -11.14)), 5), ("line", line((-75.5, -11.9), (-75.2, -11.9)), 6)], f"{SHAPE}, HYRIV_ID long")
    put(server, "rivers/HydroRIVERS_v10_sa_shp.zip", shape_zip(spark, tmp_path, {"HydroRIVERS_v10_sa": rivers}))
    ids = lambda n: ", ".join(f"GID_{i} string, NAME_{i} string" for i in range(n + 1))
    whole, far = square(-76.0, -12.0, -75.0, -11.0), square(-72.0, -12.0, -71.0, -11.0)
    levels = {
        "gadm41_PER_0": spark.createDataFrame([("polygon", whole, "PER", "Peru")], f"{SHAPE}, {ids(0)}"),
        "gadm41_PER_1": spark.createDataFrame([("polygon", whole, "PER", "Peru", "P.1", "Junin"), ("polygon", far, "PER", "Peru", "P.2", "Cusco")], f"{SHAPE}, {ids(1)}"),
        "gadm41_PER_2": spark.createDataFrame([("polygon", whole, "PER", "Peru", "P.1", "Junin", "P.1.1", "Chanchamayo"), ("polygon", far, "PER", "Peru", "P.1", "Junin", "P.1.2", "Satipo"), ("polygon", far, "PER", "Peru", "P.2", "Cusco", "P.2.1", "Anta")], f"{SHAPE}, {ids(2)}"),
    }
    put(server, "admin/gadm41_PER_shp.zip", shape_zip(spark, tmp_path, levels))
    put(server, "places/countryInfo.txt", "# remark\nPE\tPER\t604\n")
    place = lambda i, name, lat, lon, cls, code: "\t".join([str(i), name, name, "", str(lat), str(lon), cls, code, "PE", "", "", "", "", "", "12", "", "900", "America/Lima", "2024-01-01"])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("PE.txt", "\n".join([place(1, 'San "Ramon', -11.142, -75.372, "P", "PPL"), place(2, "Rio Chico", -11.1385, -75.3745, "H", "STM"), place(3, "Lejos", -11.9, -75.9, "P", "PPL"), place(4, "Road", -11.142, -75.372, "R", "RD")]))
    put(server, "places/PE.zip", out.getvalue())
    put(server, "cover/ESA_WorldCover_10m_2021_v200_S12W078_Map.tif", open(rasters.write(grid(spark, 900, 900, F.lit(10)), str(tmp_path / "cover.tif"), 900, 900, -78.0, -9.0, 3 / 900, 4326, 0, "u1", {10: (0, 100, 0)}), "rb").read())
    for name, cloud in (("cloudy", 9), ("clear", 4)):
        put(server, f"s2/{name}_scl.tif", open(rasters.write(grid(spark, 100, 100, F.lit(cloud)), str(tmp_path / f"{name}.tif"), 100, 100, 455_000.0, 8_772_000.0, 100.0, EPSG, 0, "u1"), "rb").read())
        rgb = grid(spark, 100, 100, F.lit(0)).select("row", "col", F.lit(50.0).alias("r"), F.col("col").cast("double").alias("g"), F.col("row").cast("double").alias("b"))
        put(server, f"s2/{name}_tci.tif", open(rasters.write(rgb, str(tmp_path / f"{name}3.tif"), 100, 100, 455_000.0, 8_772_000.0, 100.0, EPSG, 0, "u1", bands=("r", "g", "b")), "rb").read())
    outline = {"type": "Polygon", "coordinates": [[[p["x"], p["y"]] for p in whole[0]]]}
    server.answers["/scenes"] = {"features": [{"id": n, "geometry": outline, "properties": {"datetime": f"2024-0{i}-01T00:00:00Z", "eo:cloud_cover": float(i)}, "assets": {"visual": {"href": f"{base}/s2/{n}_tci.tif"}, "scl": {"href": f"{base}/s2/{n}_scl.tif"}}} for i, n in enumerate(("cloudy", "clear"), 1)]}
    node = lambda i, lat, lon: {"type": "node", "id": i, "lat": lat, "lon": lon, "tags": {"place": "hamlet", "name": f"n{i}"}}
    server.answers["/map2"] = {"elements": [{"type": "way", "id": 7, "tags": {"waterway": "stream"}, "geometry": [{"lat": -11.14, "lon": -75.5}, {"lat": -11.14, "lon": -75.2}]}, node(8, -11.142, -75.372), node(9, -11.9, -75.9)]}

    addresses = {k: f"{base}/{k}" for k in ("basins", "rivers", "admin", "places", "cover", "scenes")} | {"dem30": f"{base}/dem", "map": f"{base}/map1 {base}/map2"}
    params = Parameters(incluir=frozenset({"osm", "cobertura"}))
    ctx = providers.Context(spark, str(tmp_path / "project"), str(tmp_path / "store"), EPSG, RING, OUTLET, params, addresses, pause=0.0)
    project = providers.plan(ctx)
    assert not project.errors and set(project.plans) == set(providers.REGISTRY)
    listed = {(r["provider"], r["method"], r["cached"]) for r in project.resources(ctx).collect()}
    assert ("dem", "file", False) in listed and ("imagen", "window", False) in listed and ("osm", "service", False) in listed
    assert project.plans["unidades"][0].bytes > 0
    providers.run(ctx, project)
    assert not project.errors
    made = {o.label: o for o in project.outputs}
    assert {k: o.rows for k, o in made.items() if o.rows is not None} == {
        "basin units of level 12": 2, "river network": 1, "administrative level 0": 1, "administrative level 1": 2, "administrative level 2": 2, "named places": 2, "waterways of the map": 1, "places of the map": 1,
    }
    assert ctx.facts["unit"] == {"code": 11, "upstream_km2": 900.5, "id": 1}
    assert ctx.facts["political"] == ["Departamento: Junin", "Provincia: Chanchamayo"]
    assert ctx.facts["nearest_water"]["name"] == "Rio Chico" and ctx.facts["nearest_place"]["name"] == 'San "Ramon'
    assert ctx.facts["image"] == {"scene": "clear", "date": "2024-02-01", "cloud_pct": 0.0, "complete": True}

    z = rasters.read(spark, [made["elevation, 30 m"].path])
    assert 4000 < z.count() < 5556  # of 84 x 67 cells those in the ring
    assert z.where("y > 8769800 AND x BETWEEN 458950 AND 459050").count() == 0  # the notch of the ring is missing, not 0
    cover = rasters.layout(made["land cover of 2021"].path)
    assert cover.colours[256 + 10] == 25_700 and rasters.read(spark, [made["land cover of 2021"].path]).where("z <> 10").count() == 0
    image = made["image of 2024-02-01"].path
    assert rasters.layout(image).samples == 3
    green = rasters.read(spark, [image], band=1).where("row = 100").select((F.col("z") - F.floor((F.col("x") - 455_000) / 100)).alias("d")).distinct().collect()
    assert [r["d"] for r in green] == [0.0]
    river = vectors.read(spark, made["river network"].path).select(F.array_min(F.transform(F.flatten("parts"), lambda p: p["x"])), F.array_max(F.transform(F.flatten("parts"), lambda p: p["x"]))).first()
    assert abs(river[0] - 458_000) < 5 and abs(river[1] - 460_500) < 5

    kept = json.load(open(f"{ctx.folder}/10_Resultados/manifest.json"))
    assert len(kept["products"]) == len(project.outputs) and len(kept["downloads"]) == len(ctx.records) and kept["errors"] == []
    assert {(r["provider"], r["method"]) for r in kept["services"]} == {("imagen", "window"), ("osm", "service"), ("cobertura", "window")}
    lines = project.text(ctx).splitlines()
    assert [x.split(":")[0] for x in lines] == list(project.plans) and "cached" in lines[0]
    text = open(f"{ctx.folder}/10_Resultados/report.md").read()
    assert "## 1. Location" in text and "Problems" not in text and "[año]" not in text

    again = providers.Context(spark, ctx.folder, ctx.cache, EPSG, RING, OUTLET, Parameters(excluir=frozenset({"imagen"})), addresses | {"basins": f"{base}/nowhere"}, pause=0.0)
    second = providers.run(again, providers.plan(again))
    assert set(second.errors) == {"unidades"} and {r["state"] for r in again.records} == {"reused", "failed"}
