"""Raster and vector files: round trips, windows and boxes, archives."""

import http.server
import re
import sqlite3
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from talweg.sources import rasters, vectors


def test_geotiff_round_trip_and_window(spark, tmp_path):
    cells = spark.range(300 * 270).select((F.col("id") / 300).cast("int").alias("row"), (F.col("id") % 300).cast("int").alias("col")).withColumn("z", (F.col("row") * 1.5 + F.col("col") * 0.25).cast("double")).where("(row + col) % 11 <> 0")
    path = rasters.write(cells, str(tmp_path / "dem" / "a.tif"), 300, 270, 5e5, 9e6, 30.0, 32718)
    a = rasters.layout(path)
    assert (a.width, a.height, a.epsg, a.nodata, a.x0, a.y1, a.dx) == (300, 270, 32718, -9999.0, 5e5, 9e6, 30.0)
    back = rasters.read(spark, [path])
    assert back.count() == cells.count() and back.join(cells.withColumnRenamed("z", "w"), ["row", "col"]).where("abs(z - w) > 1e-4").count() == 0

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, re.findall(r"\d+", self.headers["Range"]))
            data = open(path, "rb").read()[a : b + 1]
            sent.append(len(data))
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    sent: list[int] = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for where in (path, f"http://127.0.0.1:{server.server_port}/a.tif"):
        got = rasters.read(spark, [where], (5e5 + 3000, 9e6 - 900, 5e5 + 3600, 9e6 - 600)).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.min("x")).first()
        assert tuple(got) == (20, 29, 100, 119, 5e5 + 3015)
    server.shutdown()
    with pytest.raises(ValueError):
        rasters.layout(__file__)


def test_coloured_classes_and_empty_grids(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 10.0), (3, 4, 80.0)], "row int, col int, z double")
    path = rasters.write(cells, str(tmp_path / "c.tif"), 5, 4, -75.0, -11.0, 0.001, 4326, 0, "u1", {10: (0, 100, 0), 80: (0, 0, 255)})
    a = rasters.layout(path)
    assert a.epsg == 4326 and (a.colours[10], a.colours[256 + 10], a.colours[512 + 80]) == (0, 25700, 65535)
    assert {(r["row"], r["col"], r["z"]) for r in rasters.read(spark, [path]).collect()} == {(0, 0, 10.0), (3, 4, 80.0)}
    none = rasters.write(cells.where("false"), str(tmp_path / "n.tif"), 300, 20, 0.0, 0.0, 1.0, 32718)
    assert rasters.read(spark, [none]).count() == 0


SCHEMA = vectors.GEOMETRY + ", name string, population long, share double, long_attribute_name string, long_attribute_more string"


def layer(spark):
    square = lambda x, y: [[{"x": x, "y": y}, {"x": x, "y": y + 1.0}, {"x": x + 1.0, "y": y + 1.0}, {"x": x + 1.0, "y": y}, {"x": x, "y": y}]]
    rows = [("polygon", square(float(i), float(i)), f"ñ{i}", i * 10**9, i / 3, "a", None) for i in range(20)]
    hole = [{"x": v, "y": w} for v, w in ((0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2))]
    rows[0] = ("polygon", [rows[0][1][0], hole], "holed", None, None, None, "b")
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    return sorted((r[0], [[(p["x"], p["y"]) for p in q] for q in r[1]], *map(str, r[2:5])) for r in rows)


@pytest.mark.parametrize("kind", ["shp", "gpkg"])
def test_layers_round_trip(spark, tmp_path, kind):
    df = layer(spark)
    path, n = vectors.write(df.repartition(3), str(tmp_path / "out" / "units"), 4326, kind)
    assert n == 20 and path.endswith(f"units.{kind}")
    back = vectors.read(spark, path)
    assert plain(back.collect()) == [(a, b, c, *r) for a, b, c, *r in plain(df.collect())]
    assert back.columns[-1] == ("long_att_1" if kind == "shp" else "long_attribute_more")
    part = vectors.read(spark, path, (4.5, 4.5, 6.2, 6.2), ["name"])
    assert part.columns == ["kind", "parts", "name"] and {r["name"] for r in part.collect()} == {"ñ4", "ñ5", "ñ6"}
    assert vectors.write(df.where("false"), str(tmp_path / "none"), 4326, kind) == (None, 0)
    if kind == "shp":
        with zipfile.ZipFile(tmp_path / "units.zip", "w") as z:
            for end in ("shp", "shx", "dbf"):
                z.write(f"{path[:-3]}{end}", f"inner/units.{end}")
        assert plain(vectors.read(spark, str(tmp_path / "units.zip")).collect()) == plain(back.collect())
    else:
        assert sqlite3.connect(path).execute("PRAGMA integrity_check").fetchone() == ("ok",)


@pytest.mark.parametrize("kind", ["shp", "gpkg"])
def test_points_and_lines(spark, tmp_path, kind):
    for shape, parts in (("point", [[(1.0, 2.0)]]), ("line", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 1.0)]])):
        df = spark.createDataFrame([(shape, [[{"x": x, "y": y} for x, y in q] for q in parts], 7)], vectors.GEOMETRY + ", id int")
        path, _ = vectors.write(df, str(tmp_path / shape), 32718, kind)
        got = vectors.read(spark, path).first()
        assert got["kind"] == shape and [[(p["x"], p["y"]) for p in q] for q in got["parts"]] == parts and got["id"] == 7
