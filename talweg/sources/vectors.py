"""Vector layers: Shapefiles, also inside ZIP archives, and GeoPackages, as data sources and writers.

spark.read.format("shapefile" or "geopackage").option("box", "[w, s, e, n]").option("columns", '["NAME"]').load(path): rows of
kind (point, line, polygon), parts (array of arrays of struct<x, y>) and the attributes asked for. Records whose own box
misses the box are never decoded; a GeoPackage's index is used where there is one. A plain file is a partition for each
`records` records, an archive is one. A layer file has one end, so one task writes it, streaming, under a passing name first.
"""

from __future__ import annotations

import datetime
import io
import json
import os
import re
import shutil
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from .files import short_names
from .rasters import read_range

GEOMETRY = "kind string, parts array<array<struct<x:double,y:double>>>"
# Shape types of a Shapefile and of well-known binary.
SHAPES = {"point": 1, "line": 3, "polygon": 5}
KINDS = {1: "point", 3: "line", 5: "polygon", 11: "point", 13: "line", 15: "polygon", 21: "point", 23: "line", 25: "polygon"}
WKB = {"point": 1, "line": 2, "polygon": 3}


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class Shape:
    """The three files of a Shapefile, read by ranges; those of an archive are unpacked in memory."""

    def __init__(self, path: str, layer: str | None = None) -> None:
        self.path, self.held = path, {}
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(read_range(path, 0, 1 << 40))) as z:
                wanted = f"{layer.lower()}.shp" if layer else ".shp"
                inner = next((n for n in sorted(z.namelist()) if (n.rsplit("/", 1)[-1].lower() == wanted if layer else n.lower().endswith(wanted))), None)
                if inner is None:
                    raise ValueError(f"{path} holds no Shapefile{f' {layer}' if layer else ''}")
                for n in z.namelist():
                    if n.rsplit(".", 1)[0] == inner.rsplit(".", 1)[0]:
                        self.held[n.rsplit(".", 1)[-1].lower()] = z.read(n)

    def get(self, part: str, offset: int, length: int) -> bytes:
        if self.held:
            return self.held.get(part, b"")[offset : offset + length]
        return read_range(self.path[: -len("shp")] + part, offset, length)

    def fields(self) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
        """Records, header and record length, and the fields (name, type, offset in a record, width)."""
        head = self.get("dbf", 0, 65_536)
        n, start, width = struct.unpack_from("<IHH", head, 4)
        found, at, place = [], 32, 1
        while at + 32 <= start and head[at] != 0x0D:
            name, size = head[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), head[at + 16]
            whole = chr(head[at + 11]) in "NF" and head[at + 17] == 0 and size < 19
            found.append((name, "long" if whole else {"N": "double", "F": "double", "L": "boolean", "D": "date"}.get(chr(head[at + 11]), "string"), place, size))
            place, at = place + size, at + 32
        return n, start, width, found


def value(raw: bytes, kind: str) -> object:
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind == "string":
        return text
    if not text or set(text) == {"*"}:
        return None
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text[0].upper())
    if kind == "date":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    return int(float(text)) if kind == "long" else float(text)


def points(raw: bytes, at: int, n: int) -> list[dict]:
    v = struct.unpack_from(f"<{2 * n}d", raw, at)
    return [{"x": v[i], "y": v[i + 1]} for i in range(0, 2 * n, 2)]


def misses(own: tuple, box: list[float] | None) -> bool:
    return box is not None and (own[0] > box[2] or own[2] < box[0] or own[1] > box[3] or own[3] < box[1])


def shape_of(raw: bytes, box: list[float] | None) -> tuple[str, list] | None:
    """Kind and parts of a record's content; None where its box misses `box`, ("none", []) for a null shape."""
    kind = KINDS.get(struct.unpack_from("<i", raw)[0])
    if kind is None:
        return None if box else ("none", [])
    own = struct.unpack_from("<2d", raw, 4) * 2 if kind == "point" else struct.unpack_from("<4d", raw, 4)
    if misses(own, box):
        return None
    if kind == "point":
        return kind, [points(raw, 4, 1)]
    n, m = struct.unpack_from("<2i", raw, 36)
    cuts = [*struct.unpack_from(f"<{n}i", raw, 44), m]
    return kind, [points(raw, 44 + 4 * n + 16 * a, b - a) for a, b in zip(cuts, cuts[1:])]


class Part(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class LayerReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.box, self.layer = options["path"], json.loads(options.get("box", "null")), options.get("layer")
        self.records, self.names, self.schema = int(options.get("records", 50_000)), [f.name for f in schema.fields][2:], schema

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(form)], schema=form)

    def parts(self, n: int) -> list[InputPartition]:
        return [Part(a, min(n, a + self.records)) for a in range(0, n, self.records)] or [Part(0, 0)]


class ShapeReader(LayerReader):
    def partitions(self) -> list[InputPartition]:
        n = Shape(self.path, self.layer).fields()[0]
        return [Part(0, n)] if self.path.lower().endswith(".zip") else self.parts(n)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        s = Shape(self.path, self.layer)
        _, start, width, fields = s.fields()
        wanted = [next(f for f in fields if f[0] == name) for name in self.names]
        for a in range(partition.first, partition.last, 2048):
            b = min(partition.last, a + 2048)
            index = struct.unpack(f">{2 * (b - a)}i", s.get("shx", 100 + 8 * a, 8 * (b - a)))
            begin = 2 * index[0]
            shapes = s.get("shp", begin, 2 * index[-2] + 2 * index[-1] + 8 - begin)
            table, rows = s.get("dbf", start + width * a, width * (b - a)), []
            for i in range(b - a):
                at = 2 * index[2 * i] - begin + 8
                if table[width * i : width * i + 1] != b"*" and (g := shape_of(shapes[at : at + 2 * index[2 * i + 1]], self.box)):
                    rows.append((*g, *[value(table[width * i + f[2] : width * i + f[2] + f[3]], f[1]) for f in wanted]))
            yield self.batch(rows)


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        wanted = json.loads(self.options.get("columns", "null"))
        return ", ".join([GEOMETRY, *[f"`{f[0]}` {f[1]}" for f in Shape(self.options["path"], self.options.get("layer")).fields()[3] if wanted is None or f[0] in wanted]])

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(self.options, schema)


def wkb(kind: str, parts: list) -> bytes:
    """Well-known binary; lines and polygons as multi ones where they have several parts."""
    ring = lambda p: struct.pack("<I", len(p)) + struct.pack(f"<{2 * len(p)}d", *[v for q in p for v in (q["x"], q["y"])])
    if kind == "point":
        return struct.pack("<BI2d", 1, 1, parts[0][0]["x"], parts[0][0]["y"])
    if kind == "line":
        each = [struct.pack("<BI", 1, 2) + ring(p) for p in parts]
        return each[0] if len(each) == 1 else struct.pack("<BII", 1, 5, len(each)) + b"".join(each)
    turned = [sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(p, p[1:] + p[:1])) <= 0 for p in parts]
    groups: list[list] = []
    for p, outer in zip(parts, turned):  # clockwise rings are outer ones, as in Shapefiles, others are holes of the one before
        groups.append([p]) if outer or not groups else groups[-1].append(p)
    each = [struct.pack("<BII", 1, 3, len(g)) + b"".join(map(ring, g)) for g in groups]
    return each[0] if len(each) == 1 else struct.pack("<BII", 1, 6, len(each)) + b"".join(each)


def from_wkb(raw: bytes, at: int = 0) -> tuple[str, list, int]:
    """Kind, parts and where the geometry ends. Further dimensions are skipped."""
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    code, dims = code % 1000 if code < 0x20000000 else code & 0xFF, 2 + (0, 1, 1, 2)[code // 1000 if code < 0x20000000 else (code >> 31) + (code >> 30 & 1)]
    at += 5

    def ring(at: int, n: int) -> tuple[list[dict], int]:
        v = struct.unpack_from(f"{order}{dims * n}d", raw, at)
        return [{"x": v[i], "y": v[i + 1]} for i in range(0, dims * n, dims)], at + 8 * dims * n

    if code == 1:
        p, at = ring(at, 1)
        return "point", [p], at
    n = struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    if code == 2:
        p, at = ring(at, n)
        return "line", [p], at
    parts, kind = [], {3: "polygon", 4: "point", 5: "line", 6: "polygon"}.get(code, "none")
    for _ in range(n):
        if code == 3:
            p, at = ring(at + 4, struct.unpack_from(order + "I", raw, at)[0])
            parts.append(p)
        else:
            _, inner, at = from_wkb(raw, at)
            parts += inner
    return kind, parts, at


class PackageReader(LayerReader):
    def open(self) -> tuple[sqlite3.Connection, str, str, bool]:
        """The package, its layer, geometry column and whether that has an index."""
        con = sqlite3.connect(f"file:{local(self.path)}?mode=ro", uri=True)
        layer, column = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ? IS NULL OR table_name = ? ORDER BY rowid", (self.layer, self.layer)).fetchone()
        return con, layer, column, con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (f"rtree_{layer}_{column}",)).fetchone()[0] > 0

    def partitions(self) -> list[InputPartition]:
        con, layer, _, _ = self.open()
        return self.parts(1 + (con.execute(f'SELECT max(rowid) FROM "{layer}"').fetchone()[0] or 0))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        con, layer, column, indexed = self.open()
        near, asked = "", [partition.first, partition.last]
        if self.box and indexed:
            near = f' AND rowid IN (SELECT id FROM "rtree_{layer}_{column}" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)'
            asked += [self.box[0], self.box[2], self.box[1], self.box[3]]
        names = "".join(f', "{n}"' for n in self.names)
        cursor = con.execute(f'SELECT "{column}"{names} FROM "{layer}" WHERE rowid >= ? AND rowid < ?{near} ORDER BY rowid', asked)
        while rows := cursor.fetchmany(2048):
            out = []
            for raw, *rest in rows:
                if raw is None:
                    out += [] if self.box else [("none", [], *rest)]
                    continue
                kind, parts, _ = from_wkb(raw, 8 + (0, 32, 48, 48, 64)[raw[3] >> 1 & 7])
                every = [p for q in parts for p in q]
                if every and not misses((min(p["x"] for p in every), min(p["y"] for p in every), max(p["x"] for p in every), max(p["y"] for p in every)), self.box):
                    out.append((kind, parts, *rest))
            yield self.batch(out)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        wanted = json.loads(self.options.get("columns", "null"))
        con, layer, column, _ = PackageReader(self.options, StructType()).open()
        kind = lambda t: "long" if re.search("INT", t) else "double" if re.search("REAL|DOUBLE|FLOAT|NUM", t) else "binary" if "BLOB" in t else "string"
        found = [(n, kind(t.upper())) for _, n, t, _, _, key in con.execute(f'PRAGMA table_info("{layer}")') if n != column and not key]
        return ", ".join([GEOMETRY, *[f"`{n}` {t}" for n, t in found if wanted is None or n in wanted]])

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(self.options, schema)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, layer: str | None = None) -> DataFrame:
    """A layer by its file name: .gpkg, .shp or .zip."""
    source = PackageSource if path.lower().endswith(".gpkg") else ShapeSource
    ship(spark).dataSource.register(source)
    options = {"box": json.dumps(list(box))} if box else {}
    options |= ({"columns": json.dumps(columns)} if columns is not None else {}) | ({"layer": layer} if layer else {})
    return spark.read.format(source.name()).options(**options).load(path)


def write(df: DataFrame, path: str, epsg: int, kind: str = "gpkg", layer: str | None = None) -> tuple[str | None, int]:
    """`df` (kind, parts, attributes) as a layer file with its suffix; (path or None, features). Without features there is no file."""
    path = re.sub(r"\.(gpkg|shp)$", "", path) + f".{kind}"
    attributes = [c for c in df.columns if c not in ("kind", "parts")]
    ordered = df.select("kind", "parts", *attributes)
    named = short_names(ordered.select(*attributes)).columns if kind == "shp" else attributes
    types = [dict(df.dtypes)[c] for c in attributes]
    name = layer or os.path.basename(path).rsplit(".", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()
        try:
            rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            base = os.path.join(folder, "layer")
            n = (shape_file if kind == "shp" else package)(base, rows, list(zip(named, types)), epsg, name)
            if n:
                fs, where = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                for f in sorted(os.listdir(folder), key=lambda f: f.endswith(".shp")):
                    target = where[: -len(kind)] + f.rsplit(".", 1)[1]
                    with open(os.path.join(folder, f), "rb") as source, fs.open_output_stream(f"{target}.part", compression=None) as out:
                        shutil.copyfileobj(source, out, 1 << 20)
                    fs.move(f"{target}.part", target)
            yield pa.RecordBatch.from_pydict({"n": [n]})
        finally:
            shutil.rmtree(folder)

    ship(df.sparkSession)
    n = sum(r["n"] for r in ordered.coalesce(1).mapInArrow(run, "n long").collect())
    return (path if n else None), n


def package(base: str, rows: Iterator[tuple], fields: list[tuple[str, str]], epsg: int, layer: str) -> int:
    """A GeoPackage of one layer with an index; the number of features."""
    con = sqlite3.connect(f"{base}.gpkg")
    sql = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    geographic = epsg == 4326
    con.executescript(f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('EPSG:{epsg}', {epsg}, 'EPSG', {epsg}, '{"GEOGCS" if geographic else "PROJCS"}["EPSG:{epsg}"]', NULL);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
        CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);""")
    con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f""", "{n}" {sql.get(t, "TEXT")}""" for n, t in fields)})')
    con.execute(f'CREATE VIRTUAL TABLE "rtree_{layer}_geom" USING rtree(id, minx, maxx, miny, maxy)')
    n, bounds = 0, [float("inf"), float("inf"), -float("inf"), -float("inf")]
    for kind, parts, *rest in rows:
        n += 1
        every = [p for q in parts or [] for p in q]
        own = [min(p["x"] for p in every), min(p["y"] for p in every), max(p["x"] for p in every), max(p["y"] for p in every)] if every else None
        raw = b"GP" + struct.pack("<BBi4d", 0, 3, epsg, own[0], own[2], own[1], own[3]) + wkb(kind, parts) if own else None
        con.execute(f'INSERT INTO "{layer}" VALUES (?, ?{", ?" * len(fields)})', (n, raw, *[v if isinstance(v, (int, float, str, bytes, type(None))) else str(v) for v in rest]))
        if own:
            con.execute(f'INSERT INTO "rtree_{layer}_geom" VALUES (?, ?, ?, ?, ?)', (n, own[0], own[2], own[1], own[3]))
            bounds = [*map(min, bounds[:2], own[:2]), *map(max, bounds[2:], own[2:])]
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *bounds, epsg))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, epsg))
    con.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (layer,))
    con.commit()
    con.close()
    return n


def shape_file(base: str, rows: Iterator[tuple], fields: list[tuple[str, str]], epsg: int, layer: str) -> int:
    """The files of a Shapefile of the kind of its first feature; the number of features. Texts are cut at 254 bytes."""
    form = {"bigint": ("N", 18, 0), "int": ("N", 11, 0), "smallint": ("N", 6, 0), "boolean": ("L", 1, 0), "double": ("N", 24, 15), "float": ("N", 24, 15), "date": ("D", 8, 0)}
    widths = [form.get(t, ("C", 254, 0)) for _, t in fields]
    n, bounds, code, at = 0, [float("inf"), float("inf"), -float("inf"), -float("inf")], 0, 100

    def text(v: object, f: tuple[str, int, int]) -> bytes:
        if f[0] == "L":
            return b"?" if v is None else b"T" if v else b"F"
        s = "" if v is None else v.strftime("%Y%m%d") if f[0] == "D" else repr(float(v)) if f[2] else str(v)
        raw = s.encode()[: f[1]].decode("utf-8", "ignore").encode()
        return raw.rjust(f[1]) if f[0] == "N" else raw.ljust(f[1])

    with open(f"{base}.shp", "wb") as shp, open(f"{base}.shx", "wb") as shx, open(f"{base}.dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        dbf.write(b"\0" * (33 + 32 * len(fields)))
        for kind, parts, *rest in rows:
            n += 1
            code = code or SHAPES.get(kind, 0)
            every = [p for q in parts or [] for p in q]
            if not every:
                raw = struct.pack("<i", 0)
            else:
                own = [min(p["x"] for p in every), min(p["y"] for p in every), max(p["x"] for p in every), max(p["y"] for p in every)]
                bounds = [*map(min, bounds[:2], own[:2]), *map(max, bounds[2:], own[2:])]
                flat = struct.pack(f"<{2 * len(every)}d", *[v for p in every for v in (p["x"], p["y"])])
                starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
                raw = struct.pack("<i", 1) + flat if kind == "point" else struct.pack("<i4d2i", SHAPES[kind], *own, len(parts), len(every)) + struct.pack(f"<{len(parts)}i", *starts) + flat
            shp.write(struct.pack(">2i", n, len(raw) // 2) + raw)
            shx.write(struct.pack(">2i", at // 2, len(raw) // 2))
            at += 8 + len(raw)
            dbf.write(b" " + b"".join(text(v, f) for v, f in zip(rest, widths, strict=True)))
        dbf.write(b"\x1a")
        for f, size in ((shp, at), (shx, 100 + 8 * n)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, code, *(bounds if n else [0.0] * 4), 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(struct.pack("<B3BIHH20x", 3, 95, 7, 26, n, 33 + 32 * len(fields), 1 + sum(f[1] for f in widths)))
        for (name, _), f in zip(fields, widths):
            dbf.write(struct.pack("<11sc4xBB14x", name.encode()[:10], f[0].encode(), f[1], f[2]))
        dbf.write(b"\x0d")
    with open(f"{base}.cpg", "w") as cpg:
        cpg.write("UTF-8")
    with open(f"{base}.prj", "w") as prj:
        prj.write(system_text(epsg))
    return n


def system_text(epsg: int) -> str:
    """The text of a coordinate system as Shapefiles carry it: WGS 84, plain or UTM."""
    base = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        return base
    zone, south = epsg % 100, epsg > 32700
    return f'PROJCS["WGS_1984_UTM_Zone_{zone}{"S" if south else "N"}",{base},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",{10_000_000.0 if south else 0.0}],PARAMETER["Central_Meridian",{zone * 6.0 - 183}],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
