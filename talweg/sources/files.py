"""Files: archive members, tab-separated gazetteers, lists, scene and map JSON, cache indexes, grids, vector layers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship

GAZETTEER = "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, class string, code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified string"


def archive_members(spark: SparkSession, path: str, pattern: str = ".*", only_first: bool = False, skip_broken: bool = False) -> DataFrame:
    """(archive, member, content) of the ZIP files at `path` whose member names match, without regard to case.

    A broken archive is an error that names it, so that it can be fetched again; with `skip_broken` it gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern, re.IGNORECASE)
        for b in batches:
            rows = []
            for where, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        names = [n for n in z.namelist() if wanted.search(n)]
                        rows += [(where, n, z.read(n)) for n in (names[:1] if only_first else names)]
                except zipfile.BadZipFile as e:
                    if not skip_broken:
                        raise zipfile.BadZipFile(f"{where}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["archive", "member", "content"])

    return ship(spark).read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """The 19 columns of a gazetteer: a tab-separated text, or ZIP archives of them; quotes are ordinary characters."""
    if not path.endswith(".zip"):
        return spark.read.csv(path, sep="\t", schema=GAZETTEER, quote="", encoding="UTF-8")
    lines = archive_members(spark, path, r"(^|/)[A-Z]{2}\.txt$").select(F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("value")).where("value <> ''")
    return lines.select(F.from_csv("value", F.lit(GAZETTEER), {"sep": "\t", "quote": "\u0000"}).alias("g")).select("g.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name): the white-space separated names of a list."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("name")).where("name <> ''").distinct()


def catalogue_tiles(names: DataFrame) -> DataFrame:
    """(lat0, lon0) of elevation product names."""
    part = lambda k: F.regexp_extract("name", r"_([NS])(\d{2})_00_([EW])(\d{3})_00_", k)
    signed = lambda s, n, minus: F.when(part(s) == minus, -part(n).cast("int")).otherwise(part(n).cast("int"))
    return names.where(part(1) != "").select(signed(1, 2, "S").alias("lat0"), signed(3, 4, "W").alias("lon0"))


def two_letter_country(spark: SparkSession, path: str, iso3: str) -> str:
    """The two-letter code of a country from a table whose first columns are the codes; lines of # are remarks."""
    cells = F.split("value", "\t")
    row = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).where(F.get(cells, F.lit(1)) == iso3.upper()).select(F.get(cells, F.lit(0)).alias("c")).first()
    if row is None:
        raise ValueError(f"unknown country {iso3}")
    return row["c"]


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene, date, scene_cloud, west, south, east, north, visual and class addresses of catalogue JSON files."""
    item = "struct<id:string,bbox:array<double>,properties:map<string,string>,assets:map<string,struct<href:string>>>"
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{item}>")["features"]).alias("f"))
    side = [F.get("f.bbox", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return found.select(F.col("f.id").alias("scene"), F.substring(F.col("f.properties")["datetime"], 1, 10).alias("date"), F.col("f.properties")["eo:cloud_cover"].cast("double").alias("scene_cloud"), *side, F.col("f.assets")["visual"]["href"].alias("visual"), F.col("f.assets")["scl"]["href"].alias("classes"))


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """kind, osm_id, tags (JSON), lon, lat and line of map query answers."""
    element = "struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"elements array<{element}>")["elements"]).alias("e"))
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return e.select(F.col("e.type").alias("kind"), F.col("e.id").alias("osm_id"), F.to_json("e.tags").alias("tags"), "e.lon", "e.lat", line.alias("line"))


def cache_index(spark: SparkSession, path: str) -> DataFrame:
    """(url, sha256, bytes, path) of a JSON cache index; missing or broken files give no rows."""
    schema = "map<string,struct<sha256:string,bytes:long,path:string>>"
    try:
        text = spark.read.text(path, wholetext=True)
        return text.select(F.explode(F.from_json("value", schema)).alias("url", "v")).select("url", "v.*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "url string, sha256 string, bytes long, path string")


class GridPartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class GridReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, where = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(where)
        files = [where] if info.type == pafs.FileType.File else [f.path for f in fs.get_file_info(pafs.FileSelector(where)) if f.path.endswith(".asc")]
        return [GridPartition(f) for f in sorted(files)]

    def read(self, partition: GridPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            lines = f.read().decode().splitlines()
        head, rows = {}, []
        for line in lines:
            first, *rest = line.split() or [""]
            if first and first[0].isalpha():
                head[first.lower()] = float(rest[0])
            elif first:
                rows.append([first, *rest])
        missing = head.get("nodata_value", -9999.0)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if (z := float(v)) != missing and z == z:
                    yield partition.path, r, c, z


class GridSource(DataSource):
    """spark.read.format("asc").load(path): the valid cells of ASCII grids, a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "asc"

    def schema(self) -> str:
        return "path string, row int, col int, z double"

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(self.options)


def ascii_grid(cells: DataFrame, width: int, height: int, x0: float, y1: float, cell: float, nodata: float = -9999.0) -> DataFrame:
    """(row, line): the lines of an ASCII grid, header lines with negative rows; a line is one row of the grid."""
    head = [f"ncols {width}", f"nrows {height}", f"xllcorner {x0}", f"yllcorner {y1 - height * cell}", f"cellsize {cell}", f"NODATA_value {nodata}"]
    spark = cells.sparkSession
    filled = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "z"))).alias("m"))
    every = spark.range(height).select(F.col("id").cast("int").alias("row")).join(filled, "row", "left")
    value = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata)).cast("string"))
    return spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "row int, line string").unionByName(every.select("row", F.array_join(value, " ").alias("line")))


def short_names(df: DataFrame, most: int = 10) -> DataFrame:
    """Column names cut to what shape files hold; clashes get numbers."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        short = c[:most]
        if short.lower() in seen:
            seen[short.lower()] += 1
            short = f"{short[: most - 2]}_{seen[short.lower()]}"
        seen.setdefault(short.lower(), 0)
        names.append(short)
    return df.toDF(*names)


def write_layer(df: DataFrame, path: str, kind: str = "gpkg") -> str:
    """A layer as Parquet, with the name limits of the format that was asked for."""
    (short_names(df) if kind == "shp" else df).write.mode("overwrite").parquet(path)
    return path
