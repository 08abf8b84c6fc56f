"""The registered queries: each applies its operators to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geom, text
from ..operators import hydro, layers, masks, overlay, provenance, raster, spatial, tiles, validate
from ..schemas import utm_bases
from ..session import checkpointed
from .fixtures import angles, areas, boxes, catalogue, dem, places, points, requests, scenes, side, table


def utm_inverse(spark: SparkSession, d: str) -> DataFrame:
    ll = points(spark, d).select("id", crs.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("p"))
    return ll.select("id", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    ll = points(spark, d).select("id", "x", "y", "epsg", crs.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("p"))
    back = ll.select("id", "x", "y", crs.from_lonlat(F.col("p.lon"), F.col("p.lat"), F.col("epsg")).alias("q"))
    return back.select("id", (F.hypot(F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")) < 0.001).alias("same"))


def system_resolution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, (32700 + k % 70).cast("int")).when(k % 8 == 1, F.lit(4326)).when(k % 8 == 5, (31960 + k % 40).cast("int")).alias("epsg"), F.when(k % 3 != 0, (k % 65).cast("int")).alias("zone"),
        F.when(k % 5 != 0, F.get(F.array(F.lit("south"), F.lit("N"), F.lit(" sur"), F.lit("X"), F.lit("S")), (k % 7).cast("int"))).alias("hemisphere"), F.get(F.array(F.lit("WGS84"), F.lit("SIRGAS 2000"), F.lit("psad-56"), F.lit("NAD27"), F.lit(None)), (k % 6).cast("int")).alias("datum"),
    )
    return crs.resolve_system(asked, utm_bases(spark)).select("id", "resolved_epsg", "error")


def tile_code_names(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", crs.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("p"))
    t = p.select("id", F.floor("p.lat").cast("int").alias("lat0"), F.floor("p.lon").cast("int").alias("lon0"))
    name = text.dem_name(F.col("lat0"), F.col("lon0"), F.when(F.col("id") % 2 == 0, 30).otherwise(90))
    return t.select("id", text.tile_code(F.col("lat0"), F.col("lon0")).alias("code"), name.alias("name"), text.from_template("https://tiles.example/{n}/{n}.tif", n=name).alias("url"))


def hack_radius(spark: SparkSession, d: str) -> DataFrame:
    a = F.abs("c_acctbal") + 1
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(text.hack_length_km(a), 6).alias("km"), tiles.dem_metres(a * 10).alias("metres"))


def aoi_preliminary(spark: SparkSession, d: str) -> DataFrame:
    b = geom.bounds(F.col("ring"))
    return tiles.preliminary_aoi(requests(spark, d)).select("id", "method", F.round("margin_m", 4).alias("margin_m"), *[F.round(b[k], 3).alias(k) for k in ("west", "south", "east", "north")])


def aoi_area(spark: SparkSession, d: str) -> DataFrame:
    return tiles.preliminary_aoi(requests(spark, d)).select("id", F.round(geom.area(F.col("ring")) / 1e6, 6).alias("km2"), F.round(geom.length(F.col("ring"), closed=True) / 1e3, 6).alias("outline_km"))


def tile_candidates(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("id", F.explode(tiles.candidates(geom.bounds(F.col("ring_ll")))).alias("t")).select("id", "t.lat0", "t.lon0")


def tile_selection(spark: SparkSession, d: str) -> DataFrame:
    return tiles.select(boxes(spark, d), catalogue(spark)).select("id", "lat0", "lon0", F.round("fraction", 9).alias("fraction"), "status")


def tile_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = tiles.coverage(tiles.select(boxes(spark, d), catalogue(spark)))
    return c.select("id", "found", "needed", "dropped", F.round("covered_pct", 6).alias("covered_pct"), F.round("missing_pct", 6).alias("missing_pct"))


def cover_tiles_3deg(spark: SparkSession, d: str) -> DataFrame:
    return tiles.select(boxes(spark, d), size=3).select("id", "lat0", "lon0", F.round("fraction", 9).alias("fraction"), "status")


def sheet_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = -83.0 + (k * 31 % 1700) / 100.0 + 0.003, -20.5 + (k * 17 % 2200) / 100.0 + 0.003
    return table(spark, d, "customer").select(k.alias("id"), text.sheet_code(lon, lat).alias("sheet"))


def sheets_over_areas(spark: SparkSession, d: str) -> DataFrame:
    return tiles.sheets(boxes(spark, d))


def coord_validation(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    odd = requests(spark, d).withColumn("x", F.when(i % 11 == 0, F.col("x") * 10).otherwise(F.col("x"))).withColumn("y", F.when(i % 13 == 0, F.col("y") * 0.7).otherwise(F.col("y"))).withColumn("head_x", F.when(i % 17 == 1, F.col("x") + 40.0).otherwise(F.col("head_x"))).withColumn("head_y", F.when(i % 17 == 1, F.col("y") + 30.0 + (i % 5) * 40).otherwise(F.col("head_y")))
    return validate.validate(odd).select("id", F.round("distance_m", 4).alias("distance_m"), "error", "warning")


def zone_suggestion(spark: SparkSession, d: str) -> DataFrame:
    wrong = points(spark, d).withColumn("epsg", (32715 + F.col("id") % 4).cast("int"))
    return validate.suggest_zone(wrong, catalogue(spark)).select("id", "zone")


def on_land(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", crs.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("p")).select("id", "p.lon", "p.lat")
    return validate.on_land(p, catalogue(spark)).select("id", "on_land")


def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = (k * 37 % 360 - 180).cast("double") + 0.5, (k * 53 % 140 - 58).cast("double") + 0.5
    return table(spark, d, "customer").select(k.alias("id"), validate.river_region(lon, lat, F.when(k % 19 == 0, "SA")).alias("region"))


def admin_cascade(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    chosen = region.where(F.col("r_regionkey").isin(1, 3)).select("r_regionkey")
    kept = layers.cascade([(region, "r_regionkey", None), (nation, "n_nationkey", "n_regionkey"), (customer, "c_custkey", "c_nationkey")], chosen)
    return kept[2].join(F.broadcast(kept[1]), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def nearest_named(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    places = table(spark, d, "supplier").select(k.alias("place_id"), F.col("s_name").alias("name"), (300000 + k * 6151 % 400000).cast("double").alias("x"), (8600000 + k * 92821 % 400000).cast("double").alias("y"))
    return layers.nearest(points(spark, d), places).select("id", "place_id", "name", F.round("distance", 1).alias("distance_m"))


def gazetteer_box(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("geonameid"), F.get(F.array(*map(F.lit, "PHTS")), (k % 4).cast("int")).alias("class"), F.get(F.array(*map(F.lit, ["STM", "PPL", "MT"])), (k % 3).cast("int")).alias("code"), (-82.0 + k * 7 % 150 / 10).alias("lon"), (-19.0 + k * 3 % 200 / 10).alias("lat"))
    return layers.gazetteer(rows, -80.0, -15.0, -70.0, -2.0).select("geonameid", "kind", "watercourse")


def points_in_ring(spark: SparkSession, d: str) -> DataFrame:
    ring = [(350000.5, 8650000.5), (650000.5, 8700000.5), (600000.5, 8950000.5), (500000.5, 8750000.5), (380000.5, 8900000.5)]
    return layers.inside(points(spark, d), ring).select("id")


def scene_ranking(spark: SparkSession, d: str) -> DataFrame:
    return layers.rank_scenes(scenes(spark, d), "request").select("request", "scene", "per_mille", "rank")


def scene_early_stop(spark: SparkSession, d: str) -> DataFrame:
    return layers.early_stop(scenes(spark, d), "request").select("request", "scene", "place")


def scene_choice(spark: SparkSession, d: str) -> DataFrame:
    chosen = layers.early_stop(layers.usable_scenes(scenes(spark, d), "request"), "request")
    return layers.rank_scenes(chosen, "request").where("rank = 1").select("request", "scene", "per_mille", "date")


def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    return provenance.duplicates(provenance.digests(docs)).select("seq", "path", "sha256", "bytes", "first_path", "duplicate")


def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    index = p.where(F.col("page_id") % 3 != 0).select("url", F.col("page_id").alias("seq"), F.when(F.col("page_id") % 5 != 0, F.sha2("html", 256)).alias("sha256"), F.length("html").cast("long").alias("bytes"))
    wanted = p.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.length("html").cast("long") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).alias("expected"))
    return provenance.cache_state(wanted, index).select("page_id", "state")


def json_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.tag(F.col("props"), "k").alias("k"), text.tag(F.col("props"), "missing").alias("missing"))


def size_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 10 == 0, None).otherwise((F.col("n_chars") * F.col("n_chars")).cast("double"))
    return table(spark, d, "documents").select("doc_id", text.size_label(n).alias("label"), text.spaced(F.col("n_chars").cast("double") * 1000, 0).alias("chars"))


def estimated_bytes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("provider"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("bytes"), (F.col("doc_id") % 4 == 0).alias("cached"))
    return provenance.plan_totals(docs, "provider")


def manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    state = F.get(F.array(*map(F.lit, ["downloaded", "reused", "downloaded, duplicate", "failed"])), (F.col("doc_id") % 4).cast("int"))
    return provenance.run_totals(table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("n_chars").alias("bytes"), state.alias("state")), 50)


def number_parsing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    t = F.when(F.col("c_custkey") % 4 == 0, F.concat(k, F.lit(",5"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" "), k, F.lit(" .25"))).when(F.col("c_custkey") % 4 == 2, F.lit("  ")).otherwise(F.concat(k, F.lit("x")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.number(t).alias("value"), F.array_join(text.list_of(F.concat_ws(",", "c_mktsegment", F.lit(" A "), F.lit(""), F.lit("a"))), "+").alias("names"))


def block_of(cells: DataFrame) -> int:
    """The side of the blocks of a grid: a fifth of the grid's or a little more, so that several lie side by side at every size, and 512 at most."""
    widest = cells.agg(F.max(F.greatest("row", "col"))).first()[0] or 0
    return min(512, max(8, (widest + 5) // 5))


def dem_seeds(spark: SparkSession, d: str) -> DataFrame:
    cells = checkpointed(dem(spark, d))
    return hydro.seeds(cells, block_of(cells))


def filled(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    cells = checkpointed(dem(spark, d))
    block = block_of(cells)
    return hydro.fill(cells, block, whole=True), block


def flow_in_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(row, col, node, down, acc) and the side of the blocks."""
    f, block = filled(spark, d)
    arrows = checkpointed(hydro.directions(f, block=block))
    return checkpointed(hydro.placed(hydro.accumulation(arrows, block))), block


def flow(spark: SparkSession, d: str) -> DataFrame:
    return flow_in_blocks(spark, d)[0]


def outlet(f: DataFrame) -> DataFrame:
    """The cell of most accumulation, the lowest number among equals."""
    return f.agg(F.max_by("node", F.struct("acc", -F.col("node"))).alias("node"))


def fill_int(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d)[0].select("row", "col", "z", "f")


def d8_int(spark: SparkSession, d: str) -> DataFrame:
    f, block = filled(spark, d)
    return hydro.directions(f, block=block).select("row", "col", "down")


def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d).select("row", "col", "acc")


def upstream_basin(spark: SparkSession, d: str) -> DataFrame:
    f, block = flow_in_blocks(spark, d)
    return hydro.upstream(f.select("node", "down"), outlet(f), block).select("node")


def drains_to(spark: SparkSession, d: str) -> DataFrame:
    """Every cell against the outlet."""
    f, block = flow_in_blocks(spark, d)
    pairs = f.select(F.col("node").alias("source"), F.lit(outlet(f).first()["node"]).alias("target"))
    return hydro.drains_to(f.select("node", "down"), pairs, block)


def drains_to_every(spark: SparkSession, d: str) -> DataFrame:
    """As `drains_to`, under the name that it had while that asked about some cells only."""
    return drains_to(spark, d)


def main_channel(spark: SparkSession, d: str) -> DataFrame:
    f = flow(spark, d)
    return hydro.main_channel(f, outlet(f).first()["node"], 5)


def snap_outlet(spark: SparkSession, d: str) -> DataFrame:
    return hydro.snap_candidates(flow(spark, d), 20, 20, 5, 6.0, 1.0, 1.0).select("place", "row", "col", "acc", F.round("distance_m", 6).alias("distance_m"))


def mask_dilation(spark: SparkSession, d: str) -> DataFrame:
    return hydro.dilated(dem(spark, d, 1).where("z < 1200"), 2.0)


def areas_buffered(spark: SparkSession, d: str) -> DataFrame:
    """All within some metres of rings that aren't convex."""
    grown = overlay.buffered(angles(spark, d), F.col("radius"), "id", unit=2.0**-18)
    return grown.select("id", F.round(F.col("area") / 1e6, 4).alias("km2"), F.size("parts").alias("rings"))


def areas_combined(spark: SparkSession, d: str) -> DataFrame:
    """Each L-shaped ring cut by the next one's, brought to one place: two Ls of one corner."""
    shapes = angles(spark, d).select("id", F.transform("ring", lambda p: geom.point(p["x"] - F.get("ring", F.lit(0))["x"], p["y"] - F.get("ring", F.lit(0))["y"])).alias("ring"))
    one = shapes.select("id", F.array("ring").alias("parts"))
    other = shapes.select((F.col("id") + 1).alias("id"), F.array(F.transform("ring", lambda p: geom.point(p["x"] + 100, p["y"] - 50))).alias("parts")).join(one.select("id"), "id", "left_semi")
    return overlay.combined(one.join(other.select("id"), "id", "left_semi"), other, "intersection", "id").select("id", F.round("area").cast("long").alias("m2"))


def mask_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the low ground, as polygons with holes."""
    cells = dem(spark, d, 1)
    return masks.polygons(cells.where("z < 9000"), block=block_of(cells)).select("label", F.col("area").cast("long").alias("cells"), "holes", F.col("outline").cast("long").alias("sides"))


def points_in_areas(spark: SparkSession, d: str) -> DataFrame:
    return spatial.meeting(areas(spark, d), places(spark, d)).select(F.col("left_id").alias("area"), F.col("right_id").alias("place"))


def areas_meeting(spark: SparkSession, d: str) -> DataFrame:
    each = areas(spark, d)
    return spatial.meeting(each, each, ascending=True).select(F.col("left_id").alias("area"), F.col("right_id").alias("other"))


def raster_mosaic(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    parts = li.select((F.col("l_orderkey") % 60).cast("int").alias("row"), (F.col("l_partkey") % 60).cast("int").alias("col"), F.when(F.col("l_quantity") < 10, -9999.0).otherwise(F.col("l_extendedprice")).alias("z"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("priority"))
    return raster.mosaic(parts)


def samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 4000 / 100.0 + 0.005).alias("u"), (k * 53 % 4000 / 100.0 + 0.005).alias("v"))


def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    return raster.bilinear(samples(spark, d), dem(spark, d, 1)).select("id", F.round("z", 7).alias("z"))


def nearest_sample(spark: SparkSession, d: str) -> DataFrame:
    return raster.nearest(samples(spark, d), dem(spark, d, 1))


def polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    ring = F.array(*[geom.point(x, y) for x, y in ((3.2, 3.1), (36.3, 8.4), (30.7, 35.2), (18.1, 17.3), (5.4, 30.6))])
    return raster.masked(dem(spark, d, 1), ring, 0.0, 40.0, 1.0).select("row", "col", "z")


def scanline_mask(spark: SparkSession, d: str) -> DataFrame:
    """The cells in a notched ring that spans the whole grid, by the rows that its edges pass."""
    cells = dem(spark, d, 1)
    width = side(table(spark, d, "lineitem").count())
    ring = F.array(*[geom.point(F.lit(x) * F.lit(width / 40.0), F.lit(y) * F.lit(width / 40.0)) for x, y in ((3.2, 3.1), (36.3, 8.4), (30.7, 35.2), (18.1, 17.3), (5.4, 30.6))])
    area = spark.range(1).select("id", F.array(ring).alias("parts"))
    return cells.join(raster.covered(area, 0.0, float(width), 1.0, width, width), ["row", "col"]).select("row", "col", "z")


def zonal_class_pct(spark: SparkSession, d: str) -> DataFrame:
    cells = dem(spark, d, 1).select((F.floor(F.col("row") / 20) * 2 + F.floor(F.col("col") / 20)).alias("zone"), (F.col("z") % 5).cast("int").alias("class"))
    return raster.class_shares(cells, "zone").select("zone", "class", "cells", F.round("percent", 6).alias("percent"))


ALL = [
    utm_inverse, utm_round_trip, system_resolution, tile_code_names, hack_radius, aoi_preliminary, aoi_area, tile_candidates, tile_selection, tile_coverage, cover_tiles_3deg, sheet_codes,
    sheets_over_areas, coord_validation, zone_suggestion, on_land, region_lookup, admin_cascade, nearest_named, gazetteer_box, points_in_ring, scene_ranking, scene_early_stop, scene_choice,
    duplicate_content, url_filename, cache_hits, json_tags, size_labels, estimated_bytes, manifest_rollup, number_parsing, dem_seeds, fill_int, d8_int, flow_accumulation, upstream_basin,
    drains_to, drains_to_every, main_channel, snap_outlet, mask_dilation, areas_buffered, areas_combined, mask_polygons, points_in_areas, areas_meeting, raster_mosaic, bilinear_sample, nearest_sample, polygon_mask, scanline_mask, zonal_class_pct,
]
QUERIES = {f.__name__: f for f in ALL}
#: Registered without SQL; held against plain versions in tests.
WITHOUT_SQL: dict = {}
