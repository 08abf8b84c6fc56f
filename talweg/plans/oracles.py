"""The same results in DuckDB SQL, for the queries of `queries.py`."""

from __future__ import annotations

from ..functions import crs
from ..schemas import COUNTRIES, NEIGHBOURS, PLACE_CLASSES, REGIONS, SHEET_LETTERS

P = "(SELECT c_custkey AS id, CAST(300000 + c_custkey * 7919 % 400000 AS DOUBLE) AS x, CAST(8600000 + c_custkey * 104729 % 400000 AS DOUBLE) AS y FROM customer)"
R = f"(SELECT *, CASE WHEN id % 3 <> 0 THEN x + (id % 7 - 3) * 2000.0 END AS hx, CASE WHEN id % 3 <> 0 THEN y + (id % 5 - 3) * 3000.0 END AS hy, CASE WHEN id % 6 = 0 THEN CAST(id % 500 + 1 AS DOUBLE) END AS a FROM {P})"
B = "(SELECT c_custkey AS id, -81e0 + (c_custkey * 31 % 1200) / 100e0 AS w, -18e0 + (c_custkey * 17 % 1700) / 100e0 AS s, -81e0 + (c_custkey * 31 % 1200) / 100e0 + (c_custkey % 9 + 1) / 4e0 AS e, -18e0 + (c_custkey * 17 % 1700) / 100e0 + (c_custkey % 7 + 1) / 4e0 AS n FROM customer)"
CATALOGUE = "(SELECT lat0, lon0 FROM range(-90, 90) a(lat0), range(-180, 180) b(lon0) WHERE (lat0 * 31 + lon0) % 5 <> 0)"


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def lonlat(source: str, epsg: str = "32718", keep: str = "id, x, y") -> str:
    """`source` with lon and lat, for south zones: the same series written out."""
    xi = f"(y - 10000000e0) / {num(crs.SCALE * crs.RADIUS)}"
    eta = f"(x - 500000e0) / {num(crs.SCALE * crs.RADIUS)}"
    xi_ = "xi" + "".join(f" - {num(b)} * sin({2 * j + 2} * xi) * cosh({2 * j + 2} * eta)" for j, b in enumerate(crs.INVERSE))
    eta_ = "eta" + "".join(f" - {num(b)} * cos({2 * j + 2} * xi) * sinh({2 * j + 2} * eta)" for j, b in enumerate(crs.INVERSE))
    lat = "chi" + "".join(f" + {num(v)} * sin({2 * j + 2} * chi)" for j, v in enumerate(crs.LATITUDE))
    return f"""(SELECT {keep}, z * 6e0 - 183e0 + degrees(atan2(sinh(eta_), cos(xi_))) AS lon, degrees({lat}) AS lat FROM
        (SELECT *, asin(sin(xi_) / cosh(eta_)) AS chi FROM (SELECT *, {xi_} AS xi_, {eta_} AS eta_ FROM (SELECT *, ({epsg}) % 100 AS z, {xi} AS xi, {eta} AS eta FROM {source}))))"""


def label(v: str, up: str, down: str, n: int) -> str:
    return f"CASE WHEN {v} >= 0 THEN '{up}' ELSE '{down}' END || lpad(CAST(abs({v}) AS VARCHAR), {n}, '0')"


TILES = f"(SELECT id, CAST(floor(lat) AS INT) AS lat0, CAST(floor(lon) AS INT) AS lon0 FROM {lonlat(P)})"
NAME = f"'Copernicus_DSM_COG_' || CASE WHEN id % 2 = 0 THEN '10_' ELSE '30_' END || {label('lat0', 'N', 'S', 2)} || '_00_' || {label('lon0', 'E', 'W', 3)} || '_00_DEM'"
AOI = f"""(SELECT *, CASE WHEN hx IS NOT NULL THEN 'rectangulo' WHEN a > 0 THEN 'radio_hack' ELSE 'radio_fijo' END AS method,
    CASE WHEN hx IS NOT NULL THEN greatest(1000e0, 0.6e0 * sqrt((hx - x) * (hx - x) + (hy - y) * (hy - y))) WHEN a > 0 THEN greatest(1.5e0 * (1.78e0 * pow(a, 0.49e0)) * 1000e0, 1000e0) ELSE 10000e0 END AS m FROM {R})"""


def selection(size: int, catalogue: bool) -> str:
    cells = f"""SELECT b.id, CAST(la AS INT) AS lat0, CAST(((lo + 180) % 360 + 360) % 360 - 180 AS INT) AS lon0, greatest(0e0, least(e, lo + {size}) - greatest(w, lo)) * greatest(0e0, least(n, la + {size}) - greatest(s, la)) AS inter, (e - w) * (n - s) AS total FROM
        {B} b, LATERAL (SELECT unnest(range(CAST(floor(s / {size}) * {size} AS BIGINT), CAST(greatest(ceil(n / {size}) * {size}, floor(s / {size}) * {size} + {size}) AS BIGINT), {size})) AS la), LATERAL (SELECT unnest(range(CAST(floor(w / {size}) * {size} AS BIGINT), CAST(greatest(ceil(e / {size}) * {size}, floor(w / {size}) * {size} + {size}) AS BIGINT), {size})) AS lo)"""
    missing = "WHEN k.lat0 IS NULL THEN 'missing'" if catalogue else ""
    join = f"LEFT JOIN {CATALOGUE} k ON k.lat0 = c.lat0 AND k.lon0 = c.lon0" if catalogue else ""
    return f"SELECT c.id, c.lat0, c.lon0, inter / total AS fraction, CASE WHEN inter <= 1e-9 THEN 'touching' {missing} ELSE 'needed' END AS status FROM ({cells}) c {join}"


SHEET = lambda lon, lat: f"CASE WHEN {lat} > 0 OR floor(-({lat}) / 0.5e0) + 1 > 39 OR floor(({lon} + 81.5e0) / 0.5e0) < 0 OR floor(({lon} + 81.5e0) / 0.5e0) >= 26 THEN NULL ELSE lpad(CAST(CAST(floor(-({lat}) / 0.5e0) + 1 AS INT) AS VARCHAR), 2, '0') || '-' || substr('{SHEET_LETTERS}', CAST(floor(({lon} + 81.5e0) / 0.5e0) AS INT) + 1, 1) END"
PERU = "lon BETWEEN {} AND {} AND lat BETWEEN {} AND {}".format(*[num(COUNTRIES[0][i]) for i in (1, 3, 2, 4)])


def point_error(src: str, x: str, y: str) -> str:
    return f"""CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'number' WHEN NOT ({x} BETWEEN 100000 AND 900000 AND {y} BETWEEN 0 AND 10000000) THEN 'range'
        WHEN NOT ({src}.lon BETWEEN -79.5e0 AND -70.5e0 AND {src}.lat BETWEEN -81.5e0 AND 1.5e0) THEN 'area_of_use' WHEN NOT ({PERU.replace('lon', src + '.lon').replace('lat', src + '.lat')}) THEN 'country' END"""


ODD = f"""(SELECT id, x, y, CASE WHEN id % 17 = 1 THEN x + 40e0 ELSE hx END AS hx, CASE WHEN id % 17 = 1 THEN y + 30e0 + (id % 5) * 40 ELSE hy END AS hy FROM
    (SELECT id, CASE WHEN id % 11 = 0 THEN x * 10 ELSE x END AS x, CASE WHEN id % 13 = 0 THEN y * 0.7e0 ELSE y END AS y, hx, hy FROM {R}))"""
OUT = lonlat(f"(SELECT id, x, y FROM {ODD})")
HEAD = lonlat(f"(SELECT id, hx AS x, hy AS y FROM {ODD})")
SCENES = """(SELECT request, scene, scene % 3 <> 0 AS complete, CAST(scene % 40 AS DOUBLE) AS scene_cloud, date, row_number() OVER (PARTITION BY request ORDER BY scene) AS place, cloudy, seen,
    (cloudy * 1000 + greatest(seen, 1) // 2) // greatest(seen, 1) AS per_mille FROM
    (SELECT user_id % 50 AS request, user_id AS scene, strftime(max(CAST(ts AS DATE)), '%Y-%m-%d') AS date, count(*) FILTER (event_id % 12 IN (3, 8, 9, 10)) AS cloudy, count(*) FILTER (event_id % 12 > 0) AS seen FROM events GROUP BY 1, 2))"""


def stop(source: str) -> str:
    return f"(SELECT * FROM (SELECT *, max(CASE WHEN complete AND 100 * cloudy < greatest(seen, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY request ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS halt FROM {source}) WHERE coalesce(halt, 0) = 0)"


RANK = "row_number() OVER (PARTITION BY request ORDER BY complete DESC, per_mille, date DESC, place)"
#: The first five of a request by cloud. The limit stands a level above: QUALIFY beside REPLACE would take the place that is replaced.
USABLE = f"""(SELECT * FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY request ORDER BY scene_cloud, scene) AS place) FROM
    (SELECT *, max(CAST(complete AS INT)) OVER (PARTITION BY request) AS anyfull FROM {SCENES} WHERE scene_cloud < 30) WHERE anyfull = 0 OR complete) WHERE place <= 5)"""

WIDTH = "(SELECT greatest(40, CAST(floor(sqrt(count(*) // 10)) AS BIGINT) // 8 * 8) FROM lineitem)"
DEM = f"dem AS (SELECT CAST(l_orderkey % {WIDTH} AS INT) AS row, CAST(l_partkey % {WIDTH} AS INT) AS col, min(CAST(round(l_extendedprice) AS BIGINT)) * {{}} AS z FROM lineitem GROUP BY 1, 2)"
NB = "nb(k, dr, dc) AS (VALUES " + ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate(NEIGHBOURS)) + ")"
SEEDS = "seed AS (SELECT d.row, d.col, any_value(d.z) AS z FROM dem d CROSS JOIN nb LEFT JOIN dem o ON o.row = d.row + dr AND o.col = d.col + dc GROUP BY d.row, d.col HAVING count(o.row) < 8)"
FILL = """f(row, col, v) USING KEY (row, col) AS (SELECT row, col, z FROM seed UNION
    SELECT d.row, d.col, min(greatest(d.z, f.v + 1)) FROM f CROSS JOIN nb JOIN dem d ON d.row = f.row + dr AND d.col = f.col + dc LEFT JOIN recurring.f k ON k.row = d.row AND k.col = d.col
    WHERE k.v IS NULL OR greatest(d.z, f.v + 1) < k.v GROUP BY d.row, d.col)"""
D8 = """edge AS (SELECT a.row, a.col, CAST(a.row AS BIGINT) * 4294967296 + a.col AS node, b.down FROM f a LEFT JOIN
    (SELECT row, col, down FROM (SELECT p.row, p.col, CAST(q.row AS BIGINT) * 4294967296 + q.col AS down, row_number() OVER (PARTITION BY p.row, p.col ORDER BY (p.v - q.v) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2e0) ELSE 1e0 END DESC, k) AS i
        FROM f p CROSS JOIN nb JOIN f q ON q.row = p.row + dr AND q.col = p.col + dc WHERE p.v > q.v) WHERE i = 1) b ON a.row = b.row AND a.col = b.col)"""
ACC = "way(node, spot) AS (SELECT node, node FROM edge UNION ALL SELECT w.node, e.down FROM way w JOIN edge e ON e.node = w.spot WHERE e.down IS NOT NULL), flow AS (SELECT e.row, e.col, e.node, e.down, n.acc FROM edge e JOIN (SELECT spot, count(*) AS acc FROM way GROUP BY spot) n ON n.spot = e.node), outlet AS (SELECT node FROM flow ORDER BY acc DESC, node LIMIT 1)"
GRID = f"WITH RECURSIVE {DEM.format(1048576)}, {NB}, {SEEDS}, {FILL}"
FLOW = f"{GRID}, {D8}, {ACC}"
SAMPLES = "(SELECT c_custkey AS id, c_custkey * 37 % 4000 / 100e0 + 0.005e0 AS u, c_custkey * 53 % 4000 / 100e0 + 0.005e0 AS v FROM customer)"


def in_ring(ring: list[tuple[float, float]], x: str, y: str) -> str:
    edges = zip(ring, ring[1:] + ring[:1], strict=True)
    return "(" + " + ".join(f"CASE WHEN ({num(a[1])} > {y}) <> ({num(b[1])} > {y}) AND {x} < ({num(b[0])} - {num(a[0])}) * (({y} - {num(a[1])}) / ({num(b[1])} - {num(a[1])})) + {num(a[0])} THEN 1 ELSE 0 END" for a, b in edges) + ") % 2 = 1"


AREAS = """(SELECT id, x - s + 0.5e0 AS x1, y - s + 0.25e0 AS y1, x + s + 0.125e0 AS x2, y - s / 2e0 + 0.5e0 AS y2, x + s / 4e0 + 0.25e0 AS x3, y + 0.75e0 AS y3, x + s + 0.5e0 AS x4, y + s + 0.125e0 AS y4, x - s / 2e0 + 0.75e0 AS x5, y + s + 0.625e0 AS y5, s FROM
    (SELECT c_custkey AS id, 300000 + c_custkey * 7919 % 400000 AS x, 8600000 + c_custkey * 104729 % 400000 AS y, (c_custkey * 131 % 1000 + 200) * 4 + CASE WHEN c_custkey % 97 = 0 THEN 60000 ELSE 0 END AS s FROM customer))"""
PLACES = "(SELECT p_partkey AS id, CAST(300000 + p_partkey * 6151 % 400000 AS DOUBLE) AS x, CAST(8600000 + p_partkey * 92821 % 400000 AS DOUBLE) AS y FROM part)"
PENTAGON = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)]


def in_area(a: str, x: str, y: str) -> str:
    return "(" + " + ".join(f"CASE WHEN ({a}.y{i} > {y}) <> ({a}.y{j} > {y}) AND {x} < ({a}.x{j} - {a}.x{i}) * (({y} - {a}.y{i}) / ({a}.y{j} - {a}.y{i})) + {a}.x{i} THEN 1 ELSE 0 END" for i, j in PENTAGON) + ") % 2 = 1"


def side_of(a: str, i: int, j: int, b: str, k: int) -> str:
    return f"sign(({a}.x{j} - {a}.x{i}) * ({b}.y{k} - {a}.y{i}) - ({a}.y{j} - {a}.y{i}) * ({b}.x{k} - {a}.x{i}))"


def areas_cross(a: str, b: str) -> str:
    return " OR ".join(f"({side_of(a, i, j, b, k)} * {side_of(a, i, j, b, m)} <= 0 AND {side_of(b, k, m, a, i)} * {side_of(b, k, m, a, j)} <= 0)" for i, j in PENTAGON for k, m in PENTAGON)


LS = "(SELECT c_custkey AS id, c_custkey * 37 % 1200 + 400 AS s, (c_custkey * 37 % 1200 + 400) // 3 AS a, c_custkey % 90 + 10 AS r FROM customer)"
OVERLAP = lambda w, s, e, n, w2, s2, e2, n2: f"greatest(0, least({e}, {e2}) - greatest({w}, {w2})) * greatest(0, least({n}, {n2}) - greatest({s}, {s2}))"
#: An L as two boxes side by side: the foot and the rest of the stem.
BOXES = lambda t, dx, dy: [(f"{dx}", f"{dy}", f"{t}.s + {dx}", f"{t}.a + {dy}"), (f"{dx}", f"{t}.a + {dy}", f"{t}.a + {dx}", f"{t}.s + {dy}")]

NOTCHED = [(3.2, 3.1), (36.3, 8.4), (30.7, 35.2), (18.1, 17.3), (5.4, 30.6)]

ORACLES = {
    "utm_inverse": f"SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {lonlat(P)}",
    "utm_round_trip": f"SELECT id, true AS same FROM {P}",
    # the rule of the codes written anew, each known system as a row
    "system_resolution": """WITH known(code, zone, h) AS (SELECT 32600 + z, z, 'N' FROM range(1, 61) r(z) UNION ALL SELECT 32700 + z, z, 'S' FROM range(1, 61) r(z) UNION ALL SELECT 31965 + i, 11 + i, 'N' FROM range(0, 12) r(i)
            UNION ALL SELECT 31977 + i, 17 + i, 'S' FROM range(0, 9) r(i) UNION ALL SELECT 24817 + i, 17 + i, 'N' FROM range(0, 5) r(i) UNION ALL SELECT 24877 + i, 17 + i, 'S' FROM range(0, 6) r(i) UNION ALL VALUES (4326, NULL, NULL), (4674, NULL, NULL)),
        asked AS (SELECT k AS id, CASE WHEN k % 4 = 0 THEN 32700 + k % 70 WHEN k % 8 = 1 THEN 4326 WHEN k % 8 = 5 THEN 31960 + k % 40 END AS epsg, CASE WHEN k % 3 <> 0 THEN k % 65 END AS zone,
            CASE WHEN k % 5 <> 0 THEN CASE k % 7 WHEN 0 THEN 'south' WHEN 1 THEN 'N' WHEN 2 THEN ' sur' WHEN 3 THEN 'X' WHEN 4 THEN 'S' END END AS hemisphere, CASE k % 6 WHEN 1 THEN 'SIRGAS2000' WHEN 2 THEN 'PSAD56' WHEN 3 THEN 'NAD27' ELSE 'WGS84' END AS datum FROM (SELECT c_custkey AS k FROM customer)),
        lettered AS (SELECT *, upper(trim(hemisphere)[1:1]) AS h FROM asked),
        coded AS (SELECT *, coalesce(epsg, CASE WHEN datum = 'WGS84' AND h = 'N' THEN 32600 WHEN datum = 'WGS84' AND h = 'S' THEN 32700 WHEN datum = 'SIRGAS2000' AND h = 'S' THEN 31960 WHEN datum = 'PSAD56' AND h = 'S' THEN 24860 END + zone) AS code FROM lettered),
        judged AS (SELECT c.id, c.code, CASE WHEN c.hemisphere IS NOT NULL AND c.h NOT IN ('N', 'S') THEN 'hemisphere' WHEN c.zone IS NOT NULL AND c.zone NOT BETWEEN 1 AND 60 THEN 'zone' WHEN c.epsg IS NULL AND (c.zone IS NULL OR c.h IS NULL) THEN 'missing'
            WHEN c.code IS NULL THEN 'datum' WHEN k.code IS NULL THEN 'not_utm' WHEN k.zone <> c.zone THEN 'zone_mismatch' WHEN k.h <> c.h THEN 'hemisphere_mismatch' END AS error FROM coded c LEFT JOIN known k ON k.code = c.code)
        SELECT id, CAST(CASE WHEN error IS NULL THEN code END AS INT) AS resolved_epsg, error FROM judged""",
    "tile_code_names": f"SELECT id, {label('lat0', 'N', 'S', 2)} || {label('lon0', 'E', 'W', 3)} AS code, {NAME} AS name, 'https://tiles.example/' || {NAME} || '/' || {NAME} || '.tif' AS url FROM {TILES}",
    "hack_radius": "SELECT c_custkey AS id, round(1.78e0 * pow(abs(c_acctbal) + 1, 0.49e0), 6) AS km, CASE WHEN (abs(c_acctbal) + 1) * 10 > 20000 THEN 90 ELSE 30 END AS metres FROM customer",
    "aoi_preliminary": f"SELECT id, method, round(m, 4) AS margin_m, round(least(x, coalesce(hx, x)) - m, 3) AS west, round(least(y, coalesce(hy, y)) - m, 3) AS south, round(greatest(x, coalesce(hx, x)) + m, 3) AS east, round(greatest(y, coalesce(hy, y)) + m, 3) AS north FROM {AOI}",
    "aoi_area": f"SELECT id, round(CASE WHEN hx IS NOT NULL THEN (abs(hx - x) + 2 * m) * (abs(hy - y) + 2 * m) ELSE 64 * m * m * sin(2 * pi() / 128) END / 1e6, 6) AS km2, round(CASE WHEN hx IS NOT NULL THEN 2 * (abs(hx - x) + abs(hy - y) + 4 * m) ELSE 256 * m * sin(pi() / 128) END / 1e3, 6) AS outline_km FROM {AOI}",
    "tile_candidates": f"SELECT id, lat0, lon0 FROM ({selection(1, False)})",
    "tile_selection": f"SELECT id, lat0, lon0, round(fraction, 9) AS fraction, status FROM ({selection(1, True)})",
    "tile_coverage": f"SELECT id, count(*) AS found, count(*) FILTER (status = 'needed') AS needed, count(*) FILTER (status <> 'needed') AS dropped, round(coalesce(100 * sum(fraction) FILTER (status = 'needed'), 0), 6) AS covered_pct, round(coalesce(100 * sum(fraction) FILTER (status = 'missing'), 0), 6) AS missing_pct FROM ({selection(1, True)}) GROUP BY id",
    "cover_tiles_3deg": f"SELECT id, lat0, lon0, round(fraction, 9) AS fraction, status FROM ({selection(3, False)})",
    "sheet_codes": f"SELECT id, {SHEET('lon', 'lat')} AS sheet FROM (SELECT c_custkey AS id, -83e0 + (c_custkey * 31 % 1700) / 100e0 + 0.003e0 AS lon, -20.5e0 + (c_custkey * 17 % 2200) / 100e0 + 0.003e0 AS lat FROM customer)",
    "sheets_over_areas": f"""SELECT DISTINCT id, sheet FROM (SELECT id, {SHEET('(cw + 0.25e0)', '(cn - 0.25e0)')} AS sheet FROM (SELECT b.*, -i / 2e0 AS cn, -81.5e0 + j / 2e0 AS cw FROM {B} b, range(0, 60) r(i), range(0, 60) c(j))
        WHERE greatest(0e0, least(e, cw + 0.5e0) - greatest(w, cw)) * greatest(0e0, least(n, cn) - greatest(s, cn - 0.5e0)) > 1e-10) WHERE sheet IS NOT NULL""",
    "coord_validation": f"""SELECT id, round(dist, 4) AS distance_m, error, CASE WHEN error IS NULL AND dist < 300 THEN 'close_points' END AS warning FROM (SELECT q.id, sqrt((hx - q.x) * (hx - q.x) + (hy - q.y) * (hy - q.y)) AS dist,
        coalesce({point_error('o', 'q.x', 'q.y')}, CASE WHEN hx IS NOT NULL OR hy IS NOT NULL THEN {point_error('h', 'hx', 'hy')} END, CASE WHEN sqrt((hx - q.x) * (hx - q.x) + (hy - q.y) * (hy - q.y)) < 60 THEN 'same_point' WHEN sqrt((hx - q.x) * (hx - q.x) + (hy - q.y) * (hy - q.y)) > 1000000 THEN 'too_far' END) AS error
        FROM {ODD} q JOIN {OUT} o ON o.id = q.id JOIN {HEAD} h ON h.id = q.id)""",
    "zone_suggestion": f"""SELECT c.c_custkey AS id, CAST(best AS INT) AS zone FROM customer c LEFT JOIN (SELECT id, arg_min(zone, abs(zone - own) * 100 + zone) AS best FROM {lonlat(f"(SELECT id, x, y, 15 + id % 4 AS own, zone FROM {P}, range(1, 61) z(zone) WHERE zone <> 15 + id % 4 AND abs(zone - 15 - id % 4) <= 3)", "zone", "id, own, zone")} t
        JOIN {CATALOGUE} k ON k.lat0 = floor(t.lat) AND k.lon0 = floor(t.lon) WHERE {PERU} GROUP BY id) b ON b.id = c.c_custkey""",
    "on_land": f"SELECT p.id, k.lat0 IS NOT NULL AS on_land FROM {lonlat(P)} p LEFT JOIN {CATALOGUE} k ON k.lat0 = floor(p.lat) AND k.lon0 = floor(p.lon)",
    "region_lookup": f"""SELECT id, CASE WHEN id % 19 = 0 THEN 'sa' WHEN lon <= -32 AND lat < 5 AND insa THEN 'sa' WHEN n = 1 THEN one END AS region FROM (SELECT p.id, any_value(lon) AS lon, any_value(lat) AS lat, count(r.region) AS n, min(r.region) AS one, bool_or(r.region = 'sa') AS insa FROM
        (SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + 0.5e0 AS lon, CAST(c_custkey * 53 % 140 - 58 AS DOUBLE) + 0.5e0 AS lat FROM customer) p LEFT JOIN (VALUES {", ".join(map(str, REGIONS))}) r(region, w, s, e, n) ON lon BETWEEN w AND e AND lat BETWEEN s AND r.n GROUP BY p.id)""",
    "admin_cascade": "SELECT n_name, count(*) AS n, min(c_custkey) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) GROUP BY n_name",
    "nearest_named": f"""SELECT id, b.place_id, b.name, round(b.d, 1) AS distance_m FROM (SELECT id, arg_min({{'place_id': place_id, 'name': name, 'd': d}}, (d, place_id)) AS b FROM (SELECT p.id, s.place_id, s.name, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS d FROM {P} p,
        (SELECT s_suppkey AS place_id, s_name AS name, CAST(300000 + s_suppkey * 6151 % 400000 AS DOUBLE) AS x, CAST(8600000 + s_suppkey * 92821 % 400000 AS DOUBLE) AS y FROM supplier) s) GROUP BY id)""",
    "gazetteer_box": f"""SELECT geonameid, CASE class {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACE_CLASSES.items())} END AS kind, code = 'STM' AS watercourse FROM (SELECT s_suppkey AS geonameid, substr('PHTS', CAST(s_suppkey % 4 AS INT) + 1, 1) AS class, CASE s_suppkey % 3 WHEN 0 THEN 'STM' WHEN 1 THEN 'PPL' ELSE 'MT' END AS code,
        -82e0 + s_suppkey * 7 % 150 / 10e0 AS lon, -19e0 + s_suppkey * 3 % 200 / 10e0 AS lat FROM supplier) WHERE class <> 'S' AND lon BETWEEN -80 AND -70 AND lat BETWEEN -15 AND -2""",
    "points_in_ring": f"SELECT id FROM {P} WHERE {in_ring([(350000.5, 8650000.5), (650000.5, 8700000.5), (600000.5, 8950000.5), (500000.5, 8750000.5), (380000.5, 8900000.5)], 'x', 'y')}",
    "scene_ranking": f"SELECT request, scene, per_mille, {RANK} AS rank FROM {SCENES}",
    "scene_early_stop": f"SELECT request, scene, place FROM {stop(SCENES)}",
    "scene_choice": f"SELECT request, scene, per_mille, date FROM {stop(USABLE)} QUALIFY {RANK} = 1",
    "duplicate_content": "SELECT seq, path, sha256, bytes, first_path, path <> first_path AS duplicate FROM (SELECT doc_id AS seq, 'doc/' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, first_value('doc/' || doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS first_path FROM documents)",
    "url_filename": "SELECT page_id, split_part(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), '?', 1) AS name FROM pages",
    "cache_hits": """SELECT p.page_id, CASE WHEN i.url IS NULL THEN 'missing' WHEN i.sha IS NOT NULL AND i.n > 0 AND (p.page_id % 2 <> 0 OR length(html) + CASE WHEN p.page_id % 7 = 0 THEN 1 ELSE 0 END = i.n) THEN 'reused' ELSE 'stale' END AS state FROM pages p
        LEFT JOIN (SELECT url, CASE WHEN page_id % 5 <> 0 THEN sha256(html) END AS sha, length(html) AS n FROM pages WHERE page_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1) i ON i.url = p.url""",
    "json_tags": "SELECT event_id, coalesce(props ->> '$.k', '') AS k, '' AS missing FROM events",
    "size_labels": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR n_chars = 0 THEN 'unknown size' WHEN n_chars * n_chars >= 100000 THEN format('{:,.1f} MB', n_chars * n_chars / 1e6) ELSE format('{:,.0f} kB', n_chars * n_chars / 1e3) END AS label, replace(format('{:,.0f}', n_chars * 1000e0), ',', ' ') AS chars FROM documents",
    "estimated_bytes": "SELECT source AS provider, count(*) AS resources, CAST(coalesce(sum(n_chars) FILTER (doc_id % 10 <> 0), 0) AS BIGINT) AS bytes_total, CAST(coalesce(sum(n_chars) FILTER (doc_id % 10 <> 0 AND doc_id % 4 <> 0), 0) AS BIGINT) AS bytes_to_fetch, count(*) FILTER (doc_id % 4 = 0) AS cached FROM documents GROUP BY source",
    "manifest_rollup": "SELECT count(*) AS downloads, CAST(coalesce(sum(n_chars) FILTER (doc_id % 4 IN (0, 2)), 0) AS BIGINT) AS bytes_transferred, count(*) FILTER (doc_id % 4 = 1) AS reused, count(*) FILTER (doc_id % 4 = 2) AS duplicates, count(*) FILTER (doc_id % 4 = 3) AS failed FROM documents WHERE doc_id >= 50",
    "number_parsing": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey + 0.5e0 WHEN 1 THEN c_custkey + 0.25e0 END AS value, lower(c_mktsegment) || '+a' AS names FROM customer",
    "dem_seeds": f"WITH {DEM.format(1)}, {NB}, {SEEDS} SELECT row, col FROM seed",
    "fill_int": f"{GRID} SELECT d.row, d.col, d.z, f.v AS f FROM dem d JOIN f ON f.row = d.row AND f.col = d.col",
    "d8_int": f"{GRID}, {D8} SELECT row, col, down FROM edge",
    "flow_accumulation": f"{FLOW} SELECT row, col, acc FROM flow",
    "upstream_basin": f"{FLOW} SELECT w.node FROM way w JOIN outlet o ON w.spot = o.node",
    "drains_to": f"{FLOW} SELECT s.node AS source, o.node AS target, EXISTS (SELECT 1 FROM way w WHERE w.node = s.node AND w.spot = o.node) AS drains FROM flow s, outlet o ",
    "main_channel": f"{FLOW}, best AS (SELECT down, node FROM flow WHERE down IS NOT NULL QUALIFY row_number() OVER (PARTITION BY down ORDER BY acc DESC, node) = 1), up(node, step) AS (SELECT node, CAST(0 AS BIGINT) FROM outlet UNION ALL SELECT b.node, step + 1 FROM up JOIN best b ON b.down = up.node JOIN flow g ON g.node = b.node WHERE g.acc >= 5) SELECT node, step FROM up",
    "snap_outlet": f"{FLOW} SELECT row_number() OVER (ORDER BY d, acc DESC, row, col) AS place, row, col, acc, round(d, 6) AS distance_m FROM (SELECT *, sqrt(CAST((row - 20) * (row - 20) + (col - 20) * (col - 20) AS DOUBLE)) AS d FROM flow) WHERE acc >= 5 AND d <= 6",
    "mask_dilation": f"WITH {DEM.format(1)} SELECT DISTINCT d.row + dr AS row, d.col + dc AS col FROM dem d, range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE z < 1200 AND dr * dr + dc * dc <= 4",
    # area, sides times radius, five round corners of sixteen pieces, and what two sides share at the corner that turns in
    "areas_buffered": f"SELECT id, round((s * a + a * (s - a) + 4 * s * r + 5 * 8 * r * r * sin(pi() / 32) - r * r) / 1e6, 4) AS km2, 1 AS rings FROM {LS}",
    "areas_combined": f"SELECT p.id, {' + '.join(OVERLAP(*b, *c) for b in BOXES('p', 0, 0) for c in BOXES('q', 100, -50))} AS m2 FROM {LS} p JOIN {LS} q ON q.id + 1 = p.id",
    "mask_polygons": f"""WITH RECURSIVE {DEM.format(1)}, low AS (SELECT row, col FROM dem WHERE z < 9000), near(dr, dc) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
        part(row, col, v) USING KEY (row, col) AS (SELECT row, col, CAST(row AS BIGINT) * 4294967296 + col FROM low UNION SELECT l.row, l.col, min(p.v) FROM part p CROSS JOIN near JOIN low l ON l.row = p.row + dr AND l.col = p.col + dc JOIN recurring.part k ON k.row = l.row AND k.col = l.col WHERE p.v < k.v GROUP BY l.row, l.col),
        pairs AS (SELECT a.v, count(*) AS n FROM part a CROSS JOIN near JOIN part b ON b.row = a.row + dr AND b.col = a.col + dc WHERE dr + dc = 1 GROUP BY a.v),
        quads AS (SELECT a.v, count(*) AS n FROM part a JOIN part b ON b.row = a.row + 1 AND b.col = a.col JOIN part c ON c.row = a.row AND c.col = a.col + 1 JOIN part e ON e.row = a.row + 1 AND e.col = a.col + 1 GROUP BY a.v)
        SELECT p.v AS label, count(*) AS cells, 1 - (count(*) - coalesce(any_value(e.n), 0) + coalesce(any_value(q.n), 0)) AS holes, 4 * count(*) - 2 * coalesce(any_value(e.n), 0) AS sides FROM part p LEFT JOIN pairs e ON e.v = p.v LEFT JOIN quads q ON q.v = p.v GROUP BY p.v""",
    "points_in_areas": f"SELECT a.id AS area, p.id AS place FROM {AREAS} a JOIN {PLACES} p ON {in_area('a', 'p.x', 'p.y')}",
    "areas_meeting": f"""SELECT a.id AS area, b.id AS other FROM {AREAS} a JOIN {AREAS} b ON a.id < b.id AND abs(a.x3 - b.x3) <= 2 * (a.s + b.s) AND abs(a.y3 - b.y3) <= 2 * (a.s + b.s)
        WHERE {' OR '.join(in_area('a', f'b.x{k}', f'b.y{k}') for k in range(1, 6))} OR {' OR '.join(in_area('b', f'a.x{k}', f'a.y{k}') for k in range(1, 6))} OR {areas_cross('a', 'b')}""",
    "raster_mosaic": "SELECT CAST(l_orderkey % 60 AS INT) AS row, CAST(l_partkey % 60 AS INT) AS col, arg_min(l_extendedprice, (l_orderkey * 10 + l_linenumber, l_extendedprice)) AS z FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2",
    "bilinear_sample": f"""WITH {DEM.format(1)} SELECT id, round(sum(w * z) / sum(w), 7) AS z FROM (SELECT id, CAST(floor(v - 0.5e0) AS INT) + r AS row, CAST(floor(u - 0.5e0) AS INT) + c AS col,
        CASE r WHEN 1 THEN v - 0.5e0 - floor(v - 0.5e0) ELSE 1 - (v - 0.5e0 - floor(v - 0.5e0)) END * CASE c WHEN 1 THEN u - 0.5e0 - floor(u - 0.5e0) ELSE 1 - (u - 0.5e0 - floor(u - 0.5e0)) END AS w FROM {SAMPLES}, range(0, 2) a(r), range(0, 2) b(c)) k JOIN dem USING (row, col) WHERE w > 0 GROUP BY id""",
    "nearest_sample": f"WITH {DEM.format(1)} SELECT id, z FROM {SAMPLES} s JOIN dem ON row = floor(v) AND col = floor(u)",
    "polygon_mask": f"WITH {DEM.format(1)} SELECT row, col, z FROM dem WHERE {in_ring([(3.2, 3.1), (36.3, 8.4), (30.7, 35.2), (18.1, 17.3), (5.4, 30.6)], '(col + 0.5e0)', '(39.5e0 - row)')}",
    "scanline_mask": f"""WITH {DEM.format(1)}, g AS (SELECT {WIDTH} AS w) SELECT row, col, z FROM dem, g WHERE ({' + '.join(f"CASE WHEN ({a[1]}e0 * (w / 40e0) > w - (row + 0.5e0)) <> ({b[1]}e0 * (w / 40e0) > w - (row + 0.5e0)) AND col + 0.5e0 < ({b[0]}e0 * (w / 40e0) - {a[0]}e0 * (w / 40e0)) * ((w - (row + 0.5e0) - {a[1]}e0 * (w / 40e0)) / ({b[1]}e0 * (w / 40e0) - {a[1]}e0 * (w / 40e0))) + {a[0]}e0 * (w / 40e0) THEN 1 ELSE 0 END"
        for a, b in zip(NOTCHED, NOTCHED[1:] + NOTCHED[:1], strict=True))}) % 2 = 1""",
    "zonal_class_pct": f"WITH {DEM.format(1)} SELECT zone, class, cells, round(100e0 * cells / sum(cells) OVER (PARTITION BY zone), 6) AS percent FROM (SELECT CAST(row // 20 * 2 + col // 20 AS BIGINT) AS zone, CAST(z % 5 AS INT) AS class, count(*) AS cells FROM dem WHERE z % 5 > 0 GROUP BY 1, 2)",
}
ORACLES["drains_to_every"] = ORACLES["drains_to"]
