"""Names, labels and parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PLACE_CLASSES, SHEET_LETTERS, SHEET_ROWS, SHEET_WEST


def tile_code(lat0: Column, lon0: Column, lat_digits: int = 2, lon_digits: int = 3) -> Column:
    """Such as S12W076."""
    part = lambda v, up, down, n: F.concat(F.when(v >= 0, up).otherwise(down), F.lpad(F.abs(v).cast("string"), n, "0"))
    return F.concat(part(lat0, "N", "S", lat_digits), part(lon0, "E", "W", lon_digits))


def dem_name(lat0: Column, lon0: Column, metres: Column) -> Column:
    """The product name of an elevation tile; the code is 10 for 30 m and 30 for 90 m."""
    ns = F.concat(F.when(lat0 >= 0, "N").otherwise("S"), F.lpad(F.abs(lat0).cast("string"), 2, "0"), F.lit("_00"))
    ew = F.concat(F.when(lon0 >= 0, "E").otherwise("W"), F.lpad(F.abs(lon0).cast("string"), 3, "0"), F.lit("_00"))
    return F.concat_ws("_", F.lit("Copernicus_DSM_COG"), F.when(metres == 30, "10").otherwise("30"), ns, ew, F.lit("DEM"))


def from_template(template: str, **parts: Column) -> Column:
    """`template` with each {name} replaced by a column, as in tile addresses."""
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def sheet_code(lon: Column, lat: Column) -> Column:
    """The 1:100 000 sheet of a place, such as 23-m; null outside the grid."""
    row = F.floor(-lat / 0.5) + 1
    col = F.floor((lon - SHEET_WEST) / 0.5)
    letters = F.array(*[F.lit(c) for c in SHEET_LETTERS])
    outside = (lat > 0) | (row > SHEET_ROWS) | (col < 0) | (col >= len(SHEET_LETTERS))
    return F.when(~outside, F.concat(F.lpad(row.cast("string"), 2, "0"), F.lit("-"), F.get(letters, col.cast("int"))))


def hack_length_km(area_km2: Column) -> Column:
    return 1.78 * F.pow(area_km2, F.lit(0.49))


def file_name(url: Column) -> Column:
    """The last part of a URL without its query; a fragment stays."""
    return F.substring_index(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), "?", 1)


def size_label(size: Column) -> Column:
    """MB with one digit from 100 kB on, kB below, a word for unknown."""
    return F.when(size.isNull() | (size == 0), "unknown size").when(size >= 1e5, F.concat(F.format_number(size / 1e6, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(size / 1e3, 0), F.lit(" kB")))


def spaced(value: Column, digits: int = 2) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(" "))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def list_of(text: Column) -> Column:
    """A comma list as distinct lower-case names."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def number(text: Column) -> Column:
    """A number with decimal point or comma; a comma counts as decimal only without a point. Blank and unreadable are null."""
    t = F.regexp_replace(text, r"\s", "")
    return F.when(t != "", F.when(F.contains(t, F.lit(".")), t).otherwise(F.replace(t, F.lit(","), F.lit(".")))).try_cast("double")


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def date_key(date: Column) -> Column:
    """YYYY-MM-DD as an integer, later being larger."""
    return F.replace(date, F.lit("-"), F.lit("")).cast("int")


def tag(json: Column, key: str) -> Column:
    """A string tag of a JSON object, empty where absent or unreadable."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(""))


def cite(text: Column, year: Column) -> Column:
    return F.replace(text, F.lit("[año]"), year.cast("string"))


def place_class(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PLACE_CLASSES.items() for x in kv]), code)


def political_text(level: Column, names: Column) -> Column:
    return F.concat(F.initcap(level), F.lit(": "), F.array_join(names, ", "))


def known_suffix(name: Column) -> Column:
    """The kind of check that a file name calls for, from its last suffix or the one before `.part`."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:\.part)?$", 1))
    return F.when(suffix == "zip", "zip").when(suffix.isin("tif", "tiff"), "raster").when(suffix.isin("json", "geojson"), "json").otherwise("any")
