"""Downloads, products and their record: cache, duplicates, totals, manifest and report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

BOM = "﻿"


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    raw = F.col(content) if dict(files.dtypes)[content] == "binary" else F.encode(F.col(content), "UTF-8")
    return files.withColumn("sha256", F.sha2(raw, 256)).withColumn("bytes", F.octet_length(raw).cast("long"))


def cache_state(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """`wanted` (url, expected) with state: reused (indexed with a digest and, where a size is expected, of that size), stale or missing."""
    known = index.groupBy("url").agg(F.max_by(F.struct("sha256", "bytes"), "seq").alias("_i"))
    ok = F.col("_i.sha256").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("_i.bytes"))) & (F.col("_i.bytes") > 0)
    return wanted.join(known, "url", "left").withColumn("state", F.when(F.col("_i").isNull(), "missing").when(ok, "reused").otherwise("stale")).drop("_i")


def size_problem(size: Column, expected: Column) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size != expected, "size")


def duplicates(files: DataFrame) -> DataFrame:
    """`files` (seq, path, sha256) with first_path and duplicate: the same content came earlier under another path."""
    first = files.groupBy("sha256").agg(F.min_by("path", "seq").alias("first_path"))
    return files.join(first, "sha256").withColumn("duplicate", F.col("path") != F.col("first_path"))


def registered(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry (sha256, path) with new contents added; the first path of a content stays."""
    new = files.groupBy("sha256").agg(F.min_by("path", "seq").alias("path")).join(registry, "sha256", "left_anti")
    return registry.select("sha256", "path").unionByName(new.select("sha256", "path"))


def upsert(index: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    return index.join(rows, key, "left_anti").unionByName(rows.select(*index.columns))


def plan_totals(resources: DataFrame, *by: str) -> DataFrame:
    """Resources (bytes, cached): their number, estimated bytes, bytes still to fetch and cached ones. Unknown sizes count 0."""
    size = F.coalesce("bytes", F.lit(0))
    return resources.groupBy(*by).agg(F.count("*").alias("resources"), F.sum(size).alias("bytes_total"), F.sum(F.when(F.col("cached"), 0).otherwise(size)).alias("bytes_to_fetch"), F.count_if("cached").alias("cached"))


def run_totals(downloads: DataFrame, since: int = 0) -> DataFrame:
    """Of the downloads (seq, bytes, state) of a run: bytes transferred, reused and duplicate ones, problems."""
    s = F.col("state")
    return downloads.where(F.col("seq") >= since).agg(
        F.count("*").alias("downloads"), F.coalesce(F.sum(F.when(F.startswith(s, F.lit("downloaded")), F.coalesce("bytes", F.lit(0)))), F.lit(0)).alias("bytes_transferred"),
        F.count_if(s == "reused").alias("reused"), F.count_if(F.endswith(s, F.lit("duplicate"))).alias("duplicates"), F.count_if(s == "failed").alias("failed"),
    )


def first_resource(plans: DataFrame) -> DataFrame:
    """(provider, method, resource): the first resource of each plan (provider, method, resources) that is read by window or asked of a service."""
    return plans.where(F.size("resources") > 0).select("provider", "method", F.get("resources", F.lit(0)).alias("resource"))


def unit_note(unit_km2: float, basin_km2: float | None) -> str | None:
    """What to say of a basin unit that drains far more than the basin."""
    return "the unit belongs to the receiving river" if basin_km2 and unit_km2 > 5 * basin_km2 else None


def numbered(sections: DataFrame) -> DataFrame:
    """Report sections (place, title, kept) that are kept, numbered from 1."""
    from pyspark.sql.window import Window as W

    return sections.where("kept").withColumn("number", F.row_number().over(W.orderBy("place")))  # the sections of one report


def manifest_json(request: dict, decisions: list[str], downloads: DataFrame, products: DataFrame, errors: DataFrame, generated: str, services: DataFrame | None = None) -> str:
    """The manifest of one project: its lists are what a project fetched and made, small by nature."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps({"tool": "talweg", "generated": generated, "input": request, "decisions": decisions, "downloads": rows(downloads), "products": rows(products), "errors": rows(errors)} | ({"services": rows(services)} if services is not None else {}), ensure_ascii=False, indent=2, default=str)


def manifest_csv(downloads: DataFrame) -> bytes:
    """The downloads as CSV with a header, in UTF-8 with a byte order mark."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(downloads.columns)
    w.writerows(downloads.collect())
    return (BOM + out.getvalue()).encode()


def report(name: str, sections: DataFrame, lines: DataFrame) -> str:
    """A Markdown report: kept sections in order, renumbered, with their lines (place of the section, seq, line)."""
    titles = {r["place"]: f"## {r['number']}. {r['title']}" for r in numbered(sections).collect()}
    body: dict[int, list[str]] = {}
    for r in lines.orderBy("place", "seq").collect():
        body.setdefault(r["place"], []).append(r["line"])
    return "\n".join([f"# {name}", *[x for p in sorted(titles) for x in ("", titles[p], "", *body.get(p, []))]]) + "\n"


def plan_text(resources: DataFrame) -> DataFrame:
    """A line per provider: resources, size to fetch and how many are cached."""
    t = plan_totals(resources, "provider")
    return t.select("provider", F.concat_ws("; ", F.concat(F.col("resources").cast("string"), F.lit(" resources")), text.size_label(F.col("bytes_to_fetch")), F.concat(F.col("cached").cast("string"), F.lit(" cached"))).alias("line"))
