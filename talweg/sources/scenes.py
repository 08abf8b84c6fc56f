"""Scene searches as a data source: a partition for each span of time, whose pages are followed in its task."""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from .http import AGENT

SCHEMA = "scene string, time string, scene_cloud double, ring array<struct<x:double,y:double>>, assets map<string,string>, error string"
Moment = datetime.datetime


def moment(value: str) -> Moment:
    """A point in time; one without a zone is taken as UTC."""
    t = Moment.fromisoformat(value)
    return t if t.tzinfo else t.replace(tzinfo=datetime.UTC)


def spans(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """The time from `start` up to but without `end` in spans of so many days, the last one shorter."""
    at, last, found = moment(start), moment(end), []
    while at < last:
        after = min(at + datetime.timedelta(days=days), last)
        found.append((at.isoformat(), after.isoformat()))
        at = after
    return found


def asked(request: dict, attempts: int, pause: float) -> dict:
    """The JSON answer to a page's request. What the server calls the client's fault fails at once, but for 429."""
    body = None if request["method"] == "GET" else json.dumps(request["body"]).encode()
    for attempt in range(1, attempts + 1):
        try:
            r = urllib.request.Request(request["href"], body, {"Content-Type": "application/json", "User-Agent": AGENT}, method=request["method"])
            with urllib.request.urlopen(r, timeout=60) as answer:
                return json.loads(answer.read())
        except (OSError, ValueError) as e:
            refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429
            if refused or attempt == attempts:
                raise
        time.sleep(pause * attempt)
    raise OSError("no attempt was made")


def following(answer: dict, request: dict) -> dict | None:
    """The request of the next page, or None after the last one."""
    link = next((x for x in answer.get("links") or [] if x.get("rel") == "next" and x.get("href")), None)
    if link is None:
        return None
    body = (request["body"] if link.get("merge") else {}) | (link.get("body") or {})
    return {"method": link.get("method", "GET").upper(), "href": link["href"], "body": body}


def row(feature: dict) -> tuple:
    """A scene; the outer ring of a polygon, null for other shapes."""
    facts, shape = feature.get("properties") or {}, feature.get("geometry") or {}
    ring = [{"x": float(p[0]), "y": float(p[1])} for p in shape["coordinates"][0]] if shape.get("type") == "Polygon" else None
    cloud = facts.get("eo:cloud_cover")
    assets = {k: v["href"] for k, v in (feature.get("assets") or {}).items() if v.get("href")}
    return feature["id"], facts.get("datetime"), None if cloud is None else float(cloud), ring, assets, None


class Span(InputPartition):
    def __init__(self, start: str | None, end: str | None) -> None:
        self.start, self.end = start, end


class SceneReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.query = options["url"], json.loads(options.get("query", "{}"))
        self.spans = json.loads(options.get("spans", "[]"))
        self.most = int(options["most"]) if "most" in options else None
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 3))

    def partitions(self) -> list[InputPartition]:
        return [Span(*s) for s in self.spans] or [Span(None, None)]

    def read(self, partition: Span) -> Iterator[tuple]:
        request = {"method": "POST", "href": self.url, "body": dict(self.query)}
        if partition.start:
            request["body"]["datetime"] = f"{partition.start}/{partition.end}"
        given, past = 0, []
        try:
            while request and (self.most is None or given < self.most):
                if request in past:
                    raise ValueError("a page that names an earlier one as its next")
                past.append(request)
                answer = asked(request, self.attempts, self.pause)
                for f in answer.get("features") or []:
                    found = row(f)
                    # Servers take the end of a span as part of it; here it belongs to the next one.
                    if partition.start and not (found[1] and moment(partition.start) <= moment(found[1]) < moment(partition.end)):
                        continue
                    if self.most is not None and given == self.most:
                        break
                    given += 1
                    yield found
                request = following(answer, request)
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield None, partition.start, None, None, None, f"{type(e).__name__}: {e}"


class SceneSource(DataSource):
    """spark.read.format("scenes").option("url", …).option("query", JSON): a row per scene, a failed search as a row with `error`.

    `spans`, a JSON list of [start, end] in ISO form, makes a partition of each, its end not part of it; scenes without a time
    are left out then. Without spans one task follows all pages. `most` ends each partition after so many scenes.
    """

    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(self.options)


def search(spark: SparkSession, url: str, query: dict, time_spans: list[tuple[str, str]] | None = None, most: int | None = None, attempts: int = 3, pause: float = 3.0) -> DataFrame:
    """(scene, time, scene_cloud, ring, assets, error): the scenes of a search. A query's own `datetime` gives way to spans."""
    ship(spark).dataSource.register(SceneSource)
    options = {"url": url, "query": json.dumps(query), "spans": json.dumps(time_spans or []), "attempts": attempts, "pause": pause}
    return spark.read.format("scenes").options(**options | ({"most": most} if most is not None else {})).load()
