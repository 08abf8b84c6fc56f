"""Requests as a stream: the reference computes none, this is an extension.

`aoi_stream` applies the stateless area and tile operators to a stream of requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import tiles


def aoi_stream(requests: DataFrame, catalogue: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Tile selection of each request of a stream (x, y, epsg, head_x, head_y, area_km2); the catalogue is a static table."""
    return tiles.select(tiles.to_lonlat(tiles.preliminary_aoi(requests)), catalogue, key)
