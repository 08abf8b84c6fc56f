"""Watershed analytics on Spark: areas of interest, tiles, flow over elevation grids, thematic layers and provenance."""
