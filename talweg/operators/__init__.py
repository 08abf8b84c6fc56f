"""Relational operators over points, tiles, cells, layers and provenance records."""
