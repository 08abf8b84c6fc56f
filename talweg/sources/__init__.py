"""Readers and writers: HTTP, archives, lists, grids and vector layers."""
