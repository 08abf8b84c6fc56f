"""Column expressions: projections, plane geometry and text."""
