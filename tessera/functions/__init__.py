"""Column functions and column-wise helpers."""
