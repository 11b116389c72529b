"""Panels and network tables derived from the given tables, and parquet in and out."""
