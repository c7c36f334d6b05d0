"""Spatial layout, curve keys and range queries over labelled 2-D points, on PySpark."""
