"""Queries over objects: rectangles, neighbours, tiles, joins, statistics, labels and layouts."""
