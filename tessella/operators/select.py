"""Rectangle and neighbour queries. Key ranges and buckets are access paths: the exact rectangle is always tested too,
unless a covering answer is asked for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import keys
from tessella.functions.grid import GridSpec
from tessella.plans import ranges as R

Rect = tuple[float, float, float, float]


def in_rect(rect: Rect, x: str = "x", y: str = "y") -> Column:
    """Closed on all sides."""
    return F.col(x).between(rect[0], rect[2]) & F.col(y).between(rect[1], rect[3])


def place_among(points: list[int] | list[float], name: str) -> str:
    """SQL for how many of the sorted points are at most the named value, by halving: as many comparisons as their number has bits.
    One text is parsed at once; a column expression of as many calls would take the driver seconds."""

    def half(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        point = f"{points[mid]}L" if isinstance(points[mid], int) else f"{points[mid]!r}D"
        return f"IF({name} < {point}, {half(low, mid)}, {half(mid + 1, high)})"

    return half(0, len(points))


def in_ranges(key: str, found: R.Ranges, stored: bool = True) -> Column:
    """In one of the half-open intervals; no interval, no row. For a stored key these are plain comparisons, which reach the
    Parquet scan; for one computed in the same query they refer to it once, as a filter's terms would each repeat it, and
    halve the intervals' ends: a key is inside if an odd number of ends is at most the key."""
    if not found:
        return F.lit(False)
    if stored:
        terms = " OR ".join(f"({key} >= {low}L AND {key} < {high}L)" for low, high in found)
        return F.expr(f"{key} >= {found[0][0]}L AND {key} < {found[-1][1]}L AND ({terms})")
    ends = [e for interval in found for e in interval]
    return F.expr(f"element_at(transform(array({key}), k -> {place_among(ends, 'k')} % 2 = 1), 1)")


def viewport(df: DataFrame, rect: Rect, group: str | None = None, classes: list[str] | None = None) -> DataFrame:
    """The plain form; without a group, over all."""
    out = df.where(in_rect(rect))
    out = out if group is None else out.where(F.col("group_id") == group)
    return out if classes is None else out.where(F.col("class_label").isin(classes))


def viewport_pruned(df: DataFrame, spec: GridSpec, rect: Rect, group: str | None = None, classes: list[str] | None = None, buckets: int | None = None,
                    curve: str = "hilbert", cap: int = R.CAP, stored: bool = True) -> DataFrame:
    """viewport with the ranges of the curve's key and, where the layout has buckets, their numbers (partition pruning)."""
    found = R.key_ranges(spec, rect, curve, cap)
    out = viewport(df, rect, group, classes).where(in_ranges("h_key" if curve == "hilbert" else "z_key", found, stored))
    return out if buckets is None else out.where(F.col("bucket").isin(R.buckets_of(found, buckets, spec.order)))


def covering(df: DataFrame, spec: GridSpec, rect: Rect, classes: list[str], enum: dict[str, int], group: str | None = None, exact: bool = True,
             order: int | None = None, cap: int = R.CAP, stored: bool = True) -> DataFrame:
    """By ranges of the composite key. exact=False returns the cover as it is, with points of the cells beyond the edges and
    with other classes of an unknown class's code."""
    codes = sorted({enum.get(c, len(enum)) for c in classes})
    found = R.composite_ranges(R.key_ranges(spec, rect, cap=cap, order=order), codes)
    out = df if group is None else df.where(F.col("group_id") == group)
    if exact:  # the plain tests first: keys that are not stored are then computed for few rows
        out = out.where(in_rect(rect) & F.col("class_label").isin(classes))
    return out.where(in_ranges("c_key", found, stored))


def false_positives(cover: DataFrame, rect: Rect) -> DataFrame:
    """One row: rows of a cover, rows outside the rectangle, and their share. Counted row by row in one pass."""
    outside = F.count_if(~in_rect(rect))
    n = F.count(F.lit(1))
    return cover.agg(n.alias("n_cover"), outside.alias("n_outside"), F.when(n > 0, F.round(outside / n, 6)).otherwise(0.0).alias("fp_rate"))


def distance(x: float, y: float, squared: bool = False) -> Column:
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return d if squared else F.sqrt(d)


def knn(df: DataFrame, x: float, y: float, k: int, group: str | None = None, squared: bool = False) -> DataFrame:
    """The k nearest, ties by object_id; each task keeps its k best, so k rows a task meet."""
    out = df if group is None else df.where(F.col("group_id") == group)
    name = "dist_sq" if squared else "dist"
    return out.select("object_id", distance(x, y, squared).alias(name)).orderBy(name, "object_id").limit(k)


def first_ring(spec: GridSpec, k: int, n: int) -> int:
    """The half side in cells of a square that would hold 2 k of n points spread evenly over the grid."""
    return max(1, math.ceil(math.sqrt(2 * k / max(n, 1)) * spec.n / 2))


def knn_rings(df: DataFrame, spec: GridSpec, x: float, y: float, k: int, group: str | None = None, first: int = 1, stored: bool = True, buckets: int | None = None) -> DataFrame:
    """knn over growing squares of cells, by key ranges and buckets: stops once k points lie within the square's half side; first_ring
    gives a first square that seldom needs a second. A point outside the grid is searched plainly, as its distance to clamped cells is not
    bounded by rings."""
    if not (spec.x_origin <= x <= spec.x_origin + spec.width and spec.y_origin <= y <= spec.y_origin + spec.height):
        return knn(df, x, y, k, group)
    radius = first
    while 2 * radius < spec.n:
        across, up = radius * spec.width / spec.n, radius * spec.height / spec.n
        near = viewport_pruned(df, spec, (x - across, y - up, x + across, y + up), group, buckets=buckets, stored=stored)
        if near.where(distance(x, y) <= min(across, up)).limit(k).count() == k:
            return knn(near, x, y, k)
        radius *= 2
    return knn(df, x, y, k, group)


def with_keys(df: DataFrame, spec: GridSpec, enum: dict[str, int], buckets: int = 1) -> DataFrame:
    """df (object_id, group_id, x, y, class_label, ...) with h_key, z_key, c_key, tile_id and bucket."""
    from tessella.functions import curves
    from tessella.functions.grid import tile_id

    cx, cy = spec.columns(F.col("x"), F.col("y"))
    out = curves.with_hilbert(df.withColumns({"_cx": cx, "_cy": cy}), F.col("_cx"), F.col("_cy"), spec.order)
    out = out.withColumn("z_key", curves.morton_column(F.col("_cx"), F.col("_cy"))).drop("_cx", "_cy")
    out = out.withColumn("c_key", keys.composite(keys.class_code(F.col("class_label"), enum), F.col("h_key")))
    return out.withColumns({"tile_id": tile_id(F.col("x"), F.col("y")), "bucket": keys.bucket_column(F.col("h_key"), buckets, spec.order)})
