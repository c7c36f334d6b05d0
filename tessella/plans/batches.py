"""Many rectangles or points answered in one job: dealt to coarse cells of the curve, which are ranges of stored keys, and joined with the objects' keys."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import keys
from tessella.functions.curves import with_hilbert
from tessella.functions.grid import GridSpec
from tessella.sources.shared import stored

#: Order of the cells that rectangles are dealt to: 32 a side.
LEVEL = 5
#: The same where rectangles only count, and how many different places of a cell one task counts.
COUNT_LEVEL, PLACES = 3, 100_000
FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20)


def rect_cells(rects: DataFrame, spec: GridSpec, level: int = LEVEL) -> DataFrame:
    """rects (x0, y0, x1, y1, ...) with a row for each cell of order level that the closed rectangle touches: its number on the curve, which
    is what the keys of spec's order in it have in their upper bits. Rectangles with ends in the wrong order or null are left out."""
    if not 1 <= level <= spec.order:
        raise ValueError("level must be 1 to the order of the keys")
    down = spec.order - level
    (ax, ay), (bx, by) = spec.columns(F.col("x0"), F.col("y0")), spec.columns(F.col("x1"), F.col("y1"))
    span = lambda a, b: F.explode(F.sequence(F.shiftright(a, down), F.shiftright(b, down)))
    dealt = rects.where("x0 <= x1 AND y0 <= y1").withColumn("_cx", span(ax, bx)).withColumn("_cy", span(ay, by))
    return with_hilbert(dealt, F.col("_cx"), F.col("_cy"), level, "_cell").drop("_cx", "_cy")


def in_folders(df: DataFrame, cells: DataFrame, spec: GridSpec, level: int, buckets: int | None) -> DataFrame:
    """df without the folders of buckets that no cell meets, if the layout's number of buckets is known."""
    if buckets is None:
        return df
    shift = 2 * (spec.order - level)
    first, last = F.shiftleft(F.col("_cell"), shift), F.shiftleft(F.col("_cell") + 1, shift) - 1
    met = F.explode(F.sequence(keys.bucket_column(first, buckets, spec.order), keys.bucket_column(last, buckets, spec.order)))
    return df.where(F.col("bucket").isin([r[0] for r in cells.select("_cell").distinct().select(met.alias("bucket")).distinct().collect()]))  # as many as there are buckets


def viewport_batch(df: DataFrame, spec: GridSpec, rects: DataFrame, columns: Sequence[str] = ("object_id", "x", "y", "class_label"), level: int = LEVEL,
                   buckets: int | None = None) -> DataFrame:
    """(rect_id, columns...) of objects (x, y, h_key, ...) in each closed rectangle (rect_id, x0, y0, x1, y1). A group_id of the rectangles
    confines each to a group, a list classes, unless null, to classes. One equi-join on cells with an exact residual, so its work
    follows the objects in cells that are asked for. With the layout's number of buckets only folders of buckets that some cell meets are read."""
    cells = rect_cells(rects, spec, level)
    shift = 2 * (spec.order - level)
    by = ["_cell"] + (["group_id"] if "group_id" in rects.columns else [])
    df = in_folders(df, cells, spec, level, buckets)
    own = df.select(F.shiftright("h_key", shift).alias("_cell"), *dict.fromkeys([*by[1:], "x", "y", *(["class_label"] if "classes" in rects.columns else []), *columns]))
    met = own.join(cells.select("rect_id", "x0", "y0", "x1", "y1", *by, *(["classes"] if "classes" in rects.columns else [])), by)
    met = met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    if "classes" in rects.columns:
        met = met.where("classes IS NULL OR array_contains(classes, class_label)")
    return met.select("rect_id", *columns)


class Places:
    """Weights of places (x, y) summed over closed rectangles: a wavelet matrix of the ranks of y in the order of x, each sum a step for each bit of a rank."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.x, self.y = x[order], np.sort(y)
        rank, weight = np.searchsorted(self.y, y[order]), weight[order]
        self.bits = []  # of each bit, highest first: how many before each position have it not, and their weight
        for bit in range(len(x).bit_length() - 1, -1, -1):
            zero = rank >> bit & 1 == 0
            self.bits.append((bit, np.append(0, np.cumsum(zero)), np.append(0, np.cumsum(weight * zero))))
            parted = np.argsort(~zero, kind="stable")
            rank, weight = rank[parted], weight[parted]

    def below(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Weight of the places from position a up to b whose y has a lower rank."""
        total = np.zeros(len(a), np.int64)
        for bit, zeros, weights in self.bits:
            one = rank >> bit & 1 == 1
            za, zb = zeros[a], zeros[b]
            total += np.where(one, weights[b] - weights[a], 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        return total

    def within(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.x, x0), np.searchsorted(self.x, x1, "right")
        return self.below(a, b, np.searchsorted(self.y, y1, "right")) - self.below(a, b, np.searchsorted(self.y, y0))


def counted(df: DataFrame, spec: GridSpec, rects: DataFrame, parts: Sequence[str] = (), level: int = COUNT_LEVEL, buckets: int | None = None, places: int = PLACES) -> DataFrame:
    """(rect_id, parts..., n): the objects in each closed rectangle, as of viewport_batch, by their columns parts; where there are none, no row. No object is
    paired with a rectangle: a cell whose objects are all inside adds its number, one with none nothing, and in cells on a border, dealt to tasks of at most so many places,
    each rectangle takes a binary search. Work follows the cells that rectangles touch and, once, the objects. The join must not take the cells of the
    rectangles for as few as the rectangles, or it would send them all to the driver."""
    cells = rect_cells(rects, spec, level)
    by = ["_cell"] + (["group_id"] if "group_id" in rects.columns else [])
    asked = ["classes"] if "classes" in rects.columns else []
    split = list(dict.fromkeys([*by, *parts, *(["class_label"] if asked else [])]))
    own = in_folders(df, cells, spec, level, buckets).withColumn("_cell", F.shiftright("h_key", 2 * (spec.order - level)))
    points = own.where("_cell IS NOT NULL").groupBy(*split, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    sizes = points.groupBy(*split).agg(
        F.sum("_w").alias("n"), F.min("x").alias("_ax"), F.max("x").alias("_bx"), F.min("y").alias("_ay"), F.max("y").alias("_by"), F.ceil(F.count(F.lit(1)) / places).cast("int").alias("_deals")
    )
    met = cells.select("rect_id", "x0", "y0", "x1", "y1", *by, *asked).join(sizes.hint("shuffle_hash"), by).where("x0 <= _bx AND x1 >= _ax AND y0 <= _by AND y1 >= _ay")
    if asked:
        met = met.where("classes IS NULL OR array_contains(classes, class_label)")
    whole = "x0 <= _ax AND x1 >= _bx AND y0 <= _ay AND y1 >= _by"
    border = met.where(f"NOT ({whole})").select("rect_id", "x0", "y0", "x1", "y1", *split, F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"))
    known = sizes.select(*[F.col(c).alias(f"_of{k}") for k, c in enumerate(split)], "_deals")
    dealt = points.join(known, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate(split)]))
    dealt = dealt.select(*[F.col(c).alias(c) for c in split], F.pmod(F.xxhash64("x", "y"), "_deals").cast("int").alias("_deal"), "x", "y", "_w")

    def told(asked: pa.Table, have: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        n = np.zeros(len(asked), np.int64)
        if len(asked):
            n = Places(*[column(have, c) for c in ("x", "y", "_w")]).within(*[column(asked, c) for c in ("x0", "y0", "x1", "y1")])
        return asked.select(["rect_id", *parts]).append_column("n", pa.array(n)).filter(pa.array(n > 0))

    kind = ", ".join(f"`{c}` {border.schema[c].dataType.simpleString()}" for c in ("rect_id", *parts))
    found = border.groupBy(*split, "_deal").cogroup(dealt.groupBy(*split, "_deal")).applyInArrow(told, f"{kind}, n long")
    return met.where(whole).select("rect_id", *parts, "n").unionByName(found).groupBy("rect_id", *parts).agg(F.sum("n").alias("n"))


def rect_counts(df: DataFrame, spec: GridSpec, rects: DataFrame, level: int = COUNT_LEVEL, buckets: int | None = None) -> DataFrame:
    """rects with n, the number of objects in each: 0 where there are none."""
    n = counted(df, spec, rects, (), level, buckets)
    return rects.join(n, "rect_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def sweep_rects(anchors: DataFrame, spec: GridSpec, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """(rect_id, anchor_id, fraction, x0, y0, x1, y1): at each anchor (anchor_id, u, v: from 0 to 1) a rectangle for each fraction of the extent's area, of its
    shape and inside it."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(f)).alias("f"), F.lit(math.sqrt(f)).alias("side")) for k, f in enumerate(fractions)]))
    r = anchors.select("*", each.alias("_f"))
    x0 = F.lit(spec.x_origin) + F.col("u") * (spec.width * (1 - F.col("_f.side")))
    y0 = F.lit(spec.y_origin) + F.col("v") * (spec.height * (1 - F.col("_f.side")))
    kept = [c for c in anchors.columns if c not in ("u", "v", "anchor_id")]
    return r.select((F.col("anchor_id") * len(fractions) + F.col("_f.k")).alias("rect_id"), "anchor_id", F.col("_f.f").alias("fraction"), *kept,
                    x0.alias("x0"), y0.alias("y0"), (x0 + spec.width * F.col("_f.side")).alias("x1"), (y0 + spec.height * F.col("_f.side")).alias("y1"))


def knn_batch(df: DataFrame, spec: GridSpec, points: DataFrame, k: int, first: int = 1, level: int | None = None, buckets: int | None = None) -> DataFrame:
    """(point_id, object_id, dist): the k nearest objects of each point (point_id, px, py) inside the grid, ties by object_id. All points are
    answered by squares of cells in one join; those with fewer than k objects within the half side go on with squares of twice the side, and
    the last square is the whole grid. A point meets the objects of its square only; choose first so that most squares hold some 2 k."""
    level = min(spec.order, 8) if level is None else level
    left, radius, out = points.select("point_id", "px", "py"), first, None
    while True:
        whole = 2 * radius >= spec.n
        across, up = radius * spec.width / spec.n, radius * spec.height / spec.n
        if whole:  # not less than any distance inside the grid
            across, up = 2 * spec.width, 2 * spec.height
        rects = left.select(F.col("point_id").alias("rect_id"), (F.col("px") - across).alias("x0"), (F.col("py") - up).alias("y0"), (F.col("px") + across).alias("x1"), (F.col("py") + up).alias("y1"))
        near = viewport_batch(df, spec, rects, ("object_id", "x", "y"), min(level, max(1, spec.order - int(math.log2(radius)))), buckets)
        far = near.join(left, near["rect_id"] == left["point_id"]).withColumn("dist", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2))
        best = far.withColumn("_at", F.row_number().over(Window.partitionBy("point_id").orderBy("dist", "object_id"))).where(F.col("_at") <= k)
        if whole:
            some = best.select("point_id", "object_id", "dist")
            return some if out is None else out.unionByName(some)
        full = best.where((F.col("_at") == k) & (F.col("dist") <= min(across, up))).select("point_id")
        some = best.join(full, "point_id", "left_semi").select("point_id", "object_id", "dist")
        some = stored(some)
        out = some if out is None else out.unionByName(some)
        left = stored(left.join(full, "point_id", "left_anti"))  # else each round would repeat those before
        if left.isEmpty():
            return out
        radius *= 2
