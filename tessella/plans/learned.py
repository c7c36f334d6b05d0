"""A curve over learned coordinates: each group's axes are mapped through their own distribution before the Hilbert key."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.curves import with_hilbert
from tessella.functions.grid import GridSpec
from tessella.functions.keys import composite
from tessella.operators.aggregate import ks_uniform
from tessella.plans.ranges import Ranges, key_ranges

KNOTS = 1025


def train(df: DataFrame, knots: int = KNOTS, accuracy: int = 10_000) -> DataFrame:
    """(group_id, xs, ys, n): quantiles of each axis, linearly interpolated, by summaries of bounded size. Ranges and keys use the same
    knots, so an approximate knot moves cells, not answers."""
    p = [i / (knots - 1) for i in range(knots)]
    return df.groupBy("group_id").agg(F.percentile_approx("x", p, accuracy).alias("xs"), F.percentile_approx("y", p, accuracy).alias("ys"), F.count(F.lit(1)).alias("n"))


def transform(v: float, knots: list[float]) -> float:
    """The share of the distribution below v, between knots linear, clamped; the operations are those of mapped(), so that no point falls beside its rectangle."""
    at = bisect_right(knots, v)
    if at == 0 or at == len(knots):
        return float(at > 0)
    return (at - 1 + (v - knots[at - 1]) / (knots[at] - knots[at - 1])) / (len(knots) - 1)


def mapped(v: Column, knots: Column, most: int = KNOTS) -> Column:
    """transform() of a column by an array column of at most most knots: the last knot that is not above v by halving steps, then the line to the next."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    n = F.size(knots)
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(knots, F.least(at + step, n) - 1) <= v), at + step).otherwise(at))
    # bound once as a lambda's variable, since four places refer to it
    low, high = lambda k: F.get(knots, k - 1), lambda k: F.get(knots, k)
    share = lambda k: F.when(k == 0, 0.0).when(k == n, 1.0).otherwise((k - 1 + (v - low(k)) / (high(k) - low(k))) / (n - 1))
    return F.element_at(F.transform(F.array(at), share), 1)


def with_learned_key(df: DataFrame, model: DataFrame, order: int = 8, out: str = "l_key", class_code: Column | None = None) -> DataFrame:
    """df with u, v (the mapped coordinates) and the key; rows of groups without a model are left out. Knots meet their group's rows by a join, whose side is a row
    for each group; all else is expressions. With a class code also lc_key, the composite learned key."""
    own = model.select(F.col("group_id").alias("_g"), F.col("xs").alias("_xs"), F.col("ys").alias("_ys"))
    met = df.join(own, F.col("group_id") == F.col("_g"))
    u, v = (F.when(F.col(axis).isNotNull(), mapped(F.col(axis).cast("double"), F.col(knots))) for axis, knots in (("x", "_xs"), ("y", "_ys")))
    met = met.select(*df.columns, u.alias("u"), v.alias("v"))
    cx, cy = GridSpec(1.0, 1.0, order).columns(F.col("u"), F.col("v"))
    keyed = with_hilbert(met, cx, cy, order, out)
    return keyed if class_code is None else keyed.withColumn("lc_key", composite(class_code, F.col(out)))


def learned_ranges(rect: tuple[float, float, float, float], xs: list[float], ys: list[float], order: int = 8, cap: int = 64) -> Ranges:
    """Key intervals that cover a rectangle: its corners are mapped, which keeps order on each axis."""
    return key_ranges(GridSpec(1.0, 1.0, order), (transform(rect[0], xs), transform(rect[1], ys), transform(rect[2], xs), transform(rect[3], ys)), cap=cap)


def staleness(df: DataFrame, model: DataFrame) -> DataFrame:
    """Per group the share of new points outside the learned range, and the largest gap (Kolmogorov-Smirnov) between each mapped
    axis and the uniform distribution that it had when the model was trained."""
    met = df.join(model.select("group_id", F.col("xs")[0].alias("x0"), F.element_at("xs", -1).alias("x1"), F.col("ys")[0].alias("y0"), F.element_at("ys", -1).alias("y1")), "group_id")
    outside = (F.col("x") < F.col("x0")) | (F.col("x") > F.col("x1")) | (F.col("y") < F.col("y0")) | (F.col("y") > F.col("y1"))
    clipped = met.groupBy("group_id").agg(F.round(F.avg(outside.cast("double")), 6).alias("clipped"))
    mapped = with_learned_key(df.select("group_id", "x", "y"), model)
    gaps = ks_uniform(mapped, "u").withColumnRenamed("ks", "ks_x").join(ks_uniform(mapped, "v").withColumnRenamed("ks", "ks_y"), "group_id")
    return clipped.join(gaps, "group_id")
