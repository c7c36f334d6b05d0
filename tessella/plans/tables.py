"""The analytical models over a catalog of groups, as columns: a row for each group and parameter, so that many groups are advised in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.models import CALIBRATED, CURVE

ORDERS = (4, 6, 8, 10)
FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20)
TARGETS = (1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000)


def _each(values: Sequence, kind: str, name: str) -> Column:
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name)


def buckets(n: Column, target: Column) -> Column:
    return F.greatest(F.lit(1.0), F.floor(n / target).cast("double"))


def expected(fraction: Column, b: Column, c: float) -> Column:
    return F.least(fraction * b + c * F.sqrt(fraction * b), b)


def prediction_table(catalog: DataFrame, target: int = 50_000, orders: Sequence[int] = ORDERS, fractions: Sequence[float] = FRACTIONS, curve: str = "hilbert") -> DataFrame:
    """(group_id, order, fraction, buckets, expected, pruning, fp_bound) of catalog (group_id, n): buckets met by a rectangle and the share of them that is
    not read. The order bounds the cover's false positives and the number of buckets, which cannot be more than the cells; else the model does not depend on it."""
    g = catalog.select("group_id", "n", _each(orders, "int", "order")).select("*", _each(fractions, "double", "fraction"))
    b = F.least(buckets(F.col("n"), F.lit(target)), F.pow(F.lit(4.0), F.col("order").cast("double")))
    g = g.withColumn("buckets", b).withColumn("expected", expected(F.col("fraction"), F.col("buckets"), CURVE[curve]))
    bound = 4 / (F.sqrt("fraction") * F.pow(F.lit(2.0), F.col("order").cast("double")))
    return g.select("group_id", "order", "fraction", "buckets", "expected", (1 - F.col("expected") / F.col("buckets")).alias("pruning"), bound.alias("fp_bound"))


def least_order(catalog: DataFrame, target: int = 50_000, share: float = 0.25, fraction: float = 0.05) -> DataFrame:
    """(group_id, order): the least order whose cells are at least four times as many as the group's buckets, and whose cover of a rectangle has a
    share of false positives of at most share. The published cost does not depend on the order, so that its minimum tells nothing."""
    cells = F.ceil(F.log2(4 * buckets(F.col("n"), F.lit(target))) / 2)
    fine = math.ceil(math.log2(4 / (math.sqrt(fraction) * share)))
    return catalog.select("group_id", F.least(F.greatest(cells, F.lit(fine), F.lit(1)), F.lit(23)).cast("int").alias("order"))


def cost_surface(catalog: DataFrame, targets: Sequence[int] = TARGETS, fractions: Sequence[float] = FRACTIONS, alpha: float = 0.05, per_object: float = 2e-5, c: float = CALIBRATED) -> DataFrame:
    """(group_id, target, fraction, buckets, cost, slope): milliseconds of a rectangle at a bucket size, and their change per object of the size."""
    g = catalog.select("group_id", "n", _each(targets, "int", "target")).select("*", _each(fractions, "double", "fraction"))
    n, f, t = F.col("n").cast("double"), F.col("fraction"), F.col("target").cast("double")
    b = F.greatest(F.lit(1.0), n / t)
    met = expected(f, b, c)
    cost = alpha * met + per_object * met * n / b
    # where b = n / t and not all buckets are met, cost = (alpha + per_object t) (f n / t + c sqrt(f n / t))
    inner = (n > t) & (met < b)
    slope = per_object * met - (alpha + per_object * t) * (f * b + c / 2 * F.sqrt(f * b)) / t
    return g.select("group_id", "target", "fraction", b.alias("buckets"), cost.alias("cost"), F.when(inner, slope).alias("slope"))


def best_targets(surface: DataFrame) -> DataFrame:
    """(group_id, fraction, target, cost): the listed bucket size of least cost, of equal ones the largest."""
    best = F.min(F.struct("cost", (-F.col("target")).alias("minus")))
    return surface.groupBy("group_id", "fraction").agg(best.alias("b")).select("group_id", "fraction", (-F.col("b.minus")).alias("target"), F.col("b.cost").alias("cost"))


def layout_advice(catalog: DataFrame, ceiling: int, target: int = 50_000) -> DataFrame:
    """(groups, partitions, ceiling, layout) of a catalog: two levels if all groups' buckets fit under the ceiling, else one folder a group if the groups do, else none."""
    own = F.sum(F.greatest(F.lit(1), F.floor(F.col("n") / target)))
    a = catalog.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(own, F.lit(0)).cast("long").alias("partitions"))
    kind = F.when(F.col("partitions") <= ceiling, "two_level").when(F.col("groups") <= ceiling, "grouped_clustered").otherwise("mono_clustered")
    return a.select("groups", "partitions", F.lit(ceiling).alias("ceiling"), kind.alias("layout"))


def group_dims(df: DataFrame, catalog: DataFrame, factor: float = 1.05, default: float = 100_000.0) -> DataFrame:
    """(group_id, width, height, source) of every group of df or of the catalog (group_id, width, height): the catalog's sizes if they are positive, else the largest
    coordinates times a factor, else a default."""
    seen = df.groupBy("group_id").agg((F.max("x") * factor).alias("_w"), (F.max("y") * factor).alias("_h"))
    known = catalog.groupBy("group_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    met = seen.join(known, "group_id", "full")
    good = lambda a, b: (F.col(a) > 0) & (F.col(b) > 0)
    pick = lambda a, b, rest: F.when(good("width", "height"), F.col(a)).when(good("_w", "_h"), F.col(b)).otherwise(rest)
    return met.select("group_id", pick("width", "_w", default).alias("width"), pick("height", "_h", default).alias("height"), F.when(good("width", "height"), "catalog").when(good("_w", "_h"), "objects").otherwise("default").alias("source"))
