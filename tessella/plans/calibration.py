"""Constants of the pruning model from measured trials, their intervals, and how density bears on them: a few aggregates over many trials.

A trial is a rectangle of an area fraction f over a group of B buckets that meets some of them. The model says f B + c sqrt(f B)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.grid import GridSpec
from tessella.plans.batches import COUNT_LEVEL, counted
from tessella.plans.models import CALIBRATED


def buckets_met(df: DataFrame, spec: GridSpec, rects: DataFrame, level: int = COUNT_LEVEL, buckets: int | None = None) -> DataFrame:
    """(rect_id, group_id, fraction, met, total, n): for each rectangle (rect_id, group_id, fraction, x0, y0, x1, y1) over its group's objects (bucket, h_key, ...)
    the buckets that hold objects in it, all the group's buckets, and the objects. Rectangles of groups without objects are left out."""
    each = counted(df, spec, rects, ("bucket",), level, buckets).groupBy("rect_id").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("n"))
    total = df.groupBy("group_id", "bucket").agg(F.lit(1)).groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))  # a row for each group
    met = rects.select("rect_id", "group_id", "fraction").join(F.broadcast(total), "group_id").join(each, "rect_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select("rect_id", "group_id", "fraction", zero("met"), "total", zero("n"))


def term() -> Column:
    """The border term of the model."""
    return F.sqrt(F.col("fraction") * F.col("total"))


def border() -> Column:
    """What is left of the buckets met once the rectangle's own share is taken off."""
    return F.col("met") - F.col("fraction") * F.col("total")


def _sums(weight: Column) -> list[Column]:
    t, y = term(), border()
    return [F.sum(weight * v).alias(k) for k, v in (("n", F.lit(1.0)), ("y", y), ("yy", y * y), ("t", t), ("ty", t * y), ("tt", t * t))]


def constant(trials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., c, r2, n, residual_mean, residual_sd): the least-squares constant through the origin, one pass. Without spread r2 is 0, without trials c is 2."""
    s = trials.groupBy(*(by or [])).agg(*_sums(F.lit(1.0)))
    c = F.when(F.col("tt") > 0, F.col("ty") / F.col("tt")).otherwise(2.0)
    s = s.withColumn("c", c)
    left = F.col("yy") - 2 * F.col("c") * F.col("ty") + F.col("c") ** 2 * F.col("tt")
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    mean = (F.col("y") - F.col("c") * F.col("t")) / F.col("n")
    return s.select(
        *(by or []), "c", F.when(spread > 1e-12, 1 - left / spread).otherwise(0.0).alias("r2"), F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), mean.alias("residual_mean"),
        F.sqrt(F.greatest(left / F.col("n") - mean * mean, F.lit(0.0))).alias("residual_sd"),
    )


#: Least uniform numbers, of 32 bits, for one to seven draws of a row: the distribution of Poisson(1).
POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(7)]


def drawn_times(key: Column, seed: int) -> Column:
    """How often a bootstrap round draws a row: Poisson(1) from a hash of the row's and round's key, the same on each run and any cluster."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))


def constant_interval(trials: DataFrame, rounds: int = 1_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(c, low, high, sd, rounds): a bootstrap interval of the constant. Every trial gets a weight in every round, and all rounds' sums are made in one pass
    with partial aggregates; what is sorted in the end is a number for each round."""
    at = F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    drawn = trials.select("rect_id", "met", "total", "fraction", at.alias("round")).withColumn("w", drawn_times(F.concat_ws(":", "rect_id", "round"), seed).cast("double"))
    s = drawn.where("w > 0").groupBy("round").agg(*_sums(F.col("w"))).where("tt > 0").select((F.col("ty") / F.col("tt")).alias("c"))
    cut = (1 - level) / 2
    return s.agg(F.avg("c").alias("c"), F.percentile("c", cut).alias("low"), F.percentile("c", 1 - cut).alias("high"), F.stddev_pop("c").alias("sd"), F.count(F.lit(1)).alias("rounds"))


def tile_cv(df: DataFrame, tile: float = 256.0) -> DataFrame:
    """(group_id, cv): population deviation over mean of the counts of occupied tiles."""
    tiles = df.groupBy("group_id", F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty")).agg(F.count(F.lit(1)).alias("n"))
    return tiles.groupBy("group_id").agg((F.stddev_pop("n") / F.avg("n")).alias("cv"))


def group_constants(trials: DataFrame, cv: DataFrame) -> DataFrame:
    """(group_id, cv, c, n): each group's mean constant, by solving each trial for it, beside the variation of its density."""
    own = trials.where("total > 0 AND fraction > 0").groupBy("group_id").agg(F.avg(border() / term()).alias("c"), F.count(F.lit(1)).alias("n"))
    return own.join(cv, "group_id").select("group_id", "cv", "c", "n")


def density_fit(groups: DataFrame) -> DataFrame:
    """(base, slope, r2, std_err, n) of c = base + slope cv over groups, and the slope's standard error; fewer than two groups, or one cv for all: the
    published constant and no slope."""
    n = F.count(F.lit(1))
    fit = groups.agg(F.regr_intercept("c", "cv").alias("base"), F.regr_slope("c", "cv").alias("slope"), F.regr_r2("c", "cv").alias("r2"), F.regr_sxx("c", "cv").alias("sxx"), F.regr_syy("c", "cv").alias("syy"), n.alias("n"))
    error = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(F.greatest((1 - F.col("r2")) * F.col("syy") / F.col("sxx") / (F.col("n") - 2), F.lit(0.0))))
    or_else = lambda c, v: F.when((F.col("n") > 1) & F.col(c).isNotNull(), F.col(c)).otherwise(v).alias(c)
    return fit.select(or_else("base", CALIBRATED), or_else("slope", 0.0), or_else("r2", 0.0), error.alias("std_err"), "n")


def density_weighted(df: DataFrame, fraction: float, c: float = CALIBRATED) -> DataFrame:
    """(group_id, buckets, n, cv, cost_ratio, expected, pruning): over the objects in each bucket. Pruning goes by area and does not depend on density; what a
    bucket costs once it is met does, by the mean of the squares over the square of the mean."""
    each = df.groupBy("group_id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = each.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("n").cast("long").alias("n"), (F.stddev_pop("n") / F.avg("n")).alias("cv"), (F.avg(F.col("n") * F.col("n")) / F.avg("n") / F.avg("n")).alias("cost_ratio")
    )
    share = F.col("buckets") * fraction
    g = g.withColumn("expected", F.least(share + c * F.sqrt(share), F.col("buckets").cast("double")))
    return g.withColumn("pruning", 1 - F.col("expected") / F.col("buckets"))


def validated(trials: DataFrame, c: float = CALIBRATED) -> DataFrame:
    """(group_id, fraction, trials, seen, said, pruning_seen, pruning_said): the model against the buckets that were met."""
    said = F.least(F.col("fraction") * F.col("total") + c * term(), F.col("total").cast("double"))
    g = trials.groupBy("group_id", "fraction").agg(F.count(F.lit(1)).alias("trials"), F.avg("met").alias("seen"), F.avg(said).alias("said"), F.avg(1 - F.col("met") / F.col("total")).alias("pruning_seen"), F.avg(1 - said / F.col("total")).alias("pruning_said"))
    return g
