"""Aggregations over objects and statistics over measurements, as partial and final aggregates."""

from __future__ import annotations

import math
import random
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.select import place_among
from tessella.operators.stats import t_column


def tile_class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tile_id", "class_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tile_id", "class_label")


def tile_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tile_id")


def class_area_stats(df: DataFrame, value: str = "area") -> DataFrame:
    """Per class: count, mean and sample deviation (null for one row)."""
    return df.groupBy("class_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("avg_area"), F.round(F.stddev_samp(value), 6).alias("sd_area")
    )


def class_share(df: DataFrame) -> DataFrame:
    """Per class its count and percentage, one decimal, half up; from integers, so that no binary fraction tips a tie. The
    window runs over one row per class."""
    counts = df.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"))
    tenths = F.expr("(2000 * n + sum(n) OVER ()) div (2 * sum(n) OVER ())")
    return counts.select("class_label", "n", (tenths / 10).alias("pct"))


def extent(df: DataFrame) -> DataFrame:
    """Per group: count and bounding box."""
    return df.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )


def padded_dims(df: DataFrame, factor: float = 1.05) -> DataFrame:
    """Per group the largest coordinates, widened; where a catalog has no size for a group."""
    return df.groupBy("group_id").agg((F.max("x") * factor).alias("width"), (F.max("y") * factor).alias("height"))


def density_stats(df: DataFrame, tile: float = 256.0) -> DataFrame:
    """Per group over its occupied tiles: number, mean, population deviation, largest and smallest count, objects per million square units."""
    tiles = df.groupBy("group_id", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.count(F.lit(1)).alias("n"))
    return tiles.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.stddev_pop("n"), 6).alias("sd_n"),
        F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.round(F.sum("n") * 1e6 / (F.count(F.lit(1)) * tile * tile), 6).alias("per_million"),
    )


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns, nulls equal too."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def cumulative(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], cuts: int = 256) -> DataFrame:
    """(by..., v, n, sums..., before, total): per distinct value of a group its rows, the group's rows below it and all its rows.

    Equal values are counted before any sort. The values are cut at about cuts quantiles of all of them, so even a group
    with most rows is sorted in many tasks; running sums over a group's at most cuts + 1 ranges join the running sums inside each range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()])
    points = counts.agg(F.percentile_approx("v", [k / cuts for k in range(1, cuts)], 10_000)).first()[0]
    ranged = counts.withColumn("_range", F.expr(place_among(sorted({p for p in points or [] if math.isfinite(p)}), "v")))
    here = [f"_by{k}" for k in range(len(by))]
    below = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(*[F.col(c).alias(h) for c, h in zip(by, here, strict=True)], F.col("_range").alias("_at")).agg(F.sum("n").alias("_n"))
    starts = starts.select(*here, "_at", below("_n", Window.partitionBy(*here).orderBy("_at")).alias("_start"), F.sum("_n").over(Window.partitionBy(*here)).alias("total"))
    inside = ranged.withColumn("_in", below("n", Window.partitionBy(*by, "_range").orderBy("v")))
    met = inside.join(starts, same([*by, "_range"], [*here, "_at"]))
    return met.select(*by, "v", "n", *sums, (F.col("_start") + F.col("_in")).alias("before"), "total")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], linear: bool = True) -> DataFrame:
    """(by..., a column per share): exact quantiles, linear between neighbours, or the value at place int(n * p), from 0.
    No task holds a group's values: they are read off the cumulative counts."""
    c = cumulative(df, by, value, {})
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))

    def one(p: float) -> Column:
        if not linear:
            return at(F.least(F.floor(F.col("total") * p), F.col("total") - 1))
        place = (F.col("total") - 1) * F.lit(float(p))
        rest = F.max(place - F.floor(place))
        return at(F.floor(place)) * (1 - rest) + at(F.ceil(place)) * rest

    return c.groupBy(*by).agg(*[one(p).alias(k) for k, p in shares.items()])


def latency_stats(df: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """Per key: count, mean, sample deviation, cv, exact linear percentiles, extremes and the 95 % t interval of the mean."""
    shown = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    there = [f"_q{k}" for k in range(len(by))]
    q = quantiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).toDF(*there, "p50", "p95", "p99")
    out = shown.join(q, same(by, there), "left").drop(*there)
    half = F.when(F.col("n") > 1, t_column(F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    return out.withColumns({"cv": F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def index_percentile(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The other rule in use: the value at place int(n * p) of the sorted values, from 0."""
    return quantiles(df, by, value, {"q": p}, linear=False)


def ks_uniform(df: DataFrame, value: str, by: str = "group_id") -> DataFrame:
    """Per key the largest gap between the empirical distribution of value and the uniform one on [0, 1]."""
    c = cumulative(df, [by], value, {})
    gap = F.greatest((F.col("before") + F.col("n")) / F.col("total") - F.col("v"), F.col("v") - F.col("before") / F.col("total"))
    return c.groupBy(by).agg(F.max(gap).alias("ks"))


def mann_whitney(df: DataFrame, value: str, side: str) -> DataFrame:
    """One row: U of the side's rows against the others and the two-sided p by the normal approximation with tie correction (the normal
    tail by a rational function, within 1e-7). Ranks come from cumulative counts per distinct value, so no task sorts all rows."""
    ranked = cumulative(df, [], value, {"a": F.count_if(F.col(side))}).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    t = ranked.agg(F.sum("a").cast("double").alias("na"), F.sum("n").cast("double").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"))
    nb = F.col("n") - F.col("na")
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    var = F.col("na") * nb / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    t = t.select(u.alias("u"), ((u - F.col("na") * nb / 2) / F.sqrt(var)).alias("z"))
    k = 1 / (1 + 0.2316419 * F.abs("z"))
    tail = reduce(lambda a, c: (a + c) * k, [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530], F.lit(0.0))
    return t.withColumn("p", F.least(F.lit(1.0), 2 * tail * F.exp(-F.col("z") * F.col("z") / 2) / math.sqrt(2 * math.pi)))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r2, and the slope through the origin."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope_origin"),
    )


def errors(df: DataFrame, seen: str, said: str) -> DataFrame:
    """Mean absolute and root mean square error and R2 of a model's column against the measured one."""
    d = F.col(seen) - F.col(said)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (1 - F.sum(d * d) / (F.var_pop(seen) * F.count(seen))).alias("r2"))


def bootstrap_ci(values: list[float], rounds: int = 10_000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """A percentile interval of the mean of a few measurements on the driver."""
    draw = random.Random(seed)
    means = sorted(math.fsum(draw.choices(values, k=len(values))) / len(values) for _ in range(rounds))
    cut = (1 - level) / 2
    return means[int(cut * (rounds - 1))], means[int((1 - cut) * (rounds - 1))]


def normal_p(z: float) -> float:
    return 2 * (1 - NormalDist().cdf(abs(z)))


def representative_groups(df: DataFrame) -> DataFrame:
    """The largest, upper quartile, median and smallest group by count, ties by name; the window runs over one row per group."""
    counts = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), "group_id")
    ranked = counts.select("group_id", "n", F.row_number().over(w).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))
    place = F.create_map(F.lit("largest"), F.lit(1), F.lit("upper_quartile"), F.expr("of div 4 + 1"), F.lit("median"), F.expr("of div 2 + 1"), F.lit("smallest"), F.col("of"))
    named = ranked.select("group_id", "n", "at", F.explode(place).alias("role", "want"))
    return named.where("at = want").select("role", "group_id", "n")


def stride_sample(df: DataFrame, k: int) -> DataFrame:
    """k groups spread over the order of size: each (number // k)-th by falling count, ties by name."""
    counts = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.select("group_id", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "group_id")) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))
    return ranked.where(F.expr(f"at % greatest(1, of div {k}) = 0 AND at div greatest(1, of div {k}) < {k}")).select("group_id", "n")


def stable_sample(df: DataFrame, share: float, key: str = "object_id", seed: int = 0) -> DataFrame:
    """About a share of the rows, chosen by a multiplicative hash of an integer key: the same rows on each run and any cluster."""
    return df.where(F.pmod((F.col(key) + seed) % 2_147_483_648 * 2_654_435_761, F.lit(4_294_967_296)) < int(share * 4_294_967_296))


def written(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON lines, CSV with a header, or Parquet, by as many tasks as the result has."""
    df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)
