"""Student's t by the incomplete beta function, curve fits by normal equations, and samples of an exact number of rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Terms of the continued fraction; some fifty are enough where it is used.
TERMS = 400


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    value = 0.0
    for k in range(TERMS, 0, -1):  # from the last term inwards
        m = k // 2
        top = -(a + m) * (a + b + m) if k % 2 else m * (b - m)
        value = top * x / ((a + k - 1) * (a + k)) / (1 + value)
    return front / (1 + value)


def t_tail(t: float, df: float) -> float:
    """P(|T| >= t): the two-sided p of a t value."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(df: int, level: float = 0.95) -> float:
    """The t value that |T| stays below with the given probability, by halving."""
    if df < 1:
        raise ValueError("at least one degree of freedom")
    low, high = 0.0, 1.0
    while t_tail(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > 1 - level else (low, mid)
        if high - low <= 1e-14 * high:
            break
    return (low + high) / 2


#: Rows up to which an interval takes its t value from a list; beyond them a series in 1 / df is right to ten digits.
LISTED = 60
_LISTS: dict[float, list[float]] = {}


def t_column(df: Column, level: float = 0.95) -> Column:
    """t_quantile of a column of degrees of freedom; null below one."""
    if level not in _LISTS:
        _LISTS[level] = [t_quantile(k, level) for k in range(1, LISTED + 1)]
    z = NormalDist().inv_cdf((1 + level) / 2)
    d = df.cast("double")
    terms = [
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = sum((F.lit(c) / F.pow(d, F.lit(float(k))) for k, c in enumerate(terms, 1)), F.lit(z))
    listed = F.element_at(F.array(*[F.lit(v) for v in _LISTS[level]]), df.cast("int"))
    return F.when((df >= 1) & (df <= LISTED), listed).when(df > LISTED, series)


def mean_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by..., n, mean, sd, low, high): the mean and its exact t interval; null for a single row."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, t_column(F.col("n") - 1, level) * F.col("sd") / F.sqrt("n"))
    return g.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def line_test(df: DataFrame, x: str, y: str) -> dict[str, float | int | None]:
    """Slope, intercept, r2, their standard errors and the slope's two-sided p, from one aggregated row; null where rows are too few."""
    r = df.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mean"),
    ).first().asDict()
    out = {k: r[k] for k in ("n", "slope", "intercept", "r2")} | {"slope_error": None, "intercept_error": None, "p": None}
    if r["n"] > 2 and r["sxx"] and r["slope"] is not None:
        rest = max(0.0, (1 - r["r2"]) * r["syy"]) / (r["n"] - 2)
        out["slope_error"] = math.sqrt(rest / r["sxx"])
        out["intercept_error"] = math.sqrt(rest * (1 / r["n"] + r["mean"] ** 2 / r["sxx"]))
        out["p"] = t_tail(abs(r["slope"] / out["slope_error"]), r["n"] - 2) if out["slope_error"] else 0.0
    return out


def quadratic_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, c, r2, n) of y = a x^2 + b x + c by least squares. One pass centres x on its mean and scales it by its deviation, which keeps the normal
    equations well conditioned; a second sums their terms; the three unknowns follow by elimination. Null below three different x."""
    by = by or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    at = both.groupBy(*by).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.avg("_y").alias("_my"))
    if by:
        keyed = at.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], "_m", "_s", "_my")
        same = [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)]
        both = both.join(keyed, same).drop(*[f"_by{i}" for i in range(len(by))])
    else:
        one = at.agg(F.first(F.struct("_m", "_s", "_my")).alias("_at")).scalar()
        both = both.withColumn("_at", one).select("_x", "_y", "_at.*")
    u, v = (F.col("_x") - F.col("_m")) / F.col("_s"), F.col("_y") - F.col("_my")
    rows = both.where("_s > 0").select(*by, u.alias("u"), v.alias("v"), "_m", "_s", "_my")
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("u") ** 3).alias("u3"), F.avg(F.col("u") ** 4).alias("u4"), F.avg(F.col("u") * F.col("v")).alias("uv"),
        F.avg(F.col("u") ** 2 * F.col("v")).alias("uuv"), F.avg(F.col("v") ** 2).alias("vv"), F.first("_m").alias("m"), F.first("_s").alias("s"), F.first("_my").alias("my"),
    )
    # with mean u = 0 and mean u^2 = 1 the equations are q u4 + l u3 + k = uuv, q u3 + l = uv, q + k = 0
    den = F.col("u4") - 1 - F.col("u3") * F.col("u3")
    q = F.when(den > 1e-9, (F.col("uuv") - F.col("u3") * F.col("uv")) / den)
    g = g.withColumn("q", q).withColumn("l", F.col("uv") - F.col("q") * F.col("u3"))
    left = F.col("vv") - F.col("q") * F.col("uuv") - F.col("l") * F.col("uv")
    m, s = F.col("m"), F.col("s")
    a, b = F.col("q") / (s * s), F.col("l") / s - 2 * F.col("q") * m / (s * s)
    c = F.col("my") - F.col("q") + F.col("q") * m * m / (s * s) - F.col("l") * m / s
    return g.select(*by, a.alias("a"), b.alias("b"), c.alias("c"), F.when(F.col("vv") > 0, 1 - left / F.col("vv")).otherwise(0.0).alias("r2"), F.col("n").cast("long").alias("n"))


def exact_sample(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Exactly n rows, or all if there are fewer, of the table or of each group: those with the smallest hashes of their values (or of columns that tell rows
    apart), ties by these values. The same on each run and for any partitioning. Each task keeps its n best, so n rows a task meet; for groups n rows
    of each of 32 parts do."""
    key = columns or df.columns
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key], F.lit(str(seed))))
    hashed = df.withColumn("_order", text)
    order = ["_order", *[F.col(c) for c in key]]
    if not by:
        return hashed.orderBy(*order).limit(n).drop("_order")
    part = F.pmod(F.xxhash64("_order"), F.lit(32))
    few = hashed.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_at") <= n)
    best = few.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= n)
    return best.drop("_order", "_part", "_at")


def random_object(df: DataFrame, group: str | None = None, seed: int = 42, n: int = 1) -> DataFrame:
    """n existing objects, of a group or of any, as anchors of queries: each object is as likely as any other."""
    own = df if group is None else df.where(F.col("group_id") == group)
    return exact_sample(own, n, seed, columns=["object_id"] if "object_id" in df.columns else None)
