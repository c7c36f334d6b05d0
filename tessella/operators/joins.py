"""Spatial joins on grid cells: equi-joins on cell numbers with an exact residual, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def range_join(points: DataFrame, rects: DataFrame, size: float) -> DataFrame:
    """(object_id, rect_id) of points (object_id, x, y) in closed rectangles (rect_id, x0, y0, x1, y1). Rectangles are dealt
    to the cells they touch; a size near their usual side keeps that small. AQE splits cells with many points."""
    span = lambda a, b: F.sequence(_cell(F.col(a), size), _cell(F.col(b), size))
    cells = rects.where("x0 <= x1 AND y0 <= y1").withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    own = points.select("object_id", "x", "y", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
    met = own.join(cells, ["cx", "cy"])
    return met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("object_id", "rect_id")


def distance_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left_id, right_id, dist) of pairs at most radius apart; the right side is dealt to the nine cells around each point."""
    near = F.explode(F.expr("flatten(transform(array(-1L, 0L, 1L), a -> transform(array(-1L, 0L, 1L), b -> struct(a, b))))"))
    a = left.select(F.col("object_id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    b = right.select(F.col("object_id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), near.alias("d"))
    b = b.select("right_id", "bx", "by", (_cell(F.col("bx"), radius) + F.col("d.a")).alias("cx"), (_cell(F.col("by"), radius) + F.col("d.b")).alias("cy"))
    dist = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return a.join(b, ["cx", "cy"]).select("left_id", "right_id", dist.alias("dist")).where(F.col("dist") <= radius)


def nearest_seed(df: DataFrame, seeds: list[tuple[float, float]]) -> DataFrame:
    """df with seed, the index of the nearest of a few seeds, ties to the lowest; an expression, not a join."""
    pairs = F.array(*[F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(seeds)])
    return df.withColumn("seed", F.array_min(pairs)["i"])


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """df with value from a dimension table, or the default; Spark broadcasts the side if its measured size allows. Of several
    values of a key the least counts, so no row is repeated."""
    one = dimension.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def last_changes(changes: DataFrame, by: list[str], value: str, version: str | None = None) -> DataFrame:
    """(by..., value): one change of each key, that of the highest version, of equal versions or without any the greatest value."""
    best = F.max(F.struct(*([version] if version else []), value))
    return changes.groupBy(*by).agg(best.alias("_best")).select(*by, F.col(f"_best.{value}").alias(value))


def updated(df: DataFrame, changes: DataFrame, key: str, value: str, version: str | None = None) -> DataFrame:
    """df with value replaced where changes has the key, by null too; repeated changes do not repeat rows, see last_changes."""
    new = last_changes(changes, [key], value, version)
    of, to, found = (fresh(df, c) for c in ("_of", "_to", "_found"))
    new = new.select(F.col(key).alias(of), F.col(value).alias(to), F.lit(True).alias(found))
    met = df.join(new, df[key] == new[of], "left")
    return met.withColumn(value, F.when(F.col(found), F.col(to)).otherwise(F.col(value))).drop(of, to, found)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
