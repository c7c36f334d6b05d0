"""Class labels made from ids or places, and relabelling that keeps the curve part of composite keys."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import keys
from tessella.operators.joins import nearest_seed


def drawn(id: Column, shares: list[tuple[str, float]], seed: int = 42) -> Column:
    """A class by the hash of an id, with the given shares; the same for any order or number of rows."""
    u = F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    total = sum(s for _, s in shares)
    label = F.lit(shares[-1][0])
    for (name, _), end in reversed(list(zip(shares[:-1], accumulate(s / total for _, s in shares[:-1]), strict=True))):
        label = F.when(u < end, name).otherwise(label)
    return label


def quadrant(x_mid: float, y_mid: float, names: list[str]) -> Column:
    """The class of a quadrant: left-lower, right-lower, left-upper, right-upper."""
    right, upper = F.col("x") >= x_mid, F.col("y") >= y_mid
    return F.when(~right & ~upper, names[0]).when(right & ~upper, names[1]).when(~right & upper, names[2]).otherwise(names[3])


def voronoi(df: DataFrame, seeds: list[tuple[float, float]], names: list[str]) -> DataFrame:
    """Each row gets the class of its nearest seed, classes dealt to seeds in turn."""
    named = F.element_at(F.array(*[F.lit(names[i % len(names)]) for i in range(len(seeds))]), F.col("seed") + 1)
    return nearest_seed(df, seeds).withColumn("class_label", named).drop("seed")


def relabelled(df: DataFrame, label: Column, enum: dict[str, int]) -> DataFrame:
    """New classes, with the class bits of c_key replaced and its low 48 bits kept."""
    out = df.withColumn("class_label", label)
    return out.withColumn("c_key", keys.composite(keys.class_code(F.col("class_label"), enum), keys.composite_low(F.col("c_key"))))
