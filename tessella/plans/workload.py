"""Workloads: random rectangles and points, classes of filtered queries, a mixed sequence of queries, and made objects."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.grid import GridSpec
from tessella.operators.labels import drawn
from tessella.plans.models import MIX

#: Class shares of made objects: fixed values.
SHARES = [("Epithelial", 0.425), ("Stromal", 0.297), ("Tumor", 0.164), ("Lymphocyte", 0.114)]


def random_rect(spec: GridSpec, fraction: float, rng: random.Random) -> tuple[float, float, float, float]:
    """A rectangle of a fraction of the extent's area and of its shape, anywhere inside."""
    w, h = spec.width * math.sqrt(fraction), spec.height * math.sqrt(fraction)
    x, y = spec.x_origin + rng.random() * (spec.width - w), spec.y_origin + rng.random() * (spec.height - h)
    return x, y, x + w, y + h


def random_point(spec: GridSpec, rng: random.Random) -> tuple[float, float]:
    return spec.x_origin + rng.random() * spec.width, spec.y_origin + rng.random() * spec.height


@dataclass(frozen=True)
class Filtered:
    """A rectangle query over some classes."""

    classes: tuple[str, ...]
    fraction: float


def query_classes(shares: dict[str, float]) -> dict[str, Filtered]:
    """The six kinds of filtered rectangles, chosen by the classes' shares: a rare class (A), a very rare one (B), both (C), a common one
    (D), the ten most frequent (E), and the rare one in a small rectangle (F). The bounds of the shares are fixed values."""
    if not shares:
        raise ValueError("no classes")
    names = sorted(shares, key=lambda c: (-shares[c], c))

    def most_frequent(low: float, high: float, otherwise: int) -> str:
        return next((c for c in names if low < shares[c] < high), names[min(otherwise, len(names) - 1)])

    rare, very_rare, common = most_frequent(0.02, 0.15, 5), most_frequent(0.005, 0.03, 10), most_frequent(0.15, math.inf, 0)
    return {
        "A": Filtered((rare,), 0.05), "B": Filtered((very_rare,), 0.05), "C": Filtered(tuple(dict.fromkeys((rare, very_rare))), 0.05),
        "D": Filtered((common,), 0.05), "E": Filtered(tuple(names[:10]), 0.05), "F": Filtered((rare,), 0.01),
    }


def mixed(spec: GridSpec, n: int, seed: int = 42, mix: dict[str, float] | None = None) -> list[tuple[str, tuple[float, ...]]]:
    """n queries (kind, rectangle or point), kinds drawn by their shares."""
    rng, mix = random.Random(seed), MIX if mix is None else mix
    kinds = rng.choices(list(mix), list(mix.values()), k=n)
    return [(k, random_point(spec, rng) if k == "knn" else random_rect(spec, 0.02 if k == "classes" else 0.05, rng)) for k in kinds]


def made(spark: SparkSession, n: int, spec: GridSpec, seed: int = 42, shares: list[tuple[str, float]] = SHARES) -> DataFrame:  # noqa: B006
    """n objects spread evenly, classes by their shares; a row depends on its number and the seed alone, not on the cluster."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 8 + k)), F.lit(1 << 40)) / float(1 << 40)
    return spark.range(n).select(
        F.col("id").alias("object_id"), F.lit("made").alias("group_id"), (F.lit(spec.x_origin) + u(1) * spec.width).alias("x"), (F.lit(spec.y_origin) + u(2) * spec.height).alias("y"),
        drawn(F.col("id"), shares, seed).alias("class_label"), (F.lit(10.0) + u(3) * 490.0).alias("area"),
    )
