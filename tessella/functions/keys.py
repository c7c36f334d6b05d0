"""Buckets of curve keys, class codes and composite keys (class in the upper bits, curve key in the lower 48)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = (1 << 48) - 1


def bucket_count(n_objects: int, target: int = 50_000) -> int:
    return max(1, n_objects // target)


def bucket_of(key: int, buckets: int, order: int) -> int:
    return min(max(key * buckets // (1 << 2 * order), 0), buckets - 1)


def bucket_column(key: Column, buckets: Column | int, order: int) -> Column:
    b = F.lit(buckets).cast("long") if isinstance(buckets, int) else buckets.cast("long")
    exact = F.shiftright(key * b, 2 * order)  # keys are not negative, so the shift is the integer quotient
    return F.least(F.greatest(exact, F.lit(0)), b - 1).cast("int")


def bucket_interval(bucket: int, buckets: int, order: int, mode: str = "exact") -> tuple[int, int | None]:
    """[low, high) of a bucket. exact: the keys that bucket_of maps to it, with no gap or overlap for any number of buckets;
    floor_step and ceil_step: other published cuts; open: exact, but the last bucket has no end."""
    cells = 1 << 2 * order
    if mode == "floor_step":
        return bucket * cells // buckets, (bucket + 1) * cells // buckets
    if mode == "ceil_step":
        step = -(-cells // buckets)
        return bucket * step, (bucket + 1) * step + (bucket == buckets - 1)
    low, high = -(-bucket * cells // buckets), -(-(bucket + 1) * cells // buckets)
    return low, None if mode == "open" and bucket == buckets - 1 else high


def class_code(label: Column, classes: dict[str, int]) -> Column:
    """The code of a class; unknown classes share the code len(classes)."""
    code = F.lit(len(classes))
    for name, value in classes.items():
        code = F.when(label == name, F.lit(value)).otherwise(code)
    return code.cast("long")


def composite(code: Column, key: Column) -> Column:
    return F.shiftleft(code.cast("long"), 48).bitwiseOR(key.bitwiseAND(F.lit(LOW_BITS)))


def composite_code(key: Column) -> Column:
    return F.shiftright(key, 48).bitwiseAND(F.lit(0xFFFF))


def composite_low(key: Column) -> Column:
    return key.bitwiseAND(F.lit(LOW_BITS))


def class_enum(df: DataFrame, label: str = "class_label") -> DataFrame:
    """(class_label, n, code): codes by falling frequency, ties by label. The window runs over one row per class."""
    counts = df.groupBy(F.col(label).alias("class_label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", (F.row_number().over(Window.orderBy(F.desc("n"), "class_label")) - 1).cast("long"))
