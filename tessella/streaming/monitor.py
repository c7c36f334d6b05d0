"""Query monitoring: hits and latencies per bucket, as a batch or as a stream of windows, and advice from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.aggregate import quantiles, same


def bucket_hits(log: DataFrame) -> DataFrame:
    """Per (group_id, bucket): hits and the exact median latency, read off cumulative counts. For streams see hits_by_window."""
    by = ["group_id", "bucket"]
    medians = quantiles(log, by, "ms", {"median_ms": 0.5}).toDF("_g", "_b", "median_ms")
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("hits")).join(medians, same(by, ["_g", "_b"]), "left").drop("_g", "_b")


def hits_by_window(log: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream's (window, group_id, bucket, hits, mean_ms); rows later than the watermark are let go."""
    windowed = log.withWatermark("ts", late).groupBy(F.window("ts", every), "group_id", "bucket")
    return windowed.agg(F.count(F.lit(1)).alias("hits"), F.avg("ms").alias("mean_ms")).select(F.col("window.start").alias("start"), "group_id", "bucket", "hits", "mean_ms")


def hot(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("hits"), "group_id", "bucket").limit(k)


def cold(hits: DataFrame, share: float = 0.1) -> DataFrame:
    """Buckets with less than a share of their group's mean hits."""
    return hits.withColumn("_m", F.avg("hits").over(Window.partitionBy("group_id"))).where(F.col("hits") < F.col("_m") * share).drop("_m")


def slow(hits: DataFrame, least: int = 5, ms: float = 500.0) -> DataFrame:
    return hits.where((F.col("hits") >= least) & (F.col("median_ms") > ms))


def advice(objects: DataFrame, hits: DataFrame, target: int, k: int = 10) -> DataFrame:
    """(group_id, bucket, advice): split those of the k hottest buckets that hold over 1.5 targets; merge a bucket with the next one if
    both are cold and neighbours."""
    sizes = objects.groupBy("group_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    warm = hot(hits, k).select("group_id", "bucket")
    split = sizes.where(F.col("n") > 1.5 * target).join(warm, ["group_id", "bucket"]).select("group_id", "bucket", F.lit("split").alias("advice"))
    few = cold(hits).select("group_id", "bucket")
    after = F.lead("bucket").over(Window.partitionBy("group_id").orderBy("bucket"))
    merge = few.withColumn("_next", after).where("_next = bucket + 1").select("group_id", "bucket", F.lit("merge").alias("advice"))
    return split.unionByName(merge)
