"""Rectangles that count at more rows than pairs of objects and rectangles could be made for."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.grid import GridSpec
from tessella.operators import select
from tessella.plans import batches, scans, workload
from tessella.plans import queries as Q
from tessella.plans import studies  # noqa: F401 - adds its queries
from tessella.sources import shared

SPEC = GridSpec(100_000.0, 100_000.0)


@pytest.fixture(scope="module")
def crowded(spark, small, tmp_path_factory):
    """2,000 suppliers and 10,000 events: 10,000 rectangles, 1.9 million pairs, 940,000 cells of order 5."""
    d = str(tmp_path_factory.mktemp("crowded"))
    events, suppliers = spark.read.parquet(f"{small}/events.parquet"), spark.read.parquet(f"{small}/supplier.parquet")
    n, m = events.count(), suppliers.count()
    copies = lambda df, times: df.join(spark.range(times).withColumnRenamed("id", "_i"))
    copies(events, 10_000 // n).withColumn("event_id", F.col("event_id") + F.col("_i") * n).withColumn("user_id", F.col("user_id") + F.col("_i")).drop("_i").coalesce(1).write.parquet(f"{d}/events.parquet")
    copies(suppliers, 2_000 // m).withColumn("s_suppkey", (F.col("s_suppkey") + F.col("_i") * m).cast("long")).drop("_i").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return d


def most_rows(df) -> dict[str, int]:
    """The most rows that a join made and that were broadcast at once, by the metrics of the plan that ran."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    left, out = [run.executedPlan()], {"Join": 0, "BroadcastExchange": 0}
    while left:
        plan = left.pop()
        left += scans._below(plan)
        for kind in out:
            if kind in plan.getClass().getSimpleName() and plan.metrics().contains("numOutputRows"):
                out[kind] = max(out[kind], int(plan.metrics().apply("numOutputRows").value()))
    return out


@pytest.mark.parametrize("name", ["viewport_batch", "fraction_sweep", "buckets_met", "curve_constant", "curve_constant_interval", "density_fit", "group_constants", "model_validation"])
def test_neither_pairs_nor_cells_are_sent_or_made(spark, crowded, name):
    most = most_rows(Q.QUERIES[name](spark, crowded))
    assert most["BroadcastExchange"] <= 10_000 and 0 < most["Join"] <= 500_000


@pytest.mark.parametrize("places", [100_000, 7])
@pytest.mark.parametrize("level", [1, 4])
def test_counted_equals_pairs(spark, level, places):
    """Edges on objects, many objects at one place, objects outside the grid, without a class or a group; rectangles of classes, twice, the wrong way round, infinite."""
    made = workload.made(spark, 600, SPEC).select("object_id", F.round("x", -3).alias("x"), F.round("y", -3).alias("y"), "class_label")
    made = made.withColumn("x", F.expr("CASE WHEN object_id % 50 = 0 THEN x * 3 WHEN object_id % 3 = 0 THEN 40000 ELSE x END"))
    made = made.withColumn("class_label", F.expr("CASE WHEN object_id % 7 > 0 THEN class_label END")).withColumn("group_id", F.expr("CASE WHEN object_id % 11 > 0 THEN 'g0' END"))
    made = shared.stored(select.with_keys(made, SPEC, {}, 20))
    rects = [(k, "g0", None if k % 3 else ["Tumor"], 1e3 * (7 * k % 90), 1e3 * (13 * k % 80), 1e3 * (7 * k % 90 + 3 * k), 1e3 * (13 * k % 80 + 2 * k)) for k in range(30)]
    rects += [rects[4], (90, "g0", None, 9.0, 9.0, 1.0, 10.0), (91, "g0", None, float("-inf"), float("-inf"), float("inf"), float("inf")), (92, "none", None, 0.0, 0.0, 1e5, 1e5)]
    df = spark.createDataFrame(rects, "rect_id int, group_id string, classes array<string>, x0 double, y0 double, x1 double, y1 double")
    for asked, parts in ((df, ["bucket"]), (df.drop("classes"), ["class_label", "bucket"]), (df.drop("classes", "group_id"), [])):
        want = batches.viewport_batch(made, SPEC, asked, parts, level).groupBy("rect_id", *parts).count()
        got = batches.counted(made, SPEC, asked, parts, level, buckets=20, places=places)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.count() > 20
