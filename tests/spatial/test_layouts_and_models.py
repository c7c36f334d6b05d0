import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregate, layout, select
from tessella.plans import learned, models, ranges, workload
from tessella.plans import queries as Q
from tessella.sources import readers
from tessella.streaming import monitor


@pytest.fixture(scope="module")
def objects(spark, small):
    return Q.keyed(Q.events(spark, small), Q.EVENTS).cache()


@pytest.mark.parametrize("name", list(layout.LAYOUTS))
def test_every_layout_gives_the_same_answer(spark, objects, tmp_path, name):
    path = str(tmp_path / name)
    layout.write(objects, path, name, files=4, buckets=Q.BUCKETS)
    stored = spark.read.parquet(path)
    want = {r["object_id"] for r in select.viewport(objects, Q.RECT, "g0").collect()}
    if name == "two_level":
        got = select.viewport_pruned(stored, Q.EVENTS, Q.RECT, "g0", buckets=Q.BUCKETS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "h_key" in plan.split("PushedFilters: [")[1].split("]")[0]
    else:
        got = select.viewport(stored, Q.RECT, "g0")
    assert {r["object_id"] for r in got.collect()} == want


def test_split_and_update_touch_one_folder(spark, objects, tmp_path):
    path = str(tmp_path / "t")
    layout.write(objects, path, "two_level", files=2)
    before = {r["object_id"]: r["class_label"] for r in spark.read.parquet(path).collect()}
    one = spark.read.parquet(path).where("group_id = 'g0'").orderBy("object_id").first()
    change = spark.createDataFrame([("g0", one["bucket"], one["object_id"], "view")], "group_id string, bucket int, object_id long, class_label string")
    layout.update_classes(spark, path, change, {"view": 2})
    spark.catalog.refreshByPath(path)
    after = {r["object_id"]: (r["class_label"], r["c_key"] >> 48) for r in spark.read.parquet(path).collect()}
    assert after[one["object_id"]] == ("view", 2) and {k: v for k, (v, _) in after.items() if k != one["object_id"]} == {k: v for k, v in before.items() if k != one["object_id"]}
    layout.split_bucket(spark, path, "g1", 0, 31, 0, 1 << 16)
    spark.catalog.refreshByPath(path)
    parts = {r["bucket"]: (r["lo"], r["hi"]) for r in spark.read.parquet(path).where("group_id = 'g1' AND bucket IN (0, 31)").groupBy("bucket").agg(F.min("h_key").alias("lo"), F.max("h_key").alias("hi")).collect()}
    assert all(hi < 1 << 15 for b, (_, hi) in parts.items() if b == 0) and all(lo >= 1 << 15 for b, (lo, _) in parts.items() if b == 31)


def test_models():
    assert models.expected_buckets(0.05, 100) == pytest.approx(5 + 2 * 5**0.5)
    assert models.expected_buckets(1.0, 10) == 10 and models.pruning_rate(1.0, 10) == 0
    assert models.density_constant(None) == 2.03 and models.density_constant(1.0) == 2.25
    assert models.false_positive_bound(0.25, 8) == pytest.approx(4 / 128)
    t = models.best_target(1_260_000, 0.05)
    assert all(models.bucket_cost(t, 1_260_000, 0.05) <= models.bucket_cost(t * k, 1_260_000, 0.05) + 1e-6 for k in (0.5, 0.9, 1.1, 2))
    counts = {"a": 1_000_000, "b": 10_000, "c": 500_000}
    for f in (models.allocate_uniform, models.allocate_proportional, models.allocate):
        plan = f(counts, 30)
        assert min(plan.values()) >= 1 and sum(plan.values()) <= 30
        with pytest.raises(ValueError):
            f(counts, 2)
    assert models.allocate(counts, 30)["a"] > models.allocate(counts, 30)["b"]
    assert models.choose_layout(10**6, 10, 1000) == "two_level" and models.choose_layout(10**6, 10, 5) == "mono_clustered"


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('AreaInPixels,PhysicalSize,Polygon\n10,2,"0:0:2:0:2:2:0:2"\n\n5,1\n7,1,1:x:3:5:bad:1\n9,1,1:2\n')
    rows = readers.polygons_csv(spark, str(tmp_path / "p.csv"), "g").collect()
    assert sorted((r["area"], r["x"], r["y"]) for r in rows) == [(7.0, 3.0, 5.0), (10.0, 1.0, 1.0)]
    (tmp_path / "s.csv").write_text("source_id,ra,dec,phot_g_mean_mag,bp_rp\n1,10.5,-3,12,0.5\n2,x,1,2,3\n3,1,1,9,\n4,1,1,9,10\n")
    assert {(r["object_id"], r["class_label"]) for r in readers.stars_csv(spark, str(tmp_path / "s.csv")).collect()} == {(1, "F"), (3, "Unknown"), (4, "Unknown")}
    (tmp_path / "m.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 2.0, "lon": 3.0, "tags": {"shop": "bakery"}}, {"type": "way", "id": 2, "center": {"lat": 1.0, "lon": 1.5}, "tags": {"amenity": "bar"}}, {"id": 1, "lat": 2.0, "lon": 3.0, "tags": {"shop": "bakery"}}, {"id": 3, "tags": {"shop": "x"}}]}')
    assert {(r["object_id"], r["x"], r["class_label"]) for r in readers.map_elements(spark, str(tmp_path / "m.json"), ["amenity", "shop"]).collect()} == {(1, 3.0, "shop:bakery"), (2, 1.5, "amenity:bar")}
    assert len(readers.box_tiles(0, 0, 1, 1, 3)) == 9


def test_monitor(spark):
    log = spark.createDataFrame([("g", b, 600.0) for b in [1] * 100 + [2] * 2 + [3] * 3 + [5]], "group_id string, bucket int, ms double")
    hits = monitor.bucket_hits(log)
    assert [r["bucket"] for r in monitor.hot(hits, 1).collect()] == [1] and [r["bucket"] for r in monitor.slow(hits).collect()] == [1]
    sizes = spark.createDataFrame([("g", b) for b in [1] * 16 + [2] * 3], "group_id string, bucket int")
    assert {(r["bucket"], r["advice"]) for r in monitor.advice(sizes, hits, 10).collect()} >= {(1, "split")}


def test_monitor_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'g' AS group_id, 1 AS bucket, 5.0D AS ms UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'g', 1, 7.0D").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, group_id string, bucket int, ms double").parquet(str(tmp_path / "log"))
    q = monitor.hits_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == 2


def test_append_and_repeated_updates(spark, objects, tmp_path, small):
    path = str(tmp_path / "t")
    layout.write(objects, path, "two_level", files=2)
    before = {r["object_id"]: r["class_label"] for r in spark.read.parquet(path).collect()}
    enum = Q.enum_of(objects)
    more = spark.createDataFrame([(-1, "g0", 5.0, 5.0, "click", 1.0), (-2, "g9", float("nan"), 5.0, "click", 1.0), (-3, "g9", 9e9, 5.0, "strange", 1.0)], "object_id long, group_id string, x double, y double, class_label string, area double")
    layout.append(more, path, "two_level", Q.EVENTS, enum, Q.BUCKETS)
    rows = {r["object_id"]: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == set(before) | {-1, -3} and rows[-3]["c_key"] >> 48 == len(enum) and rows[-1]["bucket"] == 0
    one = rows[min(before)]
    changes = [(one["group_id"], one["bucket"], one["object_id"], c) for c in ("click", "view", "click")] + [("g0", 29, one["object_id"], "purchase"), ("nowhere", 1, 5, "view")]
    layout.update_classes(spark, path, spark.createDataFrame(changes, "group_id string, bucket int, object_id long, class_label string"), enum)
    after = [(r["object_id"], r["class_label"]) for r in spark.read.parquet(path).collect()]
    assert len(after) == len(rows) and dict(after) == {k: "view" if k == one["object_id"] else r["class_label"] for k, r in rows.items()}
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


def test_cumulative_counts_and_quantiles(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [("big" if rng.random() < 0.8 else None if rng.random() < 0.3 else "few", rng.choice([rng.random(), 0.5, float(rng.randrange(5))])) for _ in range(3000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    for cuts in (1, 7, 256):
        got = aggregate.cumulative(df, ["g"], "v", {}, cuts).collect()
        assert all(r["before"] == sum(x < r["v"] for x in by[r["g"]]) and r["n"] == by[r["g"]].count(r["v"]) and r["total"] == len(by[r["g"]]) for r in got)
        assert len(got) == sum(len(set(x)) for x in by.values())
    for r in aggregate.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.99, "c": 1.0}).collect():
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(by[r["g"]], [0.5, 0.99, 1.0]))
    assert {r["g"]: r["q"] for r in aggregate.index_percentile(df, ["g"], "v", 0.9).collect()} == {g: sorted(x)[min(int(len(x) * 0.9), len(x) - 1)] for g, x in by.items()}
    assert aggregate.quantiles(df.where("v > 100"), ["g"], "v", {"a": 0.5}).count() == 0
    assert aggregate.mann_whitney(df.withColumn("s", F.col("g") == "big").where("g IS NOT NULL"), "v", "s").first()["p"] <= 1


def test_learned_keys_and_staleness(spark, objects):
    model = learned.train(objects, 33)
    keyed = learned.with_learned_key(objects.select("object_id", "group_id", "x", "y"), model, class_code=F.lit(3))
    rows = keyed.collect()
    knots = {r["group_id"]: r for r in model.collect()}
    assert len(rows) == objects.count()
    for r in rows:
        assert abs(r["u"] - learned.transform(r["x"], knots[r["group_id"]]["xs"])) < 1e-12 and r["lc_key"] == (3 << 48) + r["l_key"]
    fresh = {r["group_id"]: r for r in learned.staleness(objects, model).collect()}
    moved = {r["group_id"]: r for r in learned.staleness(objects.withColumn("x", F.col("x") + 500_000), model).collect()}
    assert all(fresh[g]["ks_x"] < 0.1 < moved[g]["ks_x"] and fresh[g]["clipped"] < 0.02 < moved[g]["clipped"] for g in fresh)


def test_ids_do_not_hang_on_the_file_split(spark, tmp_path):
    rows = [(f"{-73.9 - k % 50 * 1e-3}", "40.7", 1) for k in range(200)]
    df = spark.createDataFrame(rows, "pickup_longitude string, pickup_latitude string, payment_type int")
    ids = []
    for parts in (1, 7):
        df.repartition(parts).write.parquet(str(tmp_path / str(parts)))
        ids.append(sorted(r["object_id"] for r in readers.trips_parquet(spark, str(tmp_path / str(parts))).collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 200


def test_workloads(spark):
    rng = random.Random(1)
    for _ in range(50):
        x0, y0, x1, y1 = workload.random_rect(Q.EMBED, 0.05, rng)
        assert Q.EMBED.x_origin <= x0 < x1 <= Q.EMBED.x_origin + 1 and abs((x1 - x0) * (y1 - y0) - 0.05) < 1e-12 and y0 < y1
    chosen = workload.query_classes({"a": 0.5, "b": 0.2, "c": 0.1, "d": 0.01, "e": 0.19})
    assert (chosen["A"].classes, chosen["B"].classes, chosen["C"].classes, chosen["D"].classes, chosen["F"].fraction) == (("c",), ("d",), ("c", "d"), ("a",), 0.01)
    assert len(workload.mixed(Q.EVENTS, 100)) == 100 and workload.mixed(Q.EVENTS, 5) == workload.mixed(Q.EVENTS, 5)
    shares = {r["class_label"]: r["n"] / 20_000 for r in workload.made(spark, 20_000, Q.EVENTS).groupBy("class_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(shares[c] - s) < 0.02 for c, s in workload.SHARES)


def test_capped_ranges_keep_the_widest_gaps():
    assert ranges.capped([(0, 1), (2, 3), (9, 10), (12, 13)], 2) == [(0, 3), (9, 13)] and ranges.capped([(0, 1), (5, 6)], 1) == [(0, 6)]
    fine, n = ranges.ranges_and_cells(Q.EVENTS, Q.WIDE, 10)
    coarse, m = ranges.ranges_and_cells(Q.EVENTS, Q.WIDE, cap=None)
    assert n > m == sum(b - a for a, b in coarse) and {k for a, b in ranges.ranges_and_cells(Q.EVENTS, Q.WIDE, 10, None)[0] for k in range(a, b)} <= {k for a, b in coarse for k in range(a, b)}


def test_results_are_written(spark, objects, tmp_path):
    few = objects.select("object_id", "x").orderBy("object_id").limit(10)
    for kind in ("json", "csv", "parquet"):
        aggregate.written(few, str(tmp_path / kind), kind)
        assert spark.read.options(header=True).format(kind).load(str(tmp_path / kind)).count() == 10
