import math
import shutil

import pytest
from pyspark.sql import functions as F

from tessella.functions.grid import GridSpec
from tessella.operators import catalog, joins, layout, rebalance, select, stats
from tessella.plans import batches, calibration, clients, scans, studies, workload
from tessella.plans import queries as Q
from tessella.sources import shared

SPEC = GridSpec(100_000.0, 100_000.0)


@pytest.fixture(scope="module")
def made(spark):
    rows = workload.made(spark, 4_000, SPEC).withColumn("group_id", F.concat(F.lit("g"), F.col("object_id") % 3))
    return shared.stored(select.with_keys(rows, SPEC, {}, 20))


# --- many rectangles


@pytest.mark.parametrize("level", [1, 3, 8])
def test_batch_equals_each_rectangle(spark, made, level):
    """Edges on points and cells, outside the extent, of one point, the wrong way round, null, repeated."""
    p = made.first()
    rects = [
        (1, 0.0, 0.0, 50_000.0, 50_000.0), (2, p["x"], p["y"], p["x"], p["y"]), (3, -5e5, -5e5, 5e5, 5e5), (4, 9e5, 9e5, 1e6, 1e6), (5, 10.0, 10.0, 5.0, 20.0), (6, None, 0.0, 1.0, 1.0),
        (7, 390.625, 390.625, 12_500.0, 781.25), (7, 390.625, 390.625, 12_500.0, 781.25),
    ]
    df = spark.createDataFrame(rects, "rect_id int, x0 double, y0 double, x1 double, y1 double")
    got = batches.viewport_batch(made, SPEC, df, ("object_id",), level, buckets=20)
    points = [(r["object_id"], r["x"], r["y"]) for r in made.collect()]
    want = sorted((i, o) for i, x0, y0, x1, y1 in rects if x0 is not None for o, x, y in points if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted((r[0], r[1]) for r in got.collect()) == want
    n = {r["rect_id"]: r["n"] for r in batches.rect_counts(made, SPEC, df.where("rect_id < 7"), level).collect()}
    assert n[4] == n[5] == n[6] == 0 and n[2] == 1 and n[3] == 4_000


def test_batch_confines_to_groups_and_classes(spark, made):
    rects = spark.createDataFrame([(1, "g0", ["Tumor"], 0.0, 0.0, 1e5, 1e5), (2, "g1", None, 0.0, 0.0, 1e5, 1e5), (3, "none", None, 0.0, 0.0, 1e5, 1e5)], "rect_id int, group_id string, classes array<string>, x0 double, y0 double, x1 double, y1 double")
    got = {r["rect_id"]: r["count"] for r in batches.viewport_batch(made, SPEC, rects, ()).groupBy("rect_id").count().collect()}
    assert got == {1: made.where("group_id = 'g0' AND class_label = 'Tumor'").count(), 2: made.where("group_id = 'g1'").count()}


def test_batch_joins_on_cells_alone(made, spark):
    rects = batches.sweep_rects(spark.range(50).selectExpr("id AS anchor_id", "id / 50 AS u", "1 - id / 50 AS v"), SPEC)
    plan = batches.viewport_batch(made, SPEC, rects)._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    spans = rects.selectExpr("round((x1 - x0) * (y1 - y0) / 1e10 - fraction, 9) AS off", "x0 >= 0 AND y0 >= 0 AND x1 <= 100000.001 AND y1 <= 100000.001 AS inside").distinct().collect()
    assert [tuple(r) for r in spans] == [(0.0, True)]


def test_knn_batch_equals_knn(spark, made):
    points = [(1, 50_000.0, 50_000.0), (2, 0.0, 0.0), (3, 99_999.0, 10.0)]
    df = spark.createDataFrame(points, "point_id int, px double, py double")
    got = batches.knn_batch(made, SPEC, df, 7, first=2, buckets=20).collect()
    for i, x, y in points:
        assert sorted((r["dist"], r["object_id"]) for r in got if r["point_id"] == i) == sorted((r["dist"], r["object_id"]) for r in select.knn(made, x, y, 7).collect())
    few = made.limit(5)
    assert batches.knn_batch(few, SPEC, df, 7).count() == 15  # all there are


# --- reads, clients


def test_stored_layouts_read_less(spark, small):
    rows = {r["form"]: r for r in Q.QUERIES["scan_savings"](spark, small).collect()}
    for plain, stored in (("viewport_plain", "viewport_stored"), ("small_plain", "small_stored"), ("classes_plain", "covering_stored")):
        assert rows[plain]["rows_out"] == rows[stored]["rows_out"] and rows[stored]["rows_read"] <= rows[plain]["rows_read"] / (1 if stored == "covering_stored" else 2)  # the covering layout of so few rows is one row group
    assert rows["small_stored"]["folders"] < 120 and rows["table"]["files"] == 1 and rows["table"]["rows_read"] == rows["table"]["rows_out"]


def test_reads_opens_adaptive_plans(spark, small):
    df = spark.read.parquet(f"{small}/events.parquet")
    r = scans.reads(df.groupBy("event_type").count().join(df.select("event_type").distinct(), "event_type"))
    assert r.files == 2 and r.rows_read == 2 * df.count() and r.rows_out == df.select("event_type").distinct().count()


def test_clients_get_what_one_gets(spark, small):
    questions = studies.questions(spark, small)[:8] + [("broken", lambda s: s.sql("SELECT no_such_column FROM range(1)"))]
    rows, levels = clients.measured(spark, questions, (1, 3))
    same = {(r["clients"], r["kind"]): (r["n"], r["rows"], r["failed"]) for r in clients.same_as_alone(rows).collect()}
    assert {k: v for (n, k), v in same.items() if n == 1} == {k: v for (n, k), v in same.items() if n == 3} and same[3, "broken"] == (1, 0, 1)
    assert [(r["clients"], r["answered"]) for r in levels.orderBy("clients").collect()] == [(1, 8), (3, 8)]
    assert rows.where("clients = 3").select("client").distinct().count() == 3 and all(r["per_second"] > 0 for r in levels.collect())


# --- calibration


def test_interval_of_the_constant_holds_a_known_one(spark):
    import random

    rng = random.Random(1)
    rows = [(k, "g", f, f * 400 + 2.5 * math.sqrt(f * 400) + rng.gauss(0, 1), 400) for k, f in enumerate([0.01, 0.02, 0.05, 0.1, 0.2] * 60)]
    trials = spark.createDataFrame(rows, "rect_id int, group_id string, fraction double, met double, total int")
    r = calibration.constant_interval(trials, 400).first()
    assert r["low"] < 2.5 < r["high"] and r["high"] - r["low"] < 0.2 and r["rounds"] == 400
    assert calibration.constant_interval(trials.repartition(7), 400).first()["c"] == pytest.approx(r["c"], abs=1e-12)
    assert abs(calibration.constant(trials).first()["c"] - 2.5) < 0.1
    none = calibration.constant(trials.where("false")).first()
    assert (none["c"], none["r2"], none["n"]) == (2.0, 0.0, 0)


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(40_000).select(calibration.drawn_times(F.col("id").cast("string"), 3).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(w[0] - 1) < 0.02 and abs(w[1] - 1) < 0.04 and 5 <= w[2] <= 7


def test_density_fit_of_a_known_line(spark):
    groups = spark.createDataFrame([("a", 0.5, 2.0, 1), ("b", 1.0, 2.5, 1), ("c", 2.0, 3.5, 1)], "group_id string, cv double, c double, n int")
    f = calibration.density_fit(groups).first()
    assert (round(f["base"], 9), round(f["slope"], 9), round(f["r2"], 9), f["n"]) == (1.5, 1.0, 1.0, 3)
    one = calibration.density_fit(groups.limit(1)).first()
    assert (one["base"], one["slope"], one["std_err"]) == (2.03, 0.0, None)


# --- catalog


def test_catalog_notices_what_has_changed(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "layouts")
    rows = workload.made(spark, 500, SPEC)
    rows.write.parquet(source)
    read = lambda: spark.read.parquet(source)
    first = catalog.LayoutCatalog(spark, root)
    one = first.ensure("made", "two_level", read, SPEC, 4)
    assert first.ensure("made", "two_level", read, SPEC, 4).path == one.path
    other = catalog.LayoutCatalog(spark.newSession(), root)  # as another session would
    assert other.ensure("made", "two_level", read, SPEC, 4).path == one.path and other.ensure("made", "two_level", read, SPEC, 4).enum == one.enum
    two = other.ensure("made", "two_level", read, SPEC, 8)
    assert two.path != one.path and two.read(spark).select("bucket").distinct().count() == 8
    assert first.ensure("made", "two_level", read, GridSpec(2e5, 2e5), 8).path not in (one.path, two.path)
    rows.limit(50).write.mode("append").parquet(source)
    grown = first.ensure("made", "two_level", read, SPEC, 8)
    assert grown.n_objects == 550 == grown.read(spark).count()
    assert [r["version"] for r in first.entries().orderBy("version").collect()] == [1, 2, 3, 4]
    assert sorted(first.drop("made", "two_level", keep=2)) == [1, 2] and not (tmp_path / "layouts" / one.path.rsplit("/", 1)[1]).exists()
    assert catalog.LayoutCatalog(spark, root).current("made", "two_level")["path"] == grown.path
    assert first.current("made", "covering") is None and catalog.LayoutCatalog(spark, str(tmp_path / "none")).entries().count() == 0


def test_kept_layouts_do_not_go_stale(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    workload.made(spark, 100, SPEC).write.parquet(source)
    first = layout.kept(spark, "two_level", "k", lambda: spark.read.parquet(source), SPEC, 2, root)
    shutil.rmtree(source)
    workload.made(spark, 120, SPEC).write.parquet(source)
    assert (first.n_objects, layout.kept(spark, "two_level", "k", lambda: spark.read.parquet(source), SPEC, 2, root).n_objects) == (100, 120)


def test_registry_of_datasets(spark, made, tmp_path):
    r = catalog.LoadedDatasets(spark, str(tmp_path))
    assert r.datasets().count() == 0
    r.register("made", "points", made, {"by": "test"})
    r.register("made", "points", made.where("group_id = 'g1'"))
    r.register("other", "points", made.limit(0))
    got = {x["name"]: (x["n_groups"], x["n_objects"], x["notes"]) for x in catalog.LoadedDatasets(spark, str(tmp_path)).datasets().collect()}
    assert got == {"made": (1, made.where("group_id = 'g1'").count(), {}), "other": (0, 0, {})}


# --- buckets of unequal intervals


def test_split_and_merge_move_only_their_folders(spark, made, tmp_path):
    path = str(tmp_path / "two")
    before = rebalance.write_budgeted(made, path, SPEC, {"g0": 4, "g1": 1, "g2": 7})
    files = lambda: {f for f, _, _ in shared.files_of(spark, [path])}
    old = files()
    after = rebalance.merge(rebalance.split(before, "g0", 2, SPEC.order), "g2", 4, 3)
    assert rebalance.rebalanced(spark, path, before, after, SPEC.order) == 4 and rebalance.rebalanced(spark, path, after, after, SPEC.order) == 0
    now = files()
    assert {f.rsplit("/", 3)[1] + "/" + f.rsplit("/", 3)[2] for f in old ^ now} == {"group_id=g0/bucket=2", "group_id=g0/bucket=4", "group_id=g2/bucket=3", "group_id=g2/bucket=4"}
    rows = spark.read.parquet(path)
    assert rows.count() == 4_000 and rows.where("group_id = 'g2' AND bucket = 4").count() == 0 and rows.where("group_id = 'g0' AND bucket = 4").count() > 0
    rect = (20_000.0, 20_000.0, 60_000.0, 45_000.0)
    for group in (None, "g0", "g2"):
        got = rebalance.viewport_bounded(rows, SPEC, rect, after, group)
        assert sorted(r[0] for r in got.select("object_id").collect()) == sorted(r[0] for r in select.viewport(made, rect, group).select("object_id").collect())
    wrong = rows.where(rows["bucket"] != rebalance.bucket_of_key(after)).count()
    assert wrong == 0 and scans.reads(rebalance.viewport_bounded(rows, SPEC, rect, after, "g2")).folders < 7


def test_bounds():
    b = rebalance.uniform({"a'b": 3, "c": 1}, 2)
    assert b == {"a'b": [(0, 0), (6, 1), (11, 2)], "c": [(0, 0)]}
    assert rebalance.split(b, "c", 0, 2)["c"] == [(0, 0), (8, 1)] and rebalance.merge(b, "a'b", 0, 1)["a'b"] == [(0, 1), (11, 2)]
    with pytest.raises(ValueError):
        rebalance.merge(b, "a'b", 0, 2)
    with pytest.raises(KeyError):
        rebalance.split(b, "c", 5, 2)
    assert rebalance.advised(b, [("a'b", 1, "merge"), ("c", 0, "split"), ("a'b", 2, "merge"), ("x", 1, "split")], 2) == {"a'b": [(0, 0), (6, 1)], "c": [(0, 0), (8, 1)]}
    assert len(rebalance.uniform({"d": 100}, 2)["d"]) == 16 and rebalance.met(b["a'b"], [(5, 7)], 2) == [0, 1]


# --- statistics


@pytest.mark.parametrize("df,want", [(1, 12.706204736), (2, 4.302652730), (3, 3.182446305), (4, 2.776445105), (5, 2.570581836), (7, 2.364624252), (9, 2.262157163), (14, 2.144786688), (19, 2.093024054), (29, 2.045229642), (59, 2.000995378), (61, 1.999623585), (120, 1.979930405), (1000, 1.962339081)])
def test_t_quantiles(spark, df, want):
    """Values of published tables."""
    assert stats.t_quantile(df) == pytest.approx(want, abs=2e-9)
    assert spark.range(1).select(stats.t_column(F.lit(df)).alias("t")).first()["t"] == pytest.approx(want, abs=2e-9)
    assert stats.t_tail(want, df) == pytest.approx(0.05, abs=1e-9)


def test_intervals_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in stats.mean_interval(df, ["k"], "v").collect()}
    assert got["a"]["high"] == pytest.approx(1.5 + 12.706204736 * math.sqrt(0.5) / math.sqrt(2)) and got["b"]["low"] is None and got["c"]["n"] == 0


def test_line_test(spark):
    """The published regression of Anscombe's first set."""
    xy = [(10, 8.04), (8, 6.95), (13, 7.58), (9, 8.81), (11, 8.33), (14, 9.96), (6, 7.24), (4, 4.26), (12, 10.84), (7, 4.82), (5, 5.68)]
    r = stats.line_test(spark.createDataFrame([(float(a), b) for a, b in xy], "x double, y double"), "x", "y")
    assert [round(r[k], 4) for k in ("slope", "intercept", "r2", "slope_error", "intercept_error", "p")] == [0.5001, 3.0001, 0.6665, 0.1179, 1.1247, 0.0022]
    few = stats.line_test(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y")
    assert (few["n"], few["slope"], few["p"]) == (1, None, None)


def test_quadratic_of_known_curve(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x * x - 20_000.0 * x + 7.0) for x in range(1_000, 1_300, 7)] + [(None, 1.0)], "x double, y double")
    r = stats.quadratic_fit(df, "x", "y").first()
    assert r["a"] == pytest.approx(3, rel=1e-9) and r["b"] == pytest.approx(-20_000, rel=1e-9) and r["c"] == pytest.approx(7, abs=1e-2) and r["r2"] == pytest.approx(1)
    assert stats.quadratic_fit(df.limit(2), "x", "y").first()["a"] is None


def test_samples_have_exactly_n_rows(spark, made):
    for n in (0, 1, 10, 4_000, 5_000):
        a = stats.exact_sample(made, n, columns=["object_id"])
        assert a.count() == min(n, 4_000)
    ids = lambda df: sorted(r["object_id"] for r in df.collect())
    assert ids(stats.exact_sample(made, 10)) == ids(stats.exact_sample(made.repartition(11), 10)) != ids(stats.exact_sample(made, 10, seed=1))
    by = stats.exact_sample(made, 6, by=["group_id"]).groupBy("group_id").count().collect()
    assert sorted((r[0], r[1]) for r in by) == [("g0", 6), ("g1", 6), ("g2", 6)]
    same = spark.range(20).selectExpr("1 AS a", "'x' AS b")
    assert stats.exact_sample(same, 7).count() == 7 and set(stats.random_object(made, "g1").columns) == set(made.columns)


def test_changes_to_null_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "kept"), (2, "b", "kept"), (3, "c", "kept")], "k int, v string, _found string")
    changes = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert sorted(map(tuple, joins.updated(df, changes, "k", "v").collect())) == [(1, None, "kept"), (2, "z", "kept"), (3, "c", "kept")]



def test_mapped_coordinates_are_those_of_the_driver(spark):
    import numpy as np

    from tessella.plans import learned

    knots = [0.0, 1.0, 1.0, 1.0, 2.5, 7.0, 7.25, 100.0]
    values = [-5.0, 0.0, 0.3, 1.0, 1.7, 2.5, 6.99, 7.0, 7.1, 99.9, 100.0, 1e9, None]
    df = spark.createDataFrame([("a", v, v) for v in values] + [("b", 1.0, 1.0)], "group_id string, x double, y double")
    model = spark.createDataFrame([("a", knots, knots[::2], 5)], "group_id string, xs array<double>, ys array<double>, n long")
    rows = learned.with_learned_key(df, model).collect()
    assert len(rows) == len(values)
    for r in rows:
        want = None if r["x"] is None else learned.transform(r["x"], knots)
        assert r["u"] == want and (want is None or (abs(want - np.interp(r["x"], knots, np.linspace(0, 1, 8))) < 1e-12 and r["v"] == learned.transform(r["y"], knots[::2])))
    assert {r["l_key"] is None for r in rows if r["x"] is None} == {True}
    one = learned.with_learned_key(df, model.withColumn("xs", F.array(F.lit(3.0))).withColumn("ys", F.array(F.lit(3.0)))).where("x IS NOT NULL").select("u").distinct().collect()
    assert sorted(r[0] for r in one) == [0.0, 1.0]


def test_model_tables_equal_the_models(spark):
    from tessella.plans import models, tables

    catalog_ = spark.createDataFrame([("a", 1_000_000), ("b", 3), ("c", 120_000)], "group_id string, n long")
    n = {"a": 1_000_000, "b": 3, "c": 120_000}
    for r in tables.prediction_table(catalog_).collect():
        b = min(max(1, n[r["group_id"]] // 50_000), 4 ** r["order"])
        assert (r["buckets"], r["expected"]) == (b, pytest.approx(models.expected_buckets(r["fraction"], b))) and r["fp_bound"] == pytest.approx(models.false_positive_bound(r["fraction"], r["order"]))
    surface = tables.cost_surface(catalog_, range(2_000, 200_000, 1_000), (0.05,))
    rows = surface.collect()
    assert all(r["cost"] == pytest.approx(models.bucket_cost(r["target"], n[r["group_id"]], 0.05)) for r in rows)
    step = lambda t: models.bucket_cost(t, 1_000_000, 0.05)
    for r in rows:
        if r["group_id"] == "a" and r["slope"] is not None and r["target"] < 190_000:
            assert r["slope"] == pytest.approx((step(r["target"] + 1) - step(r["target"] - 1)) / 2, rel=1e-3, abs=1e-9)
    best = {r["group_id"]: r["target"] for r in tables.best_targets(surface).collect()}
    assert abs(best["a"] - models.best_target(1_000_000, 0.05)) <= 2_000
    assert {r[0]: r[1] for r in tables.least_order(catalog_).collect()} == {"a": 7, "b": 7, "c": 7}
    assert [tables.layout_advice(catalog_, c).first()["layout"] for c in (23, 22, 2)] == ["two_level", "grouped_clustered", "mono_clustered"]
    assert tables.layout_advice(catalog_.limit(0), 5).first()["partitions"] == 0


def test_ranges_of_rectangles_without_cells():
    from tessella.plans import ranges

    none = (5.0, 0.0, 1.0, 9.0)
    assert ranges.key_ranges_or_all(SPEC, none) == [] and ranges.key_ranges_or_all(SPEC, none, "full") == [(0, 1 << 16)]
    assert ranges.key_ranges_or_all(SPEC, (1.0, 0.0, 5.0, 9.0), "full") == ranges.key_ranges(SPEC, (1.0, 0.0, 5.0, 9.0))
    for choice, rect in (("raise", none), ("other", none)):
        with pytest.raises(ValueError):
            ranges.key_ranges_or_all(SPEC, rect, choice)
