import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import curves, keys
from tessella.functions.grid import GridSpec
from tessella.plans import ranges as R


@pytest.mark.parametrize("order", range(1, 8))
def test_curves_are_bijections_of_neighbours(order):
    n = 1 << order
    x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
    k = curves.hilbert_np(x, y, order)
    assert sorted(k.tolist()) == list(range(n * n))
    place = np.argsort(k)
    assert (np.abs(np.diff(x[place])) + np.abs(np.diff(y[place])) == 1).all()
    assert all(curves.hilbert_cell(int(h), order) == (a, b) for h, a, b in zip(k, x, y))
    assert sorted(curves.morton_np(x, y).tolist()) == list(range(n * n))
    assert curves.morton(1, 0) == 2 and curves.morton(1, 0, x_first=False) == 1


@pytest.mark.parametrize("order", [1, 5, 23])
def test_columns_equal_scalars(spark, order):
    rng = random.Random(order)
    cells = [(rng.randrange(1 << order), rng.randrange(1 << order)) for _ in range(200)]
    df = spark.createDataFrame(cells, "x long, y long").withColumn("h", curves.hilbert_column(F.col("x"), F.col("y"), order)).withColumn("z", curves.morton_column(F.col("x"), F.col("y")))
    bx, by = curves.hilbert_cell_columns(F.col("h"), order)
    mx, my = curves.morton_cell(F.col("z"))
    for r in df.select("*", bx.alias("bx"), by.alias("by"), mx.alias("mx"), my.alias("my")).collect():
        assert r["h"] == curves.hilbert(r["x"], r["y"], order) and r["z"] == curves.morton(r["x"], r["y"])
        assert (r["bx"], r["by"]) == (r["mx"], r["my"]) == (r["x"], r["y"])


def test_ranges_hold_exactly_the_cells_before_the_cap():
    rng = random.Random(3)
    for curve in ("hilbert", "morton"):
        for _ in range(60):
            spec = GridSpec(100.0, 50.0, rng.choice([2, 4, 6]), -10.0, 5.0)
            x, y = sorted(rng.uniform(-30, 110) for _ in range(2)), sorted(rng.uniform(-10, 70) for _ in range(2))
            rect = (x[0], y[0], x[1], y[1])
            x0, y0, x1, y1 = R.cells_of(spec, rect)
            f = (lambda a, b: curves.hilbert(a, b, spec.order)) if curve == "hilbert" else curves.morton
            want = sorted(f(a, b) for a in range(x0, x1 + 1) for b in range(y0, y1 + 1))
            found = R.key_ranges(spec, rect, curve, cap=None)
            assert [k for low, high in found for k in range(low, high)] == want
            few = R.key_ranges(spec, rect, curve, cap=3)
            assert len(few) <= 3 and set(want) <= {k for low, high in few for k in range(low, high)}
            coarse = R.key_ranges(spec, rect, curve, cap=None, order=2)
            assert set(want) <= {k for low, high in coarse for k in range(low, high)}


@pytest.mark.parametrize("buckets", [1, 3, 16, 30, 59])
def test_bucket_intervals_are_the_preimage(buckets):
    for b in range(buckets):
        low, high = keys.bucket_interval(b, buckets, 4)
        assert all(keys.bucket_of(k, buckets, 4) == b for k in range(low, high))
    assert sum(high - low for low, high in (keys.bucket_interval(b, buckets, 4) for b in range(buckets))) == 256
    assert keys.bucket_interval(buckets - 1, buckets, 4, "open")[1] is None


def test_grid_edges():
    spec = GridSpec(10.0, 10.0, 3)
    assert spec.cell(10.0, -5.0) == (7, 0) and spec.cell(99.0, 9.99) == (7, 7)
    assert GridSpec(10.0, 10.0, 3, mode="inclusive").cell(10.0, 9.9) == (7, 6)
    for bad in ({"order": 24}, {"mode": "x"}, {"width": 0.0}):
        with pytest.raises(ValueError):
            GridSpec(**{"width": 1.0, "height": 1.0, **bad})


def test_null_and_nan_have_no_key(spark):
    cx, cy = GridSpec(1.0, 1.0).columns(F.col("x"), F.col("y"))
    rows = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5), (0.5, 0.5)], "x double, y double").select(curves.hilbert_column(cx, cy, 8).alias("h")).collect()
    assert [r["h"] is None for r in rows] == [True, True, False]
