"""Registered queries over many rectangles at once: sweeps, calibration of the pruning model, reads, clients, adapted layouts, samples and fits."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import rebalance, select, stats
from tessella.plans import batches, calibration, clients, learned, models, scans, tables, workload
from tessella.plans import ranges as R
from tessella.plans.queries import (
    BUCKETS, EMBED, EMBED_RECT, EMBED_SQL, EVENT_KEYS, EVENTS, EVENTS_SQL, LINES_SQL, RECT, SHOWN, VIEWPORT, WIDE, between, embed, events, keyed, layout, lines, named_after,
    query, stored_events,
)
from tessella.sources import readers
from tessella.streaming import monitor

# --- many rectangles


def anchors(spark, d) -> DataFrame:
    """A place in [0, 1] squared and a group for each supplier."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.selectExpr("s_suppkey AS anchor_id", "concat('g', cast(s_suppkey % 4 AS string)) AS group_id", "(s_suppkey * 7919 % 10007) / 10007 AS u", "(s_suppkey * 104729 % 10007) / 10007 AS v")


def rectangles(spark, d) -> DataFrame:
    return batches.sweep_rects(anchors(spark, d), EVENTS)


SIDES = ", ".join(f"({k}, {f!r}e0, {f**0.5!r}e0)" for k, f in enumerate(batches.FRACTIONS))
RECTS_SQL = f"""(SELECT s_suppkey * {len(batches.FRACTIONS)} + k AS rect_id, fraction, 'g' || (s_suppkey % 4) AS group_id, x0, y0, x0 + {EVENTS.width!r}e0 * side AS x1, y0 + {EVENTS.height!r}e0 * side AS y1
  FROM (SELECT *, 0e0 + (s_suppkey * 7919 % 10007) / 10007 * ({EVENTS.width!r}e0 * (1 - side)) AS x0, 0e0 + (s_suppkey * 104729 % 10007) / 10007 * ({EVENTS.height!r}e0 * (1 - side)) AS y0
        FROM supplier, (VALUES {SIDES}) AS f(k, fraction, side)))"""
IN_RECT = "e.group_id = r.group_id AND e.x BETWEEN r.x0 AND r.x1 AND e.y BETWEEN r.y0 AND r.y1"


@query(f"SELECT r.rect_id, r.fraction, r.group_id, count(e.object_id) AS n FROM {RECTS_SQL} r LEFT JOIN {EVENTS_SQL} e ON {IN_RECT} GROUP BY 1, 2, 3")
def viewport_batch(spark, d):
    """A rectangle of each of five area fractions at each supplier's place, all counted in one job over the stored layout."""
    out = batches.rect_counts(stored_events(spark, d).read(spark), EVENTS, rectangles(spark, d), buckets=BUCKETS)
    return out.select("rect_id", "fraction", "group_id", "n")


@query(f"""SELECT fraction, count(*) AS rects, count(*) FILTER (WHERE n = 0) AS empty, round(avg(n), 6) AS mean_n, max(n) AS max_n FROM (
SELECT r.rect_id, r.fraction, count(e.object_id) AS n FROM {RECTS_SQL} r LEFT JOIN {EVENTS_SQL} e ON {IN_RECT} GROUP BY 1, 2) GROUP BY 1""")
def fraction_sweep(spark, d):
    n = batches.rect_counts(stored_events(spark, d).read(spark), EVENTS, rectangles(spark, d), buckets=BUCKETS)
    return n.groupBy("fraction").agg(F.count(F.lit(1)).alias("rects"), F.count_if(F.col("n") == 0).alias("empty"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("max_n"))


@query(f"SELECT r.rect_id, e.class_label, count(*) AS n FROM {RECTS_SQL} r JOIN {EVENTS_SQL} e ON {IN_RECT} AND e.class_label IN ('click', 'purchase') WHERE r.fraction < 0.03 GROUP BY 1, 2")
def viewport_batch_classes(spark, d):
    """The small rectangles, for two classes."""
    rects = rectangles(spark, d).where("fraction < 0.03").withColumn("classes", F.array(F.lit("click"), F.lit("purchase")))
    hits = batches.viewport_batch(stored_events(spark, d).read(spark), EVENTS, rects, ["class_label"], buckets=BUCKETS)
    return hits.groupBy("rect_id", "class_label").agg(F.count(F.lit(1)).alias("n"))


KNN_POINTS = "(SELECT s_suppkey AS point_id, -0.2e0 + (s_suppkey * 7919 % 10007) / 10007 * 0.4e0 AS px, -0.2e0 + (s_suppkey * 104729 % 10007) / 10007 * 0.4e0 AS py FROM supplier)"


@query(f"""SELECT point_id, object_id, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, object_id) AS k FROM (
SELECT point_id, object_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM {KNN_POINTS}, {EMBED_SQL})) WHERE k <= 10""")
def knn_batch(spark, d):
    """The ten nearest objects of each supplier's place, all in one."""
    kept = layout.kept(spark, "two_level", named_after("embed", d), lambda: embed(spark, d), EMBED, BUCKETS)
    points = anchors(spark, d).select(F.col("anchor_id").alias("point_id"), (F.lit(-0.2) + F.col("u") * 0.4).alias("px"), (F.lit(-0.2) + F.col("v") * 0.4).alias("py"))
    first = select.first_ring(EMBED, 10, kept.n_objects)
    return batches.knn_batch(kept.read(spark), EMBED, points, 10, first=first).withColumn("dist", F.round("dist", 9))


@query()
def scan_savings(spark, d):
    """What the same rectangles read as plain scans and over stored layouts: no SQL tells files."""
    table = spark.read.parquet(f"{d}/events.parquet")
    two, cover = stored_events(spark, d), stored_events(spark, d, "covering")
    small = (RECT[0], RECT[1], RECT[0] + 90_000.0, RECT[1] + 60.0)
    plain = lambda rect, classes=None: select.viewport(events(spark, d), rect, "g0", classes)
    return scans.compared(spark, {
        "table": table, "viewport_plain": plain(RECT), "viewport_stored": select.viewport_pruned(two.read(spark), EVENTS, RECT, "g0", buckets=BUCKETS),
        "small_plain": plain(small), "small_stored": select.viewport_pruned(two.read(spark), EVENTS, small, "g0", buckets=BUCKETS),
        "classes_plain": plain(WIDE, ["click"]), "covering_stored": select.covering(cover.read(spark), EVENTS, WIDE, ["click"], cover.enum, "g0"),
    })


# --- clients

MIXED = workload.mixed(EVENTS, 24, seed=11)
LEVELS = (1, 4, 16)


def questions(spark, d) -> list[clients.Question]:
    """The mixed workload over the stored layout: rectangles, neighbours, tiles and classes."""
    rows = stored_events(spark, d).read(spark)
    rng = random.Random(5)

    def one(kind: str, place: tuple[float, ...]) -> clients.Question:
        group = f"g{rng.randrange(4)}"
        if kind == "knn":
            return kind, lambda s: select.knn(rows, *place, 50, group)
        found = select.viewport_pruned(rows, EVENTS, place, group, ["click"] if kind == "classes" else None, buckets=BUCKETS)
        return kind, lambda s: found.groupBy("tile_id").count() if kind == "tiles" else found

    return [one(kind, place) for kind, place in MIXED]


def _mixed_sql() -> str:
    rng, parts = random.Random(5), []
    for kind, place in MIXED:
        where = f"group_id = 'g{rng.randrange(4)}'"
        if kind == "knn":
            parts.append(f"SELECT 'knn' AS kind, least(50, count(*)) AS r FROM {EVENTS_SQL} WHERE {where}")
            continue
        where += f" AND x BETWEEN {place[0]!r}e0 AND {place[2]!r}e0 AND y BETWEEN {place[1]!r}e0 AND {place[3]!r}e0" + (" AND class_label = 'click'" if kind == "classes" else "")
        what = "count(DISTINCT (floor(x / 256), floor(y / 256)))" if kind == "tiles" else "count(*)"
        parts.append(f"SELECT '{kind}' AS kind, {what} AS r FROM {EVENTS_SQL} WHERE {where}")
    levels = ", ".join(f"({n})" for n in LEVELS)
    return f"SELECT clients, kind, count(*) AS n, sum(r)::BIGINT AS rows, 0 AS failed FROM ({' UNION ALL '.join(parts)}), (VALUES {levels}) AS l(clients) GROUP BY 1, 2"


@query(_mixed_sql())
def concurrent_clients(spark, d):
    """The mixed workload by 1, 4 and 16 clients at once: what they get does not depend on their number."""
    return clients.same_as_alone(clients.measured(spark, questions(spark, d), LEVELS)[0])


# --- calibration

TRIALS_SQL = f"""{EVENT_KEYS}, e AS (SELECT *, h * {BUCKETS} // 65536 AS bucket FROM walk WHERE s = 0), totals AS (SELECT group_id, count(DISTINCT bucket) AS total FROM e GROUP BY 1),
hits AS (SELECT r.rect_id, count(DISTINCT e.bucket) AS met, count(*) AS n FROM {RECTS_SQL} r JOIN e ON {IN_RECT} GROUP BY 1),
trials AS (SELECT r.rect_id, r.group_id, r.fraction, coalesce(met, 0) AS met, total, coalesce(n, 0) AS n FROM {RECTS_SQL} r JOIN totals USING (group_id) LEFT JOIN hits USING (rect_id)),
terms AS (SELECT *, sqrt(fraction * total) AS t, met - fraction * total AS b FROM trials)"""


def trials(spark, d) -> DataFrame:
    return calibration.buckets_met(stored_events(spark, d).read(spark), EVENTS, rectangles(spark, d))


@query(f"{TRIALS_SQL} SELECT rect_id, group_id, fraction, met, total, n FROM trials")
def buckets_met(spark, d):
    return trials(spark, d)


@query(f"""{TRIALS_SQL}, c AS (SELECT sum(t * b) / sum(t * t) AS c FROM terms)
SELECT round(any_value(c), 9) AS c, round(1 - sum((b - c * t) ** 2) / (var_pop(b) * count(*)), 9) AS r2, count(*) AS n, round(avg(b - c * t), 9) AS residual_mean, round(stddev_pop(b - c * t), 9) AS residual_sd FROM terms, c""")
def curve_constant(spark, d):
    """The curve's constant from the buckets that the trials met."""
    r = calibration.constant(trials(spark, d))
    return r.select("n", *[F.round(c, 9).alias(c) for c in ("c", "r2", "residual_mean", "residual_sd")])


ROUNDS = 200
WEIGHT = " + ".join(f"(u >= {p})::INT" for p in calibration.POISSON)


@query(f"""{TRIALS_SQL}, drawn AS (SELECT round, t, b, {WEIGHT} AS w FROM (SELECT *, ('0x' || md5(rect_id || ':' || round || ':42')[1:8])::BIGINT AS u FROM terms, (SELECT unnest(range(1, {ROUNDS + 1})) AS round))),
cs AS (SELECT round, sum(w * t * b) / sum(w * t * t) AS c FROM drawn GROUP BY 1)
SELECT round(avg(c), 9) AS c, round(quantile_cont(c, 0.025), 9) AS low, round(quantile_cont(c, 0.975), 9) AS high, round(stddev_pop(c), 9) AS sd, count(*) AS rounds FROM cs""")
def curve_constant_interval(spark, d):
    r = calibration.constant_interval(trials(spark, d), ROUNDS)
    return r.select("rounds", *[F.round(c, 9).alias(c) for c in ("c", "low", "high", "sd")])


GROUPS_SQL = f"""{TRIALS_SQL}, cv AS (SELECT group_id, stddev_pop(n) / avg(n) AS cv FROM (SELECT group_id, floor(x / 256e0) AS tx, floor(y / 256e0) AS ty, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1, 2, 3) GROUP BY 1),
g AS (SELECT group_id, any_value(cv) AS cv, avg(b / t) AS c, count(*) AS n FROM terms JOIN cv USING (group_id) GROUP BY 1)"""


@query(f"{GROUPS_SQL} SELECT group_id, round(cv, 9) AS cv, round(c, 9) AS c, n FROM g")
def group_constants(spark, d):
    g = calibration.group_constants(trials(spark, d), calibration.tile_cv(stored_events(spark, d).read(spark)))
    return g.select("group_id", F.round("cv", 9).alias("cv"), F.round("c", 9).alias("c"), "n")


@query(f"""{GROUPS_SQL}, s AS (SELECT regr_intercept(c, cv) AS base, regr_slope(c, cv) AS slope, regr_r2(c, cv) AS r2, regr_sxx(c, cv) AS sxx, regr_syy(c, cv) AS syy, count(*) AS n FROM g)
SELECT round(base, 5) AS base, round(slope, 5) AS slope, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / sxx / (n - 2)), 5) AS std_err, n FROM s""")
def density_fit(spark, d):
    """How the constant goes with the variation of density, over groups."""
    f = calibration.density_fit(calibration.group_constants(trials(spark, d), calibration.tile_cv(stored_events(spark, d).read(spark))))
    return f.select("n", F.round("base", 5).alias("base"), F.round("slope", 5).alias("slope"), F.round("r2", 6).alias("r2"), F.round("std_err", 5).alias("std_err"))


@query(f"""{EVENT_KEYS}, e AS (SELECT group_id, h * {BUCKETS} // 65536 AS bucket, count(*) AS n FROM walk WHERE s = 0 GROUP BY 1, 2),
g AS (SELECT group_id, count(*) AS buckets, sum(n)::BIGINT AS n, stddev_pop(n) / avg(n) AS cv, avg(n * n) / avg(n) / avg(n) AS cost_ratio FROM e GROUP BY 1),
m AS (SELECT *, least(buckets * 0.05e0 + {models.CALIBRATED}e0 * sqrt(buckets * 0.05e0), buckets) AS expected FROM g)
SELECT group_id, buckets, n, round(cv, 9) AS cv, round(cost_ratio, 9) AS cost_ratio, round(expected, 9) AS expected, round(1 - expected / buckets, 9) AS pruning FROM m""")
def density_weighted(spark, d):
    g = calibration.density_weighted(stored_events(spark, d).read(spark), 0.05)
    return g.select("group_id", "buckets", "n", *[F.round(c, 9).alias(c) for c in ("cv", "cost_ratio", "expected", "pruning")])


@query(f"""{TRIALS_SQL}, p AS (SELECT *, least(fraction * total + {models.CALIBRATED}e0 * t, total) AS said FROM terms)
SELECT group_id, fraction, count(*) AS trials, round(avg(met), 9) AS seen, round(avg(said), 9) AS said, round(avg(1 - met / total), 9) AS pruning_seen, round(avg(1 - said / total), 9) AS pruning_said FROM p GROUP BY 1, 2""")
def model_validation(spark, d):
    """The pruning model against what was met, by group and fraction."""
    v = calibration.validated(trials(spark, d))
    return v.select("group_id", "fraction", "trials", *[F.round(c, 9).alias(c) for c in ("seen", "said", "pruning_seen", "pruning_said")])


# --- adapted layouts


@query(VIEWPORT)
def budgeted_viewport(spark, d):
    """Over a layout whose groups have as many buckets as a budget gives them."""
    df = events(spark, d)
    counts = {r["group_id"]: r["count"] for r in df.groupBy("group_id").count().collect()}  # one row per group
    path = f"{layout.shared_dir(spark)}/budgeted-{layout.uuid.uuid4().hex}"
    bounds = rebalance.write_budgeted(keyed(df, EVENTS, {}), path, EVENTS, models.allocate(counts, 25))
    return rebalance.viewport_bounded(spark.read.parquet(path), EVENTS, RECT, bounds, "g0").select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE {between(RECT)}")
def rebalanced_viewport(spark, d):
    """Over all groups, after the splits and merges that the buckets' sizes and a log of hits advise."""
    df = keyed(events(spark, d), EVENTS, {})
    path = f"{layout.shared_dir(spark)}/rebalanced-{layout.uuid.uuid4().hex}"
    before = rebalance.write_budgeted(df, path, EVENTS, {r["group_id"]: BUCKETS for r in df.select("group_id").distinct().collect()})
    stored = spark.read.parquet(path)
    log = stored.where("x < 1000000").withColumn("ms", F.col("y"))
    hits = monitor.bucket_hits(log)
    mean = stored.count() / sum(map(len, before.values()))
    advice = [tuple(r) for r in monitor.advice(stored, hits, mean, 10).select("group_id", "bucket", "advice").collect()]  # two rows a bucket at most
    after = rebalance.advised(before, advice, EVENTS.order)
    rebalance.rebalanced(spark, path, before, after, EVENTS.order)
    return rebalance.viewport_bounded(spark.read.parquet(path), EVENTS, RECT, after).select(*SHOWN)


# --- stored forms of queries that otherwise compute keys for all rows


@query(VIEWPORT)
def viewport_morton_stored(spark, d):
    """By folders of Morton buckets and pushed ranges of the Morton key."""
    found = R.key_ranges(EVENTS, RECT, "morton")
    rows = stored_events(spark, d, "two_level_z").read(spark).where(F.col("z_bucket").isin(R.buckets_of(found, BUCKETS, EVENTS.order)))
    return select.viewport_pruned(rows, EVENTS, RECT, "g0", curve="morton").select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EMBED_SQL} WHERE {between(EMBED_RECT)}")
def viewport_all_groups_stored(spark, d):
    kept = layout.kept(spark, "two_level", named_after("embed", d), lambda: embed(spark, d), EMBED, BUCKETS)
    return select.viewport_pruned(kept.read(spark), EMBED, EMBED_RECT, buckets=BUCKETS).select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EMBED_SQL} WHERE {between(EMBED_RECT)} AND group_id = 'e0'")
def learned_viewport_stored(spark, d):
    """Keys of the learned curve are written once, in their order; ranges of the mapped rectangle reach the scan."""
    df = embed(spark, d).where("group_id = 'e0'")
    model = learned.train(df, 65)
    path = f"{layout.shared_dir(spark)}/learned-{layout.uuid.uuid4().hex}"
    learned.with_learned_key(df, model).repartitionByRange("l_key").sortWithinPartitions("l_key").write.parquet(path)
    m = model.first()
    rows = spark.read.parquet(path).where(select.in_ranges("l_key", learned.learned_ranges(EMBED_RECT, m["xs"], m["ys"])))
    return select.viewport(rows, EMBED_RECT).select(*SHOWN)


# --- samples and fits


@query(f"""SELECT group_id, object_id FROM (SELECT group_id, object_id, row_number() OVER (PARTITION BY group_id ORDER BY md5(object_id || '|7'), object_id) AS k FROM {EVENTS_SQL}) WHERE k <= 20""")
def exact_sample(spark, d):
    """Twenty objects of each group; the number is the feature."""
    return stats.exact_sample(events(spark, d), 20, seed=7, by=["group_id"], columns=["object_id"]).select("group_id", "object_id")


@query(f"SELECT object_id, x, y FROM {EVENTS_SQL} WHERE group_id = 'g2' ORDER BY md5(object_id || '|42'), object_id LIMIT 5")
def random_objects(spark, d):
    """Existing objects as anchors of queries."""
    return stats.random_object(events(spark, d), "g2", n=5).select("object_id", "x", "y")


@query(f"""WITH p AS (SELECT group_id, x, y FROM {LINES_SQL}), m AS (SELECT group_id, avg(x) AS m, stddev_pop(x) AS s, avg(y) AS my FROM p GROUP BY 1),
q AS (SELECT group_id, (x - m) / s AS u, y - my AS v, m, s, my FROM p JOIN m USING (group_id)),
z AS (SELECT group_id, count(*) AS n, sum(u) AS u1, sum(u*u) AS u2, sum(u**3) AS u3, sum(u**4) AS u4, sum(v) AS v1, sum(u*v) AS uv, sum(u*u*v) AS uuv, sum(v*v) AS vv, any_value(m) AS m, any_value(s) AS s, any_value(my) AS my FROM q GROUP BY 1),
det AS (SELECT *, u4*(u2*n - u1*u1) - u3*(u3*n - u1*u2) + u2*(u3*u1 - u2*u2) AS dd FROM z),
sol AS (SELECT *, (uuv*(u2*n - u1*u1) - u3*(uv*n - u1*v1) + u2*(uv*u1 - u2*v1)) / dd AS a, (u4*(uv*n - u1*v1) - uuv*(u3*n - u1*u2) + u2*(u3*v1 - uv*u2)) / dd AS b,
  (u4*(u2*v1 - uv*u1) - u3*(u3*v1 - uv*u2) + uuv*(u3*u1 - u2*u2)) / dd AS c FROM det)
SELECT group_id, round(1e9 * a / (s*s), 4) AS a, round(1e3 * (b / s - 2 * a * m / (s*s)), 4) AS b, round(my + c + a*m*m/(s*s) - b*m/s, 3) AS c, round(1 - (vv - a*uuv - b*uv - c*v1) / vv, 8) AS r2, n FROM sol""")
def quadratic_fit(spark, d):
    """y = a x^2 + b x + c per group; a and b are shown in 1e-9 and 1e-3."""
    f = stats.quadratic_fit(lines(spark, d), "x", "y", ["group_id"])
    return f.select("group_id", F.round(F.col("a") * 1e9, 4).alias("a"), F.round(F.col("b") * 1e3, 4).alias("b"), F.round("c", 3).alias("c"), F.round("r2", 8).alias("r2"), "n")


T_LIST = "[" + ", ".join(f"{stats.t_quantile(k)!r}e0" for k in range(1, stats.LISTED + 1)) + "]"
T_SERIES = "z + (z**3+z)/(4*f) + (5*z**5+16*z**3+3*z)/(96*f**2) + (3*z**7+19*z**5+17*z**3-15*z)/(384*f**3) + (79*z**9+776*z**7+1482*z**5-1920*z**3-945*z)/(92160*f**4)"


@query(f"""SELECT tile, n, round(mean, 6) AS mean, round(mean - t * sd / sqrt(n), 6) AS low, round(mean + t * sd / sqrt(n), 6) AS high FROM (
SELECT *, CASE WHEN f BETWEEN 1 AND {stats.LISTED} THEN {T_LIST}[f] WHEN f > {stats.LISTED} THEN {T_SERIES} END AS t FROM (
SELECT CAST(floor(x / 50000) AS BIGINT) AS tile, count(*) AS n, count(*) - 1 AS f, avg(y) AS mean, stddev_samp(y) AS sd, {stats.NormalDist().inv_cdf(0.975)!r}e0 AS z FROM {EVENTS_SQL} WHERE group_id = 'g1' GROUP BY 1))""")
def mean_intervals(spark, d):
    """Exact t intervals of the mean of few rows: strips of one group."""
    strips = events(spark, d).where("group_id = 'g1'").withColumn("tile", F.floor(F.col("x") / 50000).cast("long"))
    return stats.mean_interval(strips, ["tile"], "y").select("tile", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])




# --- models over a catalog of groups

CATALOG_SQL = f"(SELECT group_id, count(*) AS n FROM {LINES_SQL} GROUP BY 1)"
FRACTIONS_SQL = "(VALUES " + ", ".join(f"({f!r}e0)" for f in tables.FRACTIONS) + ") AS fs(fraction)"


def catalog(spark, d) -> DataFrame:
    return lines(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT group_id, "order", fraction, b AS buckets, round(e, 9) AS expected, round(1 - e / b, 9) AS pruning, round(4 / (sqrt(fraction) * 2e0 ** "order"), 9) AS fp_bound FROM (
SELECT *, least(fraction * b + 2e0 * sqrt(fraction * b), b) AS e FROM (SELECT *, least(greatest(1e0, floor(n / 500)), 4e0 ** "order") AS b FROM {CATALOG_SQL}, (VALUES (4), (6), (8), (10)) AS os("order"), {FRACTIONS_SQL}))""")
def prediction_table(spark, d):
    t = tables.prediction_table(catalog(spark, d), 500)
    return t.select("group_id", "order", "fraction", "buckets", *[F.round(c, 9).alias(c) for c in ("expected", "pruning", "fp_bound")])


SURFACE_SQL = f"""(SELECT group_id, target, fraction, b, n, least(fraction * b + {models.CALIBRATED}e0 * sqrt(fraction * b), b) AS m FROM (SELECT *, greatest(1e0, n / target) AS b
FROM {CATALOG_SQL}, (VALUES {", ".join(f"({t})" for t in tables.TARGETS)}) AS ts(target), {FRACTIONS_SQL}))"""


@query(f"SELECT group_id, target, fraction, round(b, 9) AS buckets, round(0.05e0 * m + 2e-5 * m * n / b, 9) AS cost FROM {SURFACE_SQL}")
def cost_surface(spark, d):
    t = tables.cost_surface(catalog(spark, d))
    return t.select("group_id", "target", "fraction", F.round("buckets", 9).alias("buckets"), F.round("cost", 9).alias("cost"))


@query(f"""SELECT group_id, fraction, target, round(cost, 9) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY group_id, fraction ORDER BY cost, target DESC) AS k FROM (
SELECT *, 0.05e0 * m + 2e-5 * m * n / b AS cost FROM {SURFACE_SQL})) WHERE k = 1""")
def best_targets(spark, d):
    return tables.best_targets(tables.cost_surface(catalog(spark, d))).withColumn("cost", F.round("cost", 9))


@query(f"""SELECT count(*) AS groups, sum(greatest(1, n // 500))::BIGINT AS partitions, 60 AS ceiling,
CASE WHEN sum(greatest(1, n // 500)) <= 60 THEN 'two_level' WHEN count(*) <= 60 THEN 'grouped_clustered' ELSE 'mono_clustered' END AS layout FROM {CATALOG_SQL}""")
def layout_advice(spark, d):
    return tables.layout_advice(catalog(spark, d), 60, 500)


@query(f"""SELECT coalesce(s.group_id, c.group_id) AS group_id, round(CASE WHEN c.w > 0 THEN c.w WHEN s.w > 0 AND s.h > 0 THEN s.w ELSE 100000 END, 6) AS width,
round(CASE WHEN c.w > 0 THEN c.h WHEN s.w > 0 AND s.h > 0 THEN s.h ELSE 100000 END, 6) AS height, CASE WHEN c.w > 0 THEN 'catalog' WHEN s.w > 0 AND s.h > 0 THEN 'objects' ELSE 'default' END AS source
FROM (SELECT group_id, max(x) * 1.05e0 AS w, max(y) * 1.05e0 AS h FROM {EVENTS_SQL} GROUP BY 1) s FULL JOIN
(SELECT 'g' || r_regionkey AS group_id, CASE WHEN r_regionkey IN (1, 2) THEN 1000e0 * r_regionkey ELSE 0e0 END AS w, 500e0 AS h FROM region) c ON s.group_id = c.group_id""")
def group_dims(spark, d):
    """Sizes of groups: of a catalog that knows two of five, else from the objects, else a default."""
    known = spark.read.parquet(f"{d}/region.parquet").selectExpr("concat('g', r_regionkey) AS group_id", "CASE WHEN r_regionkey IN (1, 2) THEN 1000.0D * r_regionkey ELSE 0.0D END AS width", "500.0D AS height")
    return tables.group_dims(events(spark, d), known).select("group_id", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), "source")


# --- files of other shapes, written from the given tables and read back by their readers


def rewritten(spark, df: DataFrame, kind: str, **options) -> str:
    path = f"{layout.shared_dir(spark)}/{kind}-{layout.uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


def cents(v: str) -> str:
    """SQL of both engines for a coordinate in hundredths; the small share keeps values of six decimals off the edges, where sums of vertices can fall either way."""
    return f"CAST(floor({v} * 100e0 + 0.00003e0) AS BIGINT)"


ROUNDED = f"group_id, {cents('x')} AS x, {cents('y')} AS y, class_label, {cents('area')} AS area"


def rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[part.replace("e0", "D") for part in ("group_id", f"{cents('x')} AS x", f"{cents('y')} AS y", "class_label", f"{cents('area')} AS area")])


@query(f"SELECT group_id, {cents('x')} AS x, {cents('y')} AS y, class_label, (object_id % 50 + 1) * 25 AS area FROM {EVENTS_SQL} WHERE object_id % 11 <> 0")
def read_polygons_parquet(spark, d):
    """Squares around the events, those of every eleventh without vertices."""
    h = F.col("object_id") % 3 + 1
    corner = lambda a, b: F.struct((F.col("x") + a * h).alias("x"), (F.col("y") + b * h).alias("y"))
    square = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    nuclei = events(spark, d).select(
        F.col("group_id").alias("case_id"), F.floor("x").alias("tile_minx"), F.floor("y").alias("tile_miny"), (F.col("object_id") % 50 + 1).alias("AreaInPixels"), F.lit(0.5).alias("mpp"),
        F.when(F.col("object_id") % 11 != 0, square).alias("Polygon"), F.col("class_label").alias("type"),
    )
    return rounded(readers.polygons_parquet(spark, rewritten(spark, nuclei, "parquet")))


@query(f"SELECT 'slide' AS group_id, {cents('x')} AS x, {cents('y')} AS y, 'nucleus' AS class_label, (object_id % 50 + 1) * 100 AS area FROM {EVENTS_SQL} WHERE object_id % 11 <> 0")
def read_polygons_csv(spark, d):
    """The same as lines of text, with headers, blank lines and short lines among them."""
    pair = lambda a: F.concat_ws(":", (F.col("x") + a).cast("string"), (F.col("y") - a).cast("string"))
    line = F.concat_ws(",", (F.col("object_id") % 50 + 1).cast("string"), F.lit("1.0"), F.concat_ws(":", pair(-2.0), pair(0.0), pair(2.0)))
    bad = F.when(F.col("object_id") % 2 == 0, "").when(F.col("object_id") % 3 == 0, "AreaInPixels,PhysicalSize,Polygon").otherwise("5,1.0,17.5")
    text = events(spark, d).select(F.when(F.col("object_id") % 11 != 0, line).otherwise(bad).alias("value"))
    return rounded(readers.polygons_csv(spark, rewritten(spark, text, "text"), "slide"))


@query(f"SELECT {ROUNDED} FROM {EVENTS_SQL} WHERE object_id % 11 <> 0")
def read_cells_csv(spark, d):
    x = F.when(F.col("object_id") % 11 != 0, F.col("x"))
    cells = events(spark, d).select(
        F.lit("i").alias("image_id"), F.col("group_id").alias("tissue_type"), F.col("object_id").alias("nucleus_id"), F.col("class_label").alias("category"), x.alias("centroid_x"), F.col("y").alias("centroid_y"),
        "area", F.lit(1.0).alias("perimeter"),
    )
    return rounded(readers.cells_csv(spark, rewritten(spark, cells, "csv", header=True)))


STAR_BINS = " ".join(f"WHEN c >= {a} AND c < {b} THEN '{name}'" for a, b, name in readers.COLOUR_BINS)


@query(f"""SELECT object_id, round(ra, 6) AS x, round(dec, 6) AS y, CASE WHEN c IS NULL THEN 'Unknown' {STAR_BINS} ELSE 'Unknown' END AS class_label FROM (
SELECT object_id, (x + 0.5e0) * 360 AS ra, y * 90 AS dec, CASE WHEN object_id % 13 <> 0 THEN round(y * 20, 2) END AS c FROM {EMBED_SQL} WHERE object_id % 7 <> 0)""")
def read_stars_csv(spark, d):
    """The embedding's plane as a sky: no magnitude in every seventh row, no colour in every thirteenth."""
    stars = embed(spark, d).select(
        F.col("object_id").alias("source_id"), ((F.col("x") + 0.5) * 360).alias("ra"), (F.col("y") * 90).alias("dec"), F.when(F.col("object_id") % 7 != 0, 12.5).alias("phot_g_mean_mag"),
        F.when(F.col("object_id") % 13 != 0, F.round(F.col("y") * 20, 2)).alias("bp_rp"),
    )
    found = readers.stars_csv(spark, rewritten(spark, stars, "csv", header=True))
    return found.select("object_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "class_label")


PAID = " ".join(f"WHEN object_id % 8 = {k} THEN '{name}'" for k, name in readers.PAYMENTS.items())


@query(f"""SELECT round(lon, 6) AS x, round(lat, 6) AS y, CASE {PAID} ELSE 'unknown' END AS class_label, object_id % 5 AS rate_code FROM (
SELECT object_id, -75.2e0 + x / {EVENTS.width!r}e0 * 2.4e0 AS lon, 39.9e0 + y / {EVENTS.height!r}e0 * 2 AS lat FROM {EVENTS_SQL}) WHERE lon BETWEEN -75 AND -73 AND lat BETWEEN 40 AND 41.5""")
def read_trips_parquet(spark, d):
    trips = events(spark, d).select(
        (F.lit(-75.2) + F.col("x") / EVENTS.width * 2.4).alias("Pickup_Longitude"), (F.lit(39.9) + F.col("y") / EVENTS.height * 2).alias("Pickup_Latitude"),
        (F.col("object_id") % 8).cast("int").alias("payment_type"), (F.col("object_id") % 5).cast("double").alias("RatecodeID"),
    )
    found = readers.trips_parquet(spark, rewritten(spark, trips, "parquet"))
    return found.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "class_label", "rate_code")
