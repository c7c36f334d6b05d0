"""The spatial queries over the given tables, seen as objects, and equivalent DuckDB SQL.

The SQL uses plain coordinate predicates, so that a wrong curve could not agree with itself; curve keys are checked
against a recursive query of the published recurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import curves, keys
from tessella.functions.grid import GridSpec
from tessella.operators import aggregate, joins, labels, layout, select
from tessella.plans import learned
from tessella.plans import ranges as R
from tessella.streaming import monitor

EVENTS = GridSpec(2_592_000.0, 600.0)
LINES = GridSpec(105_000.0, 2_500.0)
EMBED = GridSpec(1.0, 1.0, x_origin=-0.5, y_origin=-0.5)
BUCKETS = 30
RECT = (300_000.0, 100.0, 1_200_000.0, 300.0)
WIDE = (200_000.0, 10.0, 2_000_000.0, 200.0)
LINE_RECT = (20_000.0, 500.0, 45_000.0, 1_100.0)
EMBED_RECT = (-0.05, -0.10, 0.10, 0.05)
SEEDS = [(400_000.0, 50.0), (1_000_000.0, 20.0), (1_900_000.0, 80.0), (700_000.0, 200.0), (2_300_000.0, 10.0)]
SEED_NAMES = ["p", "q", "r"]

EVENTS_SQL = """(SELECT event_id AS object_id, 'g' || (user_id % 4) AS group_id,
  CAST(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS DOUBLE) / 1e6 AS x, CAST(value AS DOUBLE) AS y, event_type AS class_label,
  CAST(value AS DOUBLE) AS area FROM events)"""
LINES_SQL = """(SELECT l_orderkey, l_linenumber, l_returnflag AS group_id, CAST(l_extendedprice AS DOUBLE) AS x,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS y, l_linestatus AS class_label, CAST(l_quantity AS DOUBLE) AS area FROM lineitem)"""
EMBED_SQL = """(SELECT vec_id AS object_id, 'e' || (vec_id % 2) AS group_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 'c' || label AS class_label FROM embeddings)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.expr("cast(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) as double) / 1e6")
    return df.select(
        F.col("event_id").alias("object_id"), F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("group_id"), seconds.alias("x"),
        F.col("value").cast("double").alias("y"), F.col("event_type").alias("class_label"), F.col("value").cast("double").alias("area"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("group_id"), F.col("l_extendedprice").cast("double").alias("x"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"), F.col("l_linestatus").alias("class_label"),
        F.col("l_quantity").cast("double").alias("area"),
    )


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(
        F.col("vec_id").alias("object_id"), F.concat(F.lit("e"), (F.col("vec_id") % 2).cast("string")).alias("group_id"), F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_label"),
    )


def enum_of(df: DataFrame) -> dict[str, int]:
    return {r["class_label"]: r["code"] for r in keys.class_enum(df).collect()}  # one row per class


def keyed(df: DataFrame, spec: GridSpec, enum: dict[str, int] | None = None) -> DataFrame:
    return select.with_keys(df, spec, enum_of(df) if enum is None else enum, BUCKETS)


SHOWN = ["object_id", "x", "y", "class_label"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def between(rect) -> str:
    return f"x BETWEEN {rect[0]} AND {rect[2]} AND y BETWEEN {rect[1]} AND {rect[3]}"


VIEWPORT = f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g0' AND {between(RECT)}"


@query(VIEWPORT)
def viewport_exact(spark, d):
    return select.viewport(events(spark, d), RECT, "g0").select(*SHOWN)


@query(VIEWPORT)
def viewport_pruned(spark, d):
    return select.viewport_pruned(keyed(events(spark, d), EVENTS, {}), EVENTS, RECT, "g0", buckets=BUCKETS, stored=False).select(*SHOWN)


@query(VIEWPORT)
def viewport_morton(spark, d):
    return select.viewport_pruned(keyed(events(spark, d), EVENTS, {}), EVENTS, RECT, "g0", curve="morton", stored=False).select(*SHOWN)


def named_after(table: str, d: str) -> str:
    """A layout's name for a table of a folder."""
    return f"{table}-{zlib.crc32(d.encode()):08x}"


def stored_events(spark, d, kind: str = "two_level") -> layout.Stored:
    """The events as a stored layout, written once in a session; queries then read folders, files and row groups that can matter."""
    return layout.kept(spark, kind, named_after("events", d), lambda: events(spark, d), EVENTS, BUCKETS)


@query(VIEWPORT)
def viewport_stored(spark, d):
    """By bucket folders and pushed key ranges."""
    return select.viewport_pruned(stored_events(spark, d).read(spark), EVENTS, RECT, "g0", buckets=BUCKETS).select(*SHOWN)


@query(f"SELECT count(*) AS n FROM {LINES_SQL} WHERE group_id = 'A' AND {between(LINE_RECT)}")
def viewport_count(spark, d):
    return select.viewport(lines(spark, d), LINE_RECT, "A").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT object_id, x, y, class_label FROM {EMBED_SQL} WHERE {between(EMBED_RECT)}")
def viewport_all_groups(spark, d):
    return select.viewport_pruned(keyed(embed(spark, d), EMBED, {}), EMBED, EMBED_RECT, stored=False).select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g1' AND class_label IN ('click', 'view', 'purchase') AND {between(WIDE)} ORDER BY object_id LIMIT 500")
def viewport_class_in(spark, d):
    """The class-filtered rectangle with its limit of 500, in a total order."""
    return select.viewport(events(spark, d), WIDE, "g1", ["click", "view", "purchase"]).select(*SHOWN).orderBy("object_id").limit(500)


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g1' AND class_label IN ('click', 'purchase') AND {between(WIDE)}")
def covering_exact(spark, d):
    df = events(spark, d)
    enum = enum_of(df)
    return select.covering(keyed(df, EVENTS, enum), EVENTS, WIDE, ["click", "purchase"], enum, "g1", stored=False).select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g1' AND class_label IN ('click', 'purchase') AND {between(WIDE)}")
def covering_stored(spark, d):
    """By pushed ranges of the composite key over narrow rows sorted by it."""
    kept = stored_events(spark, d, "covering")
    return select.covering(kept.read(spark), EVENTS, WIDE, ["click", "purchase"], kept.enum, "g1").select(*SHOWN)


COVER_CELLS = " OR ".join(f"(h BETWEEN {a} AND {b - 1})" for a, b in R.key_ranges(EVENTS, WIDE))


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g1' AND class_label = 'click' AND {between(WIDE)}")
def covering_other_order(spark, d):
    df = events(spark, d)
    enum = enum_of(df)
    return select.covering(keyed(df, EVENTS, enum), EVENTS, WIDE, ["click"], enum, "g1", order=5, stored=False).select(*SHOWN)


def hilbert_sql(source: str, columns: str, cell_x: str, cell_y: str, order: int = 8) -> str:
    """The published recurrence as a recursive query: rotate by quadrant, from the highest bit down."""
    return f"""
WITH RECURSIVE walk AS (
  SELECT {columns}, {cell_x} AS hx, {cell_y} AS hy, CAST(0 AS BIGINT) AS h, CAST({1 << (order - 1)} AS BIGINT) AS s FROM {source}
  UNION ALL
  SELECT {", ".join(c.split(" AS ")[-1] for c in columns.split(", "))},
         CASE WHEN (hy & s) > 0 THEN hx WHEN (hx & s) > 0 THEN s - 1 - hy ELSE hy END,
         CASE WHEN (hy & s) > 0 THEN hy WHEN (hx & s) > 0 THEN s - 1 - hx ELSE hx END,
         h + s * s * xor(CASE WHEN (hx & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (hy & s) > 0 THEN 1 ELSE 0 END), s // 2
  FROM walk WHERE s > 0
)"""


def _cell(v: str, origin: float, extent: float, n: int = 256) -> str:
    return f"CAST(least(greatest(trunc(({v} - {origin}) * {n} / {extent}), 0), {n - 1}) AS BIGINT)"


EVENT_KEYS = hilbert_sql(EVENTS_SQL, "object_id, group_id, x, y, class_label", _cell("x", 0.0, EVENTS.width), _cell("y", 0.0, EVENTS.height))


@query(f"""{EVENT_KEYS}, hits AS (SELECT * FROM walk WHERE s = 0 AND class_label = 'click' AND ({COVER_CELLS}))
SELECT count(*) AS n_cover, count(*) FILTER (WHERE NOT ({between(WIDE)})) AS n_outside,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE NOT ({between(WIDE)})) / count(*), 6) ELSE 0.0 END AS fp_rate FROM hits""")
def covering_fp_rate(spark, d):
    kept = stored_events(spark, d, "covering")
    return select.false_positives(select.covering(kept.read(spark), EVENTS, WIDE, ["click"], kept.enum, exact=False), WIDE)


POINT = (1_000_000.0, 50.0)
KNN = f"SELECT object_id, sqrt((x - {POINT[0]}) * (x - {POINT[0]}) + (y - {POINT[1]}) * (y - {POINT[1]})) AS dist FROM {EVENTS_SQL}"


@query(f"SELECT object_id, round(dist, 6) AS dist FROM ({KNN} WHERE group_id = 'g2' ORDER BY dist, object_id LIMIT 50)")
def knn(spark, d):
    return select.knn(events(spark, d), *POINT, 50, "g2").withColumn("dist", F.round("dist", 6))


@query(f"SELECT object_id, round(dist, 6) AS dist FROM ({KNN} ORDER BY dist, object_id LIMIT 200)")
def knn_all_groups(spark, d):
    return select.knn(events(spark, d), *POINT, 200).withColumn("dist", F.round("dist", 6))


@query(f"SELECT object_id, round(dist * dist, 3) AS dist_sq FROM ({KNN} WHERE group_id = 'g2' ORDER BY dist, object_id LIMIT 25)")
def knn_sq(spark, d):
    return select.knn(events(spark, d), *POINT, 25, "g2", squared=True).withColumn("dist_sq", F.round("dist_sq", 3))


EMBED_KNN = "sqrt((x - 0.02) * (x - 0.02) + (y + 0.01) * (y + 0.01))"


@query(f"SELECT object_id, round(dist, 9) AS dist FROM (SELECT object_id, {EMBED_KNN} AS dist FROM {EMBED_SQL} ORDER BY dist, object_id LIMIT 25)")
def knn_rings(spark, d):
    return select.knn_rings(keyed(embed(spark, d), EMBED, {}), EMBED, 0.02, -0.01, 25, stored=False).withColumn("dist", F.round("dist", 9))


@query(f"SELECT object_id, round(dist, 9) AS dist FROM (SELECT object_id, {EMBED_KNN} AS dist FROM {EMBED_SQL} ORDER BY dist, object_id LIMIT 25)")
def knn_rings_stored(spark, d):
    """Rings over a stored layout; the first is sized by the catalog's number of objects."""
    kept = layout.kept(spark, "two_level", named_after("embed", d), lambda: embed(spark, d), EMBED, BUCKETS)
    first = select.first_ring(EMBED, 25, kept.n_objects)
    return select.knn_rings(kept.read(spark), EMBED, 0.02, -0.01, 25, first=first, buckets=BUCKETS).withColumn("dist", F.round("dist", 9))


TILE = "CAST(CAST(floor(x / 256) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 256) AS BIGINT) AS VARCHAR)"


@query(f"SELECT {TILE} AS tile_id, class_label, count(*) AS n FROM {EVENTS_SQL} WHERE group_id = 'g0' GROUP BY 1, 2")
def tile_class_counts(spark, d):
    return aggregate.tile_class_counts(keyed(events(spark, d), EVENTS, {}).where("group_id = 'g0'"))


@query(f"SELECT {TILE} AS tile_id, count(*) AS n FROM {LINES_SQL} GROUP BY 1")
def tile_counts(spark, d):
    return aggregate.tile_counts(keyed(lines(spark, d), LINES, {}))


@query(f"SELECT class_label, count(*) AS n, round(avg(area), 6) AS avg_area, round(stddev_samp(area), 6) AS sd_area FROM {EVENTS_SQL} WHERE {between(WIDE)} GROUP BY 1")
def class_area_stats(spark, d):
    return aggregate.class_area_stats(select.viewport(events(spark, d), WIDE))


@query(f"SELECT class_label, count(*) AS n, ((2000 * count(*) + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ())) / 10 AS pct FROM {EVENTS_SQL} GROUP BY 1")
def class_share(spark, d):
    return aggregate.class_share(events(spark, d))


@query(f"SELECT class_label, n, row_number() OVER (ORDER BY n DESC, class_label) - 1 AS code FROM (SELECT class_label, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1)")
def class_enum(spark, d):
    return keys.class_enum(events(spark, d))


@query(f"SELECT group_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM {EVENTS_SQL} GROUP BY 1")
def group_extent(spark, d):
    return aggregate.extent(events(spark, d))


@query(f"""SELECT group_id, count(*) AS n_tiles, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS sd_n, max(n) AS max_n, min(n) AS min_n,
round(sum(n) * 1e6 / (count(*) * 256.0 * 256.0), 6) AS per_million FROM (SELECT group_id, floor(x / 256) AS tx, floor(y / 256) AS ty, count(*) AS n FROM {LINES_SQL} GROUP BY 1, 2, 3) GROUP BY 1""")
def density_stats(spark, d):
    return aggregate.density_stats(lines(spark, d))


@query(f"{EVENT_KEYS} SELECT object_id, h AS h_key FROM walk WHERE s = 0")
def hilbert_encode(spark, d):
    return keyed(events(spark, d), EVENTS, {}).select("object_id", "h_key")


@query(f"SELECT object_id, {_cell('x', -0.5, 1.0)} AS cell_x, {_cell('y', -0.5, 1.0)} AS cell_y FROM {EMBED_SQL}")
def hilbert_decode_roundtrip(spark, d):
    return curves.with_hilbert_cell(keyed(embed(spark, d), EMBED, {}), F.col("h_key"), EMBED.order).select("object_id", "cell_x", "cell_y")


MORTON_BITS = " + ".join(f"(((cx >> {i}) & 1) << {2 * i + 1}) + (((cy >> {i}) & 1) << {2 * i})" for i in range(8))


@query(f"SELECT object_id, {MORTON_BITS} AS z_key FROM (SELECT object_id, {_cell('x', -0.5, 1.0)} AS cx, {_cell('y', -0.5, 1.0)} AS cy FROM {EMBED_SQL})")
def morton_encode(spark, d):
    return keyed(embed(spark, d), EMBED, {}).select("object_id", "z_key")


@query(f"""SELECT object_id, cx AS cell_x, cy AS cell_y FROM (SELECT object_id, {_cell('x', -0.5, 1.0)} AS cx, {_cell('y', -0.5, 1.0)} AS cy FROM {EMBED_SQL})""")
def morton_decode_roundtrip(spark, d):
    cx, cy = curves.morton_cell(F.col("z_key"))
    return keyed(embed(spark, d), EMBED, {}).select("object_id", cx.alias("cell_x"), cy.alias("cell_y"))


ENUM_SQL = f"(SELECT class_label, row_number() OVER (ORDER BY count(*) DESC, class_label) - 1 AS code FROM {EVENTS_SQL} GROUP BY 1)"


@query(f"{EVENT_KEYS} SELECT object_id, (code << 48) | h AS c_key, code AS class_code, h AS low FROM walk JOIN {ENUM_SQL} USING (class_label) WHERE s = 0")
def composite_key(spark, d):
    out = keyed(events(spark, d), EVENTS)
    return out.select("object_id", "c_key", keys.composite_code(F.col("c_key")).alias("class_code"), keys.composite_low(F.col("c_key")).alias("low"))


@query(f"{EVENT_KEYS} SELECT group_id, CAST(h * {BUCKETS} // 65536 AS INTEGER) AS bucket, count(*) AS n FROM walk WHERE s = 0 GROUP BY 1, 2")
def bucket_histogram(spark, d):
    return keyed(events(spark, d), EVENTS, {}).groupBy("group_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


MID = (1_296_000.0, 35.0)


@query(f"""{EVENT_KEYS} SELECT object_id, class_label, (code << 48) | h AS c_key FROM (
  SELECT object_id, h, CASE WHEN x < {MID[0]} AND y < {MID[1]} THEN 'a' WHEN y < {MID[1]} THEN 'b' WHEN x < {MID[0]} THEN 'c' ELSE 'd' END AS class_label FROM walk WHERE s = 0)
JOIN (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) AS e(class_label, code) USING (class_label)""".replace("(code << 48)", "(CAST(code AS BIGINT) << 48)"))
def relabel_quadrant(spark, d):
    names = ["a", "b", "c", "d"]
    return labels.relabelled(keyed(events(spark, d), EVENTS), labels.quadrant(*MID, names), {n: i for i, n in enumerate(names)}).select("object_id", "class_label", "c_key")


SEED_DISTANCES = ", ".join(f"(x - {x}) * (x - {x}) + (y - {y}) * (y - {y})" for x, y in SEEDS)


@query(f"SELECT object_id, ['p', 'q', 'r', 'p', 'q'][list_position(ds, list_min(ds))] AS class_label FROM (SELECT object_id, [{SEED_DISTANCES}] AS ds FROM {EVENTS_SQL})")
def relabel_voronoi(spark, d):
    return labels.voronoi(events(spark, d), SEEDS, SEED_NAMES).select("object_id", "class_label")


@query(f"""SELECT e.object_id, o.s_suppkey AS rect_id FROM {EVENTS_SQL} e JOIN supplier o
ON e.x BETWEEN (o.s_suppkey % 26) * 100000.0 AND (o.s_suppkey % 26) * 100000.0 + 20000.0 AND e.y BETWEEN (o.s_suppkey % 50) * 2.0 AND (o.s_suppkey % 50) * 2.0 + 3.0""")
def range_join(spark, d):
    o = spark.read.parquet(f"{d}/supplier.parquet")
    rects = o.selectExpr("s_suppkey AS rect_id", "(s_suppkey % 26) * 100000.0D AS x0", "(s_suppkey % 26) * 100000.0D + 20000.0D AS x1", "(s_suppkey % 50) * 2.0D AS y0", "(s_suppkey % 50) * 2.0D + 3.0D AS y1")
    return joins.range_join(events(spark, d), rects, 20_000.0)


@query(f"""SELECT a.object_id AS left_id, b.object_id AS right_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist
FROM {EMBED_SQL} a JOIN {EMBED_SQL} b ON abs(a.x - b.x) <= 0.02 AND a.group_id = 'e0' AND b.group_id = 'e1' AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02""")
def distance_join(spark, d):
    e = embed(spark, d)
    return joins.distance_join(e.where("group_id = 'e0'"), e.where("group_id = 'e1'"), 0.02).withColumn("dist", F.round("dist", 6))


@query(f"{EVENT_KEYS} SELECT group_id, CAST(h * {BUCKETS} // 65536 AS INTEGER) AS bucket, count(*) AS hits, round(median(y), 6) AS median_ms FROM walk WHERE s = 0 GROUP BY 1, 2 ORDER BY hits DESC, group_id, bucket LIMIT 10")
def hot_buckets(spark, d):
    log = keyed(events(spark, d), EVENTS, {}).withColumn("ms", F.col("y"))
    return monitor.hot(monitor.bucket_hits(log).withColumn("median_ms", F.round("median_ms", 6)), 10)


@query(f"""SELECT class_label, count(y) AS n, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.95), 6) AS p95, round(quantile_cont(y, 0.99), 6) AS p99,
round(stddev_samp(y) / avg(y), 6) AS cv FROM {EVENTS_SQL} GROUP BY 1""")
def latency_stats(spark, d):
    out = aggregate.latency_stats(events(spark, d), ["class_label"], "y")
    return out.select("class_label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "cv")])


@query(f"""SELECT round(regr_slope(y, x), 12) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 9) AS r2, round(sum(x * y) / sum(x * x), 9) AS slope_origin FROM {LINES_SQL}""")
def linear_fit(spark, d):
    r = aggregate.linear_fit(lines(spark, d), "x", "y")
    return r.select(F.round("slope", 12).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"), F.round("slope_origin", 9).alias("slope_origin"))


@query(f"""SELECT group_id, round(max(greatest(hi - v, v - lo)), 9) AS ks FROM (SELECT group_id, v, cume_dist() OVER (PARTITION BY group_id ORDER BY v) AS hi,
(rank() OVER (PARTITION BY group_id ORDER BY v) - 1) / count(*) OVER (PARTITION BY group_id) AS lo FROM (SELECT group_id, x / {EVENTS.width} AS v FROM {EVENTS_SQL})) GROUP BY 1""")
def ks_uniform(spark, d):
    return aggregate.ks_uniform(events(spark, d).withColumn("v", F.col("x") / EVENTS.width), "v").withColumn("ks", F.round("ks", 9))


@query(f"""WITH c AS (SELECT group_id, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, group_id) AS pos, count(*) OVER () AS k FROM c)
SELECT role, group_id, n FROM (SELECT 'largest' AS role, group_id, n FROM r WHERE pos = 1 UNION ALL SELECT 'upper_quartile', group_id, n FROM r WHERE pos = k // 4 + 1
UNION ALL SELECT 'median', group_id, n FROM r WHERE pos = k // 2 + 1 UNION ALL SELECT 'smallest', group_id, n FROM r WHERE pos = k)""")
def representative_groups(spark, d):
    return aggregate.representative_groups(events(spark, d))


@query(f"""SELECT u FROM (SELECT sum(r) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2 AS u FROM (
SELECT class_label = 'click' AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS r FROM {EVENTS_SQL}))""")
def mann_whitney(spark, d):
    return aggregate.mann_whitney(events(spark, d).withColumn("a", F.col("class_label") == "click"), "y", "a").select("u")


@query(f"SELECT object_id, x, y, class_label FROM {EMBED_SQL} WHERE {between(EMBED_RECT)} AND group_id = 'e0'")
def learned_viewport(spark, d):
    """A rectangle through the learned curve: ranges of the mapped rectangle, then the exact test."""
    df = embed(spark, d).where("group_id = 'e0'")
    model = learned.train(df, 65)
    m = model.first()
    found = learned.learned_ranges(EMBED_RECT, m["xs"], m["ys"])
    return learned.with_learned_key(df, model).where(select.in_ranges("l_key", found, stored=False) & select.in_rect(EMBED_RECT)).select(*SHOWN)


@query(f"SELECT object_id, x, y, class_label FROM {EVENTS_SQL} WHERE group_id = 'g1' AND class_label = 'click' AND {between(WIDE)}")
def covering_finer_order(spark, d):
    """A cover walked on a finer grid than that of the stored keys."""
    kept = stored_events(spark, d, "covering")
    return select.covering(kept.read(spark), EVENTS, WIDE, ["click"], kept.enum, "g1", order=10).select(*SHOWN)


CHANGED = "CASE WHEN object_id % 10 = 0 AND group_id = 'g0' THEN 'view' ELSE class_label END"
CHANGED_CODES = f"(SELECT class_label AS l, row_number() OVER (ORDER BY count(*) DESC, class_label) - 1 AS code FROM {EVENTS_SQL} GROUP BY 1)"


@query(f"{EVENT_KEYS} SELECT object_id, {CHANGED} AS class_label, (code << 48) | h AS c_key FROM walk JOIN {CHANGED_CODES} ON l = {CHANGED} WHERE s = 0")
def update_classes(spark, d):
    """Each tenth object of a group becomes a view, each change given twice: the folders they are in are rewritten."""
    df = events(spark, d)
    enum = enum_of(df)
    path = f"{layout.shared_dir(spark)}/updated-{layout.uuid.uuid4().hex}"
    layout.write(keyed(df, EVENTS, enum), path, "two_level")
    hit = spark.read.parquet(path).where("group_id = 'g0' AND object_id % 10 = 0").select("group_id", "bucket", "object_id")
    changes = hit.withColumn("class_label", F.explode(F.array(F.lit("click"), F.lit("view")))).withColumn("at", F.when(F.col("class_label") == "view", 2).otherwise(1))
    layout.update_classes(spark, path, changes, enum, version="at")
    return spark.read.parquet(path).select("object_id", "class_label", "c_key")


@query(f"{EVENT_KEYS} SELECT object_id, group_id, CAST(h * {BUCKETS} // 65536 AS INTEGER) AS bucket, h AS h_key FROM walk WHERE s = 0")
def append(spark, d):
    """Half of the objects written as a layout, the others added to it."""
    df = events(spark, d)
    enum = enum_of(df)
    path = f"{layout.shared_dir(spark)}/appended-{layout.uuid.uuid4().hex}"
    layout.write(keyed(df.where("object_id % 2 = 0"), EVENTS, enum), path, "two_level")
    layout.append(df.where("object_id % 2 = 1"), path, "two_level", EVENTS, enum, BUCKETS)
    return spark.read.parquet(path).select("object_id", "group_id", "bucket", "h_key")


@query(f"""SELECT group_id, n FROM (SELECT group_id, n, row_number() OVER (ORDER BY n DESC, group_id) - 1 AS pos, count(*) OVER () AS k
FROM (SELECT group_id, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1)) WHERE pos % greatest(1, k // 3) = 0 AND pos // greatest(1, k // 3) < 3""")
def stride_sample(spark, d):
    return aggregate.stride_sample(events(spark, d), 3)


@query(f"SELECT group_id, round(max(x) * 1.05, 6) AS width, round(max(y) * 1.05, 6) AS height FROM {EVENTS_SQL} GROUP BY 1")
def padded_dims(spark, d):
    return aggregate.padded_dims(events(spark, d)).select("group_id", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query(f"SELECT class_label, list_extract(list_sort(list(y)), least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1) AS q FROM {EVENTS_SQL} GROUP BY 1")
def index_percentile(spark, d):
    return aggregate.index_percentile(events(spark, d), ["class_label"], "y", 0.95)


@query(f"SELECT object_id, x, y FROM {EVENTS_SQL} WHERE ((object_id + 7) % 2147483648 * 2654435761) % 4294967296 < 429496729")
def stable_sample(spark, d):
    """About a tenth of the objects; the sample is the feature."""
    return aggregate.stable_sample(events(spark, d), 0.1, seed=7).select("object_id", "x", "y")


INCLUSIVE = GridSpec(EVENTS.width, EVENTS.height, mode="inclusive")


@query(f"""SELECT object_id, CAST(least(greatest(trunc(x / {EVENTS.width} * 255), 0), 255) AS BIGINT) AS cell_x,
CAST(least(greatest(trunc(y / {EVENTS.height} * 255), 0), 255) AS BIGINT) AS cell_y FROM {EVENTS_SQL}""")
def inclusive_cells(spark, d):
    cx, cy = INCLUSIVE.columns(F.col("x"), F.col("y"))
    return events(spark, d).select("object_id", cx.alias("cell_x"), cy.alias("cell_y"))


MORTON_SWAPPED = " + ".join(f"(((cy >> {i}) & 1) << {2 * i + 1}) + (((cx >> {i}) & 1) << {2 * i})" for i in range(8))


@query(f"SELECT object_id, {MORTON_SWAPPED} AS z_key FROM (SELECT object_id, {_cell('x', -0.5, 1.0)} AS cx, {_cell('y', -0.5, 1.0)} AS cy FROM {EMBED_SQL})")
def morton_y_first(spark, d):
    cx, cy = EMBED.columns(F.col("x"), F.col("y"))
    return embed(spark, d).select("object_id", curves.morton_column(cx, cy, x_first=False).alias("z_key"))


@query(f"""{EVENT_KEYS}, b AS (SELECT group_id, CAST(h * {BUCKETS} // 65536 AS INTEGER) AS bucket, count(*) AS n FROM walk WHERE s = 0 GROUP BY 1, 2),
big AS (SELECT *, row_number() OVER (ORDER BY n DESC, group_id, bucket) AS pos FROM b)
SELECT group_id, bucket, 'split' AS advice FROM big WHERE pos <= 10 AND n > 1.5 * (SELECT sum(n) / count(*) FROM b)""")
def split_advice(spark, d):
    """The hottest buckets, here those with most objects, that hold over one and a half times the mean."""
    sized = keyed(events(spark, d), EVENTS, {}).withColumn("ms", F.lit(1.0)).select("group_id", "bucket", "ms")
    hits = sized.groupBy("group_id", "bucket").agg(F.count(F.lit(1)).alias("hits"))
    mean = hits.agg(F.sum("hits") / F.count(F.lit(1))).first()[0] or 0
    return monitor.advice(sized, hits, mean, 10).where("advice = 'split'")


@query(f"""SELECT a.object_id, CASE WHEN a.object_id % 7 = 0 THEN 'changed' ELSE a.class_label END AS class_label FROM {EVENTS_SQL} a""")
def update_join(spark, d):
    """New classes by a join; repeated changes of one object count once."""
    df = events(spark, d)
    changes = df.where("object_id % 7 = 0").select("object_id", F.explode(F.array(F.lit("changed"), F.lit("before"))).alias("class_label"))
    return joins.updated(df, changes, "object_id", "class_label").select("object_id", "class_label")
