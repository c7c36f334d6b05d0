"""Readers: each gives (object_id, group_id, x, y, class_label, area, ...) from one kind of file, rejecting rows without finite coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.grid import valid

Bins = list[tuple[float, float, str]]


def _id(*parts: str) -> Column:
    return F.xxhash64(*parts)


def numbered_ids(df: DataFrame, *parts: str) -> DataFrame:
    """df with object_id from the hash of its parts; the same for any file split and order. Equal rows are numbered among themselves,
    so each has an id of its own, and which of them has which does not matter."""
    own = df.withColumn("_h", _id(*parts))
    nth = F.row_number().over(Window.partitionBy("_h", *parts).orderBy("_h"))
    return own.withColumn("_k", nth).withColumn("object_id", F.when(F.col("_k") == 1, F.col("_h")).otherwise(F.xxhash64("_h", "_k"))).drop("_h", "_k")


def polygons_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Nuclei with polygon vertices: x, y are the mean of the vertices, area is pixels times squared resolution, the perimeter a square's.
    Empty and null polygons are rejected. Vertex fields are named (``, _1) or (x, y)."""
    df = spark.read.parquet(path)
    vertex = df.schema["Polygon"].dataType.elementType.names
    total = lambda f: F.aggregate(F.transform("Polygon", lambda v: v[f].cast("double")), F.lit(0.0), lambda a, b: a + b)
    mpp = F.coalesce(F.col("mpp").cast("double"), F.lit(1.0)) if "mpp" in df.columns else F.lit(1.0)
    df = df.where(F.size(F.coalesce("Polygon", F.array().cast(df.schema["Polygon"].dataType))) > 0)
    out = df.select(
        F.col("case_id").alias("group_id"), F.try_divide(total(vertex[0]), F.size("Polygon")).alias("x"), F.try_divide(total(vertex[1]), F.size("Polygon")).alias("y"), F.coalesce(F.col("type"), F.lit("unknown")).alias("class_label"),
        F.concat_ws("_", F.col("tile_minx").cast("long"), F.col("tile_miny").cast("long")).alias("tile_id"), (F.col("AreaInPixels").cast("double") * mpp * mpp).alias("area"),
    )
    return numbered_ids(valid(out).withColumn("perimeter", F.sqrt("area") * 4), "group_id", "x", "y", "area", "class_label")


def polygons_csv(spark: SparkSession, path: str, group: str, label: str = "nucleus") -> DataFrame:
    """Lines "area,physical,x0:y0:x1:y1:..."; blank lines, the header, short lines and fewer than four coordinates are skipped, bad pairs within a line too."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("Area")).select(F.split("value", ",", 3).alias("f")).where(F.size("f") == 3)
    values = F.expr("transform(split(trim(BOTH '\" ' FROM get(f, 2)), ':'), v -> try_cast(v AS double))")
    return _pairs(lines, group, label, values)


def _pairs(lines: DataFrame, group: str, label: str, values: Column) -> DataFrame:
    rows = lines.select(F.expr("try_cast(get(f, 0) AS double)").alias("area"), values.alias("v")).where(F.size("v") >= 4)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda i: F.struct(F.get("v", i * 2).alias("x"), F.get("v", i * 2 + 1).alias("y")))
    good = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = rows.withColumn("p", good).where(F.size("p") > 0)
    mean = lambda c: F.try_divide(F.aggregate("p", F.lit(0.0), lambda a, b: a + b[c]), F.size("p"))
    out = rows.select(F.lit(group).alias("group_id"), mean("x").alias("x"), mean("y").alias("y"), F.lit(label).alias("class_label"), "area")
    return numbered_ids(valid(out).withColumn("perimeter", F.sqrt("area") * 4), "group_id", "x", "y", "area", "class_label")


def cells_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cells by tissue, with a header: image_id, tissue_type, nucleus_id, category, centroid_x, centroid_y, area, perimeter."""
    schema = "image_id string, tissue_type string, nucleus_id long, category string, centroid_x double, centroid_y double, area double, perimeter double"
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    out = df.select(F.col("tissue_type").alias("group_id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("category").alias("class_label"), "area", "perimeter", "image_id", "nucleus_id")
    return valid(out).withColumn("object_id", _id("image_id", "nucleus_id", "x", "y"))


#: Colour bins of stars: fixed values, half-open.
COLOUR_BINS: Bins = [(-1.0, 0.0, "O/B"), (0.0, 0.5, "A"), (0.5, 1.0, "F"), (1.0, 1.5, "G"), (1.5, 2.5, "K"), (2.5, 10.0, "M")]


def binned(value: Column, bins: Bins, default: str = "Unknown") -> Column:
    """The first half-open bin that holds the value."""
    out = F.lit(default)
    for low, high, name in reversed(bins):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def stars_csv(spark: SparkSession, path: str, dataset: str = "stars", bins: Bins = COLOUR_BINS) -> DataFrame:
    """Stars, with a header; rows without a numeric source_id, ra, dec or magnitude are rejected, a missing colour is Unknown."""
    df = spark.read.csv(path, header=True)
    colour = F.expr("coalesce(try_cast(bp_rp AS double), try_cast(phot_bp_mean_mag AS double) - try_cast(phot_rp_mean_mag AS double))" if "phot_bp_mean_mag" in df.columns else "try_cast(bp_rp AS double)")
    out = df.select(
        F.expr("try_cast(source_id AS bigint)").alias("object_id"), F.lit(dataset).alias("group_id"), F.expr("try_cast(ra AS double)").alias("x"), F.expr("try_cast(dec AS double)").alias("y"),
        F.expr("try_cast(phot_g_mean_mag AS double)").alias("mag"), colour.alias("bp_rp"),
    )
    return valid(out.dropna(subset=["object_id", "mag"])).withColumn("class_label", binned(F.col("bp_rp"), bins)).withColumn("area", F.lit(0.0))


def poi_records(spark: SparkSession, path: str, dataset: str = "poi") -> DataFrame:
    """A JSON list of {osm_id, lon, lat, category, name}; one row per id, the smallest category and name where copies differ."""
    df = spark.read.schema("osm_id long, lon double, lat double, category string, name string").json(path, multiLine=True)
    one = df.groupBy("osm_id").agg(F.min(F.struct("category", "name", "lon", "lat")).alias("r"))
    return valid(one.select(F.col("osm_id").alias("object_id"), F.lit(dataset).alias("group_id"), F.col("r.lon").alias("x"), F.col("r.lat").alias("y"), F.col("r.category").alias("class_label"), F.col("r.name").alias("name"), F.lit(0.0).alias("area")))


def map_elements(spark: SparkSession, path: str, tags: list[str], dataset: str = "poi") -> DataFrame:
    """A map server's answer: elements with lat, lon or a center, and tags. The class is "tag:value" of the first wanted tag; one row per id."""
    place = "struct<lat:double,lon:double>"
    df = spark.read.schema(f"elements array<struct<type:string,id:bigint,lat:double,lon:double,center:{place},tags:map<string,string>>>").json(path, multiLine=True)
    e = df.select(F.explode("elements").alias("e"))
    label = F.coalesce(*[F.when(F.col("e.tags")[t].isNotNull(), F.concat(F.lit(f"{t}:"), F.col("e.tags")[t])) for t in tags])
    out = e.select(F.col("e.id").alias("object_id"), F.lit(dataset).alias("group_id"), F.coalesce("e.lon", "e.center.lon").alias("x"), F.coalesce("e.lat", "e.center.lat").alias("y"), label.alias("class_label"), F.col("e.tags")["name"].alias("name"))
    rest = ["class_label", "name", "x", "y", "group_id"]
    one = out.where("class_label IS NOT NULL").groupBy("object_id").agg(F.min(F.struct(*rest)).alias("r"))  # the least where copies differ
    return valid(one.select("object_id", *[F.col(f"r.{c}").alias(c) for c in rest])).withColumn("area", F.lit(0.0))


#: Payment codes of taxi trips: fixed values.
PAYMENTS = {1: "credit", 2: "cash", 3: "no_charge", 4: "dispute", 5: "unknown", 6: "voided"}


def trips_parquet(spark: SparkSession, path: str, zones: DataFrame | None = None, dataset: str = "trips", box: tuple[float, float, float, float] = (-75.0, 40.0, -73.0, 41.5), fallback: tuple[float, float] = (-73.98, 40.75)) -> DataFrame:
    """Trips with pickup coordinates or, failing these, pickup zones looked up in zones (zone, x, y). Columns are found by name;
    coordinates outside the box or zero are rejected."""
    df = spark.read.parquet(path)
    lower = {c.lower(): c for c in df.columns}
    first = lambda *parts: next((c for low, c in lower.items() if all(p in low for p in parts)), None)
    code = F.col(first("payment")).cast("string") if first("payment") else F.lit("")
    label = F.lit("unknown")
    for k, name in PAYMENTS.items():
        label = F.when(code == str(k), name).otherwise(label)
    rate = F.col(first("ratecode")).cast("long") if first("ratecode") else F.lit(None).cast("long")
    extra = [label.alias("class_label"), rate.alias("rate_code")]
    if first("pickup", "lon"):
        out = df.select(F.col(first("pickup", "lon")).cast("double").alias("x"), F.col(first("pickup", "lat")).cast("double").alias("y"), *extra)
    elif first("pulocation") and zones is not None:
        out = df.select(F.col(first("pulocation")).cast("long").alias("zone"), *extra).join(zones.select("zone", "x", "y"), "zone", "left").fillna({"x": fallback[0], "y": fallback[1]}).drop("zone")
    else:
        raise ValueError("neither pickup coordinates nor zones")
    out = valid(out).where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]) & (F.col("x") != 0))
    out = out.select(F.lit(dataset).alias("group_id"), "x", "y", "class_label", "rate_code", F.lit(0.0).alias("area"))
    return numbered_ids(out, "group_id", "x", "y", "class_label", "rate_code")


def box_tiles(west: float, south: float, east: float, north: float, per_side: int) -> list[tuple[float, float, float, float]]:
    """A box cut into per_side x per_side boxes, row by row."""
    dx, dy = (east - west) / per_side, (north - south) / per_side
    return [(west + i * dx, south + j * dy, west + (i + 1) * dx, south + (j + 1) * dy) for j in range(per_side) for i in range(per_side)]
