"""Physical layouts as Parquet folders, their catalog, and writes that replace whole partitions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import keys
from tessella.functions.grid import GridSpec, valid
from tessella.operators.joins import fresh, last_changes
from tessella.operators.select import with_keys
from tessella.sources.shared import removed, shared_dir

#: Folders and sort of each layout: (partition columns, sort columns).
LAYOUTS = {
    "mono": ([], []),
    "mono_clustered": ([], ["h_key"]),
    "grouped": (["group_id"], []),
    "grouped_clustered": (["group_id"], ["h_key"]),
    "two_level": (["group_id", "bucket"], ["h_key"]),
    "two_level_z": (["group_id", "z_bucket"], ["z_key"]),
    "covering": ([], ["group_id", "c_key"]),
    "by_class": (["group_id", "class_label"], ["h_key"]),
}
COVERING = ["group_id", "c_key", "object_id", "x", "y", "class_label", "area"]


def write(df: DataFrame, path: str, layout: str, files: int | None = None, order: int = 8, buckets: int = 1, row_group_mb: int = 32) -> None:
    """Writes df in a layout. Sorted layouts are range-partitioned on the folders and the sort key, so a large group is spread over
    many tasks and a file holds one run of keys, which row-group statistics then skip."""
    folders, sort = LAYOUTS[layout]
    if layout == "two_level_z":
        df = df.withColumn("z_bucket", keys.bucket_column(F.col("z_key"), buckets, order))
    if layout == "covering":
        df = df.select(*[c for c in COVERING if c in df.columns])
    if folders or sort:
        by = [*folders, *(sort or ["object_id"])]
        df = (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*folders, *sort)
    writer = df.write.mode("overwrite").option("parquet.block.size", row_group_mb << 20)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def with_budget(df: DataFrame, allocation: DataFrame, order: int) -> DataFrame:
    """df with bucket from each group's own number of buckets (group_id, buckets)."""
    met = df.drop("bucket").join(allocation.select("group_id", F.col("buckets").alias("_b")), "group_id", "left")
    return met.withColumn("bucket", keys.bucket_column(F.col("h_key"), F.coalesce("_b", F.lit(1)), order)).drop("_b")


@dataclass
class Catalog:
    """What a router needs: per group the number of objects and of buckets."""

    table: DataFrame

    @classmethod
    def of(cls, df: DataFrame) -> Catalog:
        return cls(df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_objects"), F.countDistinct("bucket").alias("n_buckets")))

    def stats(self) -> DataFrame:
        return self.table.agg(
            F.count(F.lit(1)).alias("n_groups"), F.sum("n_buckets").alias("n_buckets"), F.avg("n_buckets").alias("mean"), F.min("n_buckets").alias("min"), F.max("n_buckets").alias("max")
        )

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").json(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(spark.read.schema("group_id string, n_objects long, n_buckets long").json(path))


def append(df: DataFrame, path: str, layout: str, spec: GridSpec, enum: dict[str, int], buckets: int = 1) -> None:
    """Adds new objects (object_id, group_id, x, y, class_label, ...) to a stored layout: rows without finite coordinates are
    rejected, keys and buckets computed, the new files sorted like the others. Existing files are not touched."""
    folders, sort = LAYOUTS[layout]
    keyed = with_keys(valid(df), spec, enum, buckets)
    if layout == "two_level_z":
        keyed = keyed.withColumn("z_bucket", keys.bucket_column(F.col("z_key"), buckets, spec.order))
    stored = df.sparkSession.read.parquet(path)
    keyed = keyed.select(*[F.col(f.name).cast(f.dataType) if f.name in keyed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields])
    if folders or sort:
        keyed = keyed.repartitionByRange(*folders, *(sort or ["object_id"])).sortWithinPartitions(*folders, *sort)
    writer = keyed.write.mode("append")
    (writer.partitionBy(*folders) if folders else writer).parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def replace_partitions(spark: SparkSession, new: DataFrame, path: str, folders: list[str]) -> None:
    """Replaces the folders that new has rows for, and no others. New rows are staged first, as they usually come from the same
    files, and the stage is removed at the end. A job that dies while folders are exchanged can be run again from its stage, which is
    then still there."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    new.write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    removed(spark, staged)
    spark.catalog.refreshByPath(path)


def update_classes(spark: SparkSession, path: str, changes: DataFrame, enum: dict[str, int], folders: list[str] = ["group_id", "bucket"], version: str | None = None) -> None:  # noqa: B006
    """Point updates of classes (group_id, bucket, object_id, class_label): only the folders they touch are rewritten, composite
    keys too. Of several changes of one object last_changes tells which counts."""
    table = spark.read.parquet(path)
    by = [*folders, "object_id"]
    to, found = fresh(table, "_to"), fresh(table, "_found")
    one = last_changes(changes, by, "class_label", version).withColumnRenamed("class_label", to).withColumn(found, F.lit(True))
    touched = table.join(one.select(*folders).distinct(), folders, "left_semi")
    changed = touched.join(one, by, "left").withColumn(found, F.coalesce(found, F.lit(False)))
    new = changed.withColumn("class_label", F.when(F.col(found), F.col(to)).otherwise(F.col("class_label")))
    new = new.withColumn("c_key", F.when(F.col(found), keys.composite(keys.class_code(F.col("class_label"), enum), keys.composite_low(F.col("c_key")))).otherwise(F.col("c_key")))
    replace_partitions(spark, new.select(*table.columns), path, folders)


@dataclass
class Stored:
    """A layout in the shared folder: where it is, its rows, classes and number of objects."""

    path: str
    schema: T.StructType
    enum: dict[str, int]
    n_objects: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


#: Catalogs of this process, by application and folder; what they list is in their folders.
_CATALOGS: dict[tuple[str, str], object] = {}


def kept(spark: SparkSession, layout: str, name: str, objects, spec: GridSpec, buckets: int = 1, root: str | None = None, **options) -> Stored:
    """A layout in the catalog at root (the shared folder's, unless given), written from objects() on first use, and again when the source's files,
    the grid, the buckets or the options differ."""
    from tessella.operators.catalog import LayoutCatalog

    place = root or f"{shared_dir(spark)}/layouts"
    catalog = _CATALOGS.setdefault((spark.sparkContext.applicationId, place), LayoutCatalog(spark, place))
    return catalog.ensure(name, layout, objects, spec, buckets, **options)


def split_bucket(spark: SparkSession, path: str, group: str, bucket: int, first_new: int, low: int, high: int) -> None:
    """Splits a stored bucket of keys [low, high) at their middle: the upper half moves to the bucket first_new, a new folder; no other folder changes."""
    table = spark.read.parquet(path).where((F.col("group_id") == group) & (F.col("bucket") == bucket))
    parted = table.withColumn("bucket", F.when(F.col("h_key") >= (low + high) // 2, first_new).otherwise(bucket))
    replace_partitions(spark, parted, path, ["group_id", "bucket"])
