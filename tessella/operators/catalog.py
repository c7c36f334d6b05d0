"""A catalog of stored layouts that outlives the session: versions, what each was made from, and a new version when that has changed."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import keys
from tessella.functions.grid import GridSpec
from tessella.operators import layout
from tessella.operators.select import with_keys
from tessella.sources.shared import files_of, removed

ENTRY = "name string, layout string, version int, path string, made_of string, settings string, schema string, classes string, n_objects long, n_files long, bytes long, seconds double, at double, dropped boolean"


def fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """Of the files that df reads: their paths, sizes and times of change. A file that is added, rewritten or removed changes it."""
    return hashlib.sha256(json.dumps(files_of(spark, sorted(set(df.inputFiles())))).encode()).hexdigest()


@dataclass
class LayoutCatalog:
    """Entries are rows of JSON files in root/entries, appended and never rewritten, so writers in different sessions do not lose
    each other's; layouts are folders beside them. Of entries with one name and layout the highest version counts."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self._known: dict[tuple[str, str], dict] = {}

    def entries(self) -> DataFrame:
        """All versions, one row each; a dropped version is shown as dropped."""
        if not files_of_or_none(self.spark, f"{self.root}/entries"):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).json(f"{self.root}/entries")
        last = rows.groupBy("name", "layout", "version").agg(F.max(F.struct("dropped", *[c.split()[0] for c in ENTRY.split(", ") if not c.startswith(("name ", "layout ", "version ", "dropped "))])).alias("e"))
        return last.select("name", "layout", "version", "e.*").select(*[c.split()[0] for c in ENTRY.split(", ")])

    def current(self, name: str, kind: str) -> dict | None:
        """The highest version that is not dropped."""
        best = self.entries().where((F.col("name") == name) & (F.col("layout") == kind) & ~F.col("dropped")).orderBy(F.desc("version")).first()
        return best.asDict() if best else None

    def _append(self, entry: dict) -> None:
        self.spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("append").json(f"{self.root}/entries")

    def ensure(self, name: str, kind: str, objects: Callable[[], DataFrame], spec: GridSpec, buckets: int = 1, **options) -> layout.Stored:
        """The stored layout of objects() under that name: as it is if it was made from the same files with the same grid, buckets and options,
        else written anew as the next version. Versions before it stay until they are dropped, as queries may still read them."""
        df = objects()
        made_of = fingerprint(self.spark, df)
        settings = json.dumps({"spec": asdict(spec), "buckets": buckets, "options": options}, sort_keys=True)
        entry = self._known.get((name, kind))
        if entry is None or (entry["made_of"], entry["settings"]) != (made_of, settings):
            entry = self.current(name, kind)
        if entry is None or (entry["made_of"], entry["settings"]) != (made_of, settings):
            entry = self._written(name, kind, df, spec, buckets, options, made_of, settings, entry)
        self._known[name, kind] = entry
        return layout.Stored(entry["path"], T.StructType.fromJson(json.loads(entry["schema"])), json.loads(entry["classes"]), entry["n_objects"])

    def _written(self, name: str, kind: str, df: DataFrame, spec: GridSpec, buckets: int, options: dict, made_of: str, settings: str, before: dict | None) -> dict:
        began = time.time()
        version = (before["version"] if before else 0) + 1
        path = f"{self.root}/{name}-{kind}-{version}-{uuid.uuid4().hex[:12]}"
        enum = {r["class_label"]: r["code"] for r in keys.class_enum(df).collect()}  # one row per class
        layout.write(with_keys(df, spec, enum, buckets), path, kind, order=spec.order, buckets=buckets, **options)
        rows = self.spark.read.parquet(path)
        files = files_of(self.spark, [path])
        entry = {
            "name": name, "layout": kind, "version": version, "path": path, "made_of": made_of, "settings": settings, "schema": rows.schema.json(), "classes": json.dumps(enum),
            "n_objects": rows.count(), "n_files": len(files), "bytes": sum(f[1] for f in files), "seconds": round(time.time() - began, 3), "at": began, "dropped": False,
        }
        self._append(entry)
        return entry

    def drop(self, name: str, kind: str, keep: int = 1) -> list[int]:
        """Removes all but the highest keep versions, with their folders; their numbers."""
        own = self.entries().where((F.col("name") == name) & (F.col("layout") == kind) & ~F.col("dropped")).orderBy(F.desc("version")).collect()  # a row for each version
        for row in own[keep:]:
            self._append({**row.asDict(), "dropped": True})
            removed(self.spark, row["path"])
        self._known.pop((name, kind), None)
        return [row["version"] for row in own[keep:]]


def files_of_or_none(spark: SparkSession, path: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files_of(spark, [path]) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else []


class LoadedDatasets:
    """Datasets that were loaded, with their kind, numbers of groups and objects, time and notes: rows of JSON in root/datasets; the
    latest of a name counts."""

    FIELDS = "name string, kind string, n_groups long, n_objects long, at double, notes map<string, string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def register(self, name: str, kind: str, df: DataFrame, notes: dict[str, str] | None = None) -> None:
        """Counts df's groups and objects in one pass and notes them."""
        n = df.agg(F.countDistinct("group_id"), F.count(F.lit(1))).first()
        self.spark.createDataFrame([(name, kind, n[0], n[1], time.time(), notes or {})], self.FIELDS).coalesce(1).write.mode("append").json(f"{self.root}/datasets")

    def datasets(self) -> DataFrame:
        if not files_of_or_none(self.spark, f"{self.root}/datasets"):
            return self.spark.createDataFrame([], self.FIELDS)
        rows = self.spark.read.schema(self.FIELDS).json(f"{self.root}/datasets")
        fields = ["kind", "n_groups", "n_objects", "at", "notes"]
        return rows.groupBy("name").agg(F.max_by(F.struct(*fields), "at").alias("d")).select("name", "d.*")
