"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Of spark.checkpoint.dir or setCheckpointDir(). Only local mode, where one machine is all there is, makes its own."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessella-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of all files at or below the paths, sorted; whatever the file system. Names that begin with _ or . are left out."""
    out = []
    for p in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName()[0] not in "_.":
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)
