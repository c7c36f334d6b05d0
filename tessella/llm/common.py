"""Helpers shared by the text operators: tables, the shared folder, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
WORD_BREAK = " \t\n\x0b\x0c\r"
#: Rows that Python code handles at a time, whatever the size of the Arrow batch that holds them.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: of spark.checkpoint.dir or of setCheckpointDir(). None set is an error, as a
    folder of one machine's own would lose data on a cluster; in local mode one machine is all there is."""
    context = spark.sparkContext
    checkpoint = context._jsc.sc().getCheckpointDir()
    if checkpoint.isDefined():
        return checkpoint.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessella-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """The rows rows of df with the smallest hashes of their values: the same on each run, never more. Twice as many are chosen
    by the hash alone before they are ordered, so that the tasks keep few; equal rows count each."""
    total = df.count()
    if total <= rows:
        return df
    hashed = df.withColumn("__order", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)), F.lit(1 << 40)))
    few = hashed.where(F.col("__order") < min(1 << 40, int(2 * (rows + 64) / total * (1 << 40))))
    return few.orderBy("__order").limit(rows).drop("__order")


def named(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def rows_without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose key is not in the only column of gone. Rows with a null key stay and take no part in the
    join, so that they never meet in one task; other columns pass through, whatever their names."""
    id = fresh(df, "id")
    own = df.withColumn(id, named(key).cast("long"))
    kept = own.where(named(id).isNotNull()).join(gone.toDF(id).distinct(), id, "left_anti")
    order = [named(c) for c in df.columns]
    return kept.select(*order).unionByName(own.where(named(id).isNull()).select(*order))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept between rows up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = self.of(word)
        if len(self) >= self.bound:
            self.clear()
        self[word] = value
        return value

    def of(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width items; a shorter input has one run, of all its items, an empty one none."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[k : n - width + 1 + k]
    return mix(total + np.uint64(width))
