"""Training-order materialisation: fixed-length token sequences, a keyed permutation, fixed-stride shards.

A document's tokens are the ids of a column array<int>, of 1, 2 or 4 bytes each, or the UTF-8 bytes of a text; the
largest id marks the end and the padding (255 never occurs in UTF-8). They are cut into sequences of a fixed number of tokens.
Sequences are numbered densely; a keyed Feistel network over the next power of four, walked until it lands below the number
of sequences, gives each its slot, so the order needs no shuffle buffer, no sort and no state. Rows are dealt
to tasks by ranges of slots and written in slot order; shard = slot // stride, row = slot % stride, so a reader
that stopped at a slot opens one shard and goes on. Every row has the same number of bytes.

Numbering: documents are dealt to blocks by the hash of id and tokens; the blocks' offsets are running sums over groups of blocks and
inside each; a window inside each block numbers its documents in order of id, size and hash. No text is moved for it, nothing
is gathered on the driver, and the plan is the same at every size: texts, compressed, meet their numbers by sort and merge.

Cases: a null or empty text has one sequence, of end marks only. Rows of one id have places of their own, the longer first, then
by hash; rows of one id and one text are written as often as they occur. Null ids are numbered like any other and, being
dealt by hash with their texts, do not meet in one task. An empty table gives no sequences. Other columns are left out, so
names cannot clash. Very long texts are cut whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import mix, named, saved, shared_dir, slices, utf8

LENGTH, STRIDE = 2048, 4096
ROUNDS = 6
#: Documents that a numbering block holds, about, and blocks in a group of blocks.
BLOCK_DOCS, GROUP_BLOCKS = 20_000, 1_000
#: Copies of one row that one task cuts, at most; more are dealt out again.
COPIES = 1_000
#: Bytes that a task sorts and writes, at most about.
TASK_BYTES = 256 << 20
#: Sequences that a task hands on at a time.
ROWS = 1_024
KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def permuted(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot in [0, total) of each index in [0, total): a Feistel network with cycle-walking; a bijection for each key."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(total)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(sizes: DataFrame) -> tuple[DataFrame, int]:
    """((a, b, copies, n, first: the index of its first sequence) for each of sizes (id, a, b, bytes, n, copies), number of sequences)."""
    docs, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0))).first()
    blocks = max(1, -(-docs // BLOCK_DOCS))
    dealt = sizes.withColumn("block", F.pmod("a", F.lit(blocks)))
    before = lambda by, order: F.sum("own").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(0).cast("long")
    per_block = dealt.groupBy("block").agg(F.sum(F.col("n") * F.col("copies")).alias("own")).withColumn("group", F.expr(f"block div {GROUP_BLOCKS}"))
    per_block = per_block.withColumn("in_group", F.coalesce(before(["group"], ["block"]), none))
    per_group = per_block.groupBy("group").agg(F.sum("own").alias("own"))  # a row for each GROUP_BLOCKS * BLOCK_DOCS documents
    per_group = per_group.select("group", F.coalesce(before([], ["group"]), none).alias("start"))
    starts = per_block.join(per_group, "group").select("block", (F.col("start") + F.col("in_group")).alias("start"))
    within = dealt.withColumn("own", F.col("n") * F.col("copies"))
    within = within.withColumn("before", F.coalesce(before(["block"], ["id", F.desc("bytes"), "a", "b"]), none))
    return within.join(starts, "block").select("a", "b", "copies", "n", (F.col("start") + F.col("before")).alias("first")), total


def sequences(
    df: DataFrame, key: str = "doc_id", tokens: str = "text", length: int = LENGTH, seed: int = 20_240_601, width: int = 1
) -> tuple[DataFrame, int]:
    """((slot, id, part, n_tokens, tokens binary of exactly length * width bytes, low byte first), number of sequences), not yet in
    order. tokens is a text, of width 1, or a column array<int> of ids below 256 ** width - 1."""
    column = df.schema[tokens].dataType
    of_ids = isinstance(column, T.ArrayType)
    if width not in KINDS or (not of_ids and width != 1):
        raise ValueError("ids take 1, 2 or 4 bytes each, the bytes of a text 1")
    size = length * width
    t = F.coalesce(named(tokens), F.array().cast(column) if of_ids else F.lit(""))
    long = F.size(t).cast("long") * width if of_ids else F.octet_length(t).cast("long")
    rows = df.select(named(key).alias("id"), t.alias("t"), long.alias("bytes"))
    rows = rows.select("id", "t", "bytes", F.xxhash64("id", "t", F.lit(1)).alias("a"), F.xxhash64("t", "id", F.lit(2)).alias("b"))
    n = F.expr(f"bytes div {size}") + 1  # with room for one end mark
    sizes = saved(rows.drop("t").groupBy("a", "b").agg(F.first("id").alias("id"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies")).withColumn("n", n), "sizes")
    places, total = numbered(sizes)
    id_type = rows.schema["id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            raw = [np.array(x, np.int64).astype(KINDS[width]).tobytes() for x in part.column(1).to_pylist()] if of_ids else utf8(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([press.compress(x) for x in raw], pa.binary())], names=["id", "a", "b", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()

        def made(ids: list, index: list[np.ndarray], parts: list[np.ndarray], pieces: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
            columns = [
                pa.array(permuted(np.concatenate(index), total, seed)), pa.array(ids, kind), pa.array(np.concatenate(parts), pa.int32()),
                pa.array([len(x) // width for x in pieces], pa.int32()), pa.array([x.ljust(size, b"\xff") for x in pieces], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "id", "part", "n_tokens", "tokens"])

        for part in slices(batches):
            kind = part.column(0).type
            ids, index, parts, out = [], [], [], []
            for i, z, first, begin, copies in zip(*[part.column(k).to_pylist() for k in range(5)], strict=True):
                raw = unpress.decompress(z)
                n = len(raw) // size + 1
                for copy in range(begin, min(begin + COPIES, copies)):
                    for at in range(0, n, ROWS):
                        some = [raw[k * size : (k + 1) * size] for k in range(at, min(at + ROWS, n))]
                        ids += [i] * len(some)
                        parts.append(np.arange(at, at + len(some)))
                        index.append(parts[-1] + first + copy * n)
                        out += some
                        if len(out) >= ROWS:
                            yield made(ids, index, parts, out, kind)
                            ids, index, parts, out = [], [], [], []
            if out:
                yield made(ids, index, parts, out, kind)

    small = T.StructType([id_type, *[T.StructField(c, T.LongType()) for c in "ab"], T.StructField("z", T.BinaryType())])
    texts = rows.select("id", "t", "a", "b").mapInArrow(packed, small).groupBy("a", "b").agg(F.first("id").alias("id"), F.first("z").alias("z"))
    met = texts.join(places.hint("merge"), ["a", "b"]).select("id", "z", "first", F.lit(0).cast("long").alias("begin"), "copies")
    schema = T.StructType([T.StructField("slot", T.LongType()), id_type, T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    made = met.mapInArrow(cut, schema)
    if sizes.where(F.col("copies") > COPIES).limit(1).count():  # further copies of rows that are very often there, a run of them a task
        more = met.where(F.col("copies") > COPIES).withColumn("begin", F.explode(F.sequence(F.lit(COPIES).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
        made = made.unionByName(more.repartition("first", "begin").mapInArrow(cut, schema))
    return made, total


def write_shards(rows: DataFrame, total: int, path: str, stride: int = STRIDE, row_bytes: int = LENGTH) -> None:
    """Writes rows in slot order, one folder per shard. Each task has a range of whole shards, TASK_BYTES of them or less unless one shard is
    larger, so a task does not grow with the corpus; a failed task is run again whole."""
    shards = max(1, -(-total // stride))
    tasks = min(shards, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * row_bytes // TASK_BYTES)))
    shard = F.expr(f"slot div {stride}")
    dealt = rows.withColumn("shard", shard).withColumn("row", F.expr(f"cast(slot % {stride} as int)"))
    dealt = dealt.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)"))
    dealt.sortWithinPartitions("shard", "row").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int = 0, stride: int = STRIDE) -> DataFrame:
    """The rows from slot on; only shards that hold them are opened. Read in order shard by shard, row by row."""
    rows = spark.read.parquet(path).withColumn("shard", F.col("shard").cast("long"))
    return rows.where((F.col("shard") > slot // stride) | ((F.col("shard") == slot // stride) & (F.col("row") >= slot % stride)))


def materialised(
    df: DataFrame, key: str = "doc_id", tokens: str = "text", length: int = LENGTH, stride: int = STRIDE, seed: int = 20_240_601, width: int = 1
) -> tuple[str, int]:
    """Writes all sequences of df to new shards in the shared folder; returns their path and number."""
    rows, total = sequences(df, key, tokens, length, seed, width)
    path = f"{shared_dir(df.sparkSession)}/training-{uuid.uuid4().hex}"
    write_shards(rows, total, path, stride, length * width)
    return path, total


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per sequence, from the shards as written: slot, shard, row, doc_id, part, n_tokens and the digest of its tokens."""
    path, total = materialised(df, key, text)
    if not total:
        return df.sparkSession.createDataFrame([], f"slot long, shard long, row int, {key} long, part int, n_tokens int, tokens_sha256 string")
    return read_from(df.sparkSession, path).select(
        "slot", "shard", "row", F.col("id").alias(key), "part", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256")
    )
