"""Line deduplication with a sharded minimal perfect hash over distinct line hashes.

Pass 1 hashes each document's distinct line keys (128 bits) and counts documents per key, pre-aggregated
before the shuffle. Keys found in two documents or more (one document cannot repeat itself) are dealt to shards by hash; each
shard becomes one row with a minimal perfect hash and three compact arrays in its order: fingerprints (the other 64 bits of
the hash), document counts and the largest doc_id. Pass 2 packs the documents' key hashes by shard. A shard's packs come to
tasks in which its arrays, sorted before them, are loaded once and probed by one pack after another: fingerprint, count and largest doc_id decide;
lines are never joined. A shard that many probes ask for is sent to as many tasks as they need. The hits (doc_id, line hash) return to their documents, which drop those lines.

A very common line would send a probe of every document to one shard. Keys of at least HOT_DOCS documents and of at least
one in HOT_KEYS of all probes, so HOT_KEYS keys at most (some 300 KB), have an index of the same form of their own, which every
task holds and probes in place. So no key that travels has more than a small, fixed share of the probes. A shard holds
about SHARD_KEYS keys at any size.

Cases: a null or empty text is one empty line and stays; keys are compared by 128-bit hashes, and keys that share
their first 64 bits stand apart in their shard; rows with the same doc_id are one document for "the largest doc_id" and count
apart for the number of documents; a null doc_id is smaller than any other and, where no other holds the key,
drops nothing; rows with a null doc_id take no part in the join, so they never meet. Other columns pass through, whatever
their names; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import WORD_BREAK, fresh, mix, named, saved, slices, utf8

SHARD_KEYS = 20_000
HOT_KEYS, HOT_DOCS = 10_000, 1_000
STRIPPED = WORD_BREAK.encode()
#: Slots of a level of the minimal perfect hash per key that is left.
SPARE = 2.0
#: Probes of a shard that one task takes, about; probes that a task packs at a time.
TASK_PROBES, PACK_PROBES = 100_000, 100_000


def long_keys(text: bytes, least: int) -> dict[bytes, bytes]:
    """The 16-byte hashes of the lines' keys of at least least code points, by line."""
    found = {}
    for line in text.split(b"\n"):
        if len(line) >= least and line not in found:
            key = line.strip(STRIPPED).lower()
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                found[line] = xxhash.xxh3_128_digest(key)
    return found


class PerfectHash:
    """A minimal perfect hash in levels: a key takes the slot of the first level in which no other key has it."""

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> list[np.ndarray]:
        """One array of packed bits per level; keys are distinct."""
        levels = []
        while len(keys):
            size = max(64, int(len(keys) * SPARE) // 8 * 8 + 8)
            at = cls.slots(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            keys = keys[~alone[at]]
        return levels

    @classmethod
    def find(cls, levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        """The place of each key; a key that was not built in has any place or -1."""
        place, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(levels):
            taken = np.unpackbits(bits)
            rank = np.cumsum(taken) - 1
            at = cls.slots(keys[left], level, len(taken))
            here = taken[at] == 1
            place[left[here]] = before + rank[at[here]]
            left, before = left[~here], before + int(taken.sum())
        return place


@dataclass
class Shard:
    """The index of some keys (a, b): a perfect hash of their first halves, and arrays in its order. Of keys with one first
    half all but one are twins: their first halves are listed, and their values follow those of the others."""

    levels: list[np.ndarray]
    prints: np.ndarray
    counts: np.ndarray
    largest: np.ndarray
    twins: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray, largest: np.ndarray) -> Shard:
        order = np.lexsort((b, a))
        a, b, n, largest = a[order], b[order], n[order], largest[order]
        twin = np.concatenate([[False], a[1:] == a[:-1]]) if len(a) else np.zeros(0, bool)
        keys = a[~twin].view(np.uint64)
        levels = PerfectHash.build(keys)
        place = PerfectHash.find(levels, keys)

        def arranged(values: np.ndarray, kind: type) -> np.ndarray:
            out = np.empty(len(values), kind)
            out[place], out[len(keys) :] = values[~twin], values[twin]
            return out

        return cls(levels, arranged(b, np.int64), arranged(n, np.int64), arranged(largest, np.int64), a[twin])

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key in the arrays, or -1."""
        place = PerfectHash.find(self.levels, a.view(np.uint64))
        place[(place >= 0) & (self.prints[place] != b)] = -1
        if len(self.twins):
            first = len(self.prints) - len(self.twins)
            for k in np.flatnonzero((place < 0) & np.isin(a, self.twins)):
                same = np.flatnonzero((self.twins == a[k]) & (self.prints[first:] == b[k]))
                place[k] = first + same[0] if len(same) else -1
        return place

    def lost(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, least_docs: int) -> np.ndarray:
        """Whether the document that probes for a key loses its lines."""
        if not len(self.prints):
            return np.zeros(len(a), bool)
        place = self.probe(a, b)
        return (place >= 0) & (self.counts[place] >= least_docs) & (self.largest[place] != ids)

    def row(self) -> tuple[list[bytes], bytes, bytes, bytes, bytes]:
        return [x.tobytes() for x in self.levels], self.prints.tobytes(), self.counts.tobytes(), self.largest.tobytes(), self.twins.tobytes()

    @classmethod
    def of_row(cls, levels: list[bytes], *arrays: bytes) -> Shard:
        return cls([np.frombuffer(x, np.uint8) for x in levels], *[np.frombuffer(x, np.int64) for x in arrays])


ARRAYS = ["levels", "prints", "counts", "largest", "twins"]
INDEX = "shard long, levels array<binary>, prints binary, counts binary, largest binary, twins binary"


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard become one row for each shard; a shard may span batches."""
    kept: list[pa.RecordBatch] = []

    def made(part: pa.Table) -> pa.RecordBatch:
        row = Shard.build(*[part.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n_docs", "largest")]).row()
        values = [[part.column("shard")[0].as_py()], *[[x] for x in row]]
        kinds = [pa.int64(), pa.list_(pa.binary()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", *ARRAYS])

    for batch in batches:
        while batch.num_rows:
            shard = batch.column("shard").to_numpy()
            if kept and kept[-1].column("shard")[0].as_py() != shard[0]:
                yield made(pa.Table.from_batches(kept))
                kept = []
            end = int(np.searchsorted(shard, shard[0], "right"))
            kept.append(batch.slice(0, end))
            batch = batch.slice(end)
    if kept:
        yield made(pa.Table.from_batches(kept))


def _hashes(text: bytes, least_chars: int) -> np.ndarray:
    """The distinct hashes of a text's keys, a row (a, b) each."""
    return np.frombuffer(b"".join(sorted(set(long_keys(text, least_chars).values()))), np.int64).reshape(-1, 2)


def line_index(df: DataFrame, key: str, text: str, least_chars: int, least_docs: int) -> tuple[DataFrame, int, int, Shard]:
    """(rows of INDEX, number of shards, tasks for the probes of each, index of the hot keys) for the keys found in two documents or more."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [_hashes(t, least_chars) for t in utf8(part.column(1))]
            ids = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
            both = np.concatenate([np.empty((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "a", "b"])

    lines = df.select(named(key).cast("long").alias("id"), named(text).alias("text")).mapInArrow(hashes, "id long, a long, b long")
    counted = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("largest"))
    often = saved(counted.where((F.col("n_docs") >= min(2, least_docs)) & F.col("largest").isNotNull()), "lines")
    keys, probes = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    is_hot = F.col("n_docs") >= max(HOT_DOCS, -(-probes // HOT_KEYS))
    rows = [tuple(r) for r in often.where(is_hot).select("a", "b", "n_docs", "largest").collect()]  # HOT_KEYS rows at most
    hot = Shard.build(*np.array(rows, np.int64).reshape(-1, 4).T.copy())
    shards = max(1, -(-keys // SHARD_KEYS))
    dealt = often.where(~is_hot).withColumn("shard", F.pmod(F.col("a"), F.lit(shards)))
    index = dealt.repartition("shard").sortWithinPartitions("shard", "a").mapInArrow(_build_shards, INDEX)
    parts = max(-(-probes // shards // TASK_PROBES), -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    return saved(index, "line-index"), shards, parts, hot


def hits(df: DataFrame, index: DataFrame, shards: int, parts: int, hot: Shard, key: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """(id, lines): the 16-byte hashes of the lines that each document loses, but those of hot keys."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        shard, part = rows[:, 1] % shards, (rows[:, 0] & 0x7FFFFFFF) % parts
        to = shard * parts + part
        order = np.argsort(to, kind="stable")
        names, starts = np.unique(to[order], return_index=True)
        rows = rows[order]
        packs = [rows[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(rows)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names // parts), pa.array(names % parts), pa.array(packs, pa.binary())], names=["shard", "part", "pack"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 1024):
            ids = part.column(0).to_numpy()
            found = [_hashes(t, least_chars) for t in utf8(part.column(1))]
            both = np.concatenate([np.empty((0, 2), np.int64), *found])
            of = np.repeat(ids, [len(f) for f in found])
            if len(hot.prints) and len(both):
                cold = hot.probe(both[:, 0].copy(), both[:, 1].copy()) < 0
                both, of = both[cold], of[cold]
            held.append(np.column_stack([of, both]))
            size += len(both)
            if size >= PACK_PROBES:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for part in slices(batches, 64):
            names = part.column("shard").to_pylist()
            for k, pack in enumerate(part.column("pack").to_pylist()):
                if pack is None:
                    at, shard = names[k], Shard.of_row(*[part.column(c)[k].as_py() for c in ARRAYS])
                elif at == names[k]:  # a shard without arrays has no keys
                    probes = np.frombuffer(pack, np.int64).reshape(-1, 3)
                    gone = probes[shard.lost(probes[:, 1].copy(), probes[:, 2].copy(), probes[:, 0], least_docs)]
                    yield pa.RecordBatch.from_arrays([pa.array(gone[:, 0]), pa.array([x.tobytes() for x in gone[:, 1:]], pa.binary())], names=["id", "line"])

    given = df.select(named(key).cast("long").alias("id"), named(text).alias("text")).where(F.col("id").isNotNull())
    kinds = {f.name: f.dataType for f in index.schema.fields}
    packs = given.mapInArrow(packed, "shard long, part long, pack binary").select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ARRAYS])
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(None).cast("binary").alias("pack"), *ARRAYS)
    both = packs.unionByName(arrays).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("pack").isNotNull())
    found = both.mapInArrow(probed, "id long, line binary")
    return found.groupBy("id").agg(F.collect_set("line").alias("lines"))


def deduplicated(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, counts: tuple[str, str] | None = None
) -> DataFrame:
    """df with text without the lost lines; with counts also the numbers of lines (before) and of those dropped, under these names."""
    index, shards, parts, hot = line_index(df, key, text, least_chars, least_docs)
    lost = hits(df, index, shards, parts, hot, key, text, least_chars, least_docs)
    id, lines = fresh(df, "id"), fresh(df, "lines")
    own = df.withColumn(id, named(key).cast("long"))
    given = own.where(named(id).isNotNull()).join(lost.toDF(id, lines), id, "left")
    order = [*[named(c) for c in df.columns], named(id), named(lines)]
    met = given.select(*order).unionByName(own.where(named(id).isNull()).withColumn(lines, F.lit(None).cast("array<binary>")).select(*order))
    names = df.columns
    schema = df.schema
    for name in counts or ():
        schema = T.StructType([*schema.fields, T.StructField(name, T.LongType())])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = [part.column(k) for k in range(len(names))]
            at = names.index(text)
            texts, before, dropped = [], [], []
            for t, i, lost in zip(utf8(columns[at]), part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                before.append(t.count(b"\n") + 1)
                gone = set(lost or ())
                if len(hot.prints) and i is not None:
                    own = _hashes(t, least_chars)
                    gone |= {x.tobytes() for x in own[hot.lost(own[:, 0].copy(), own[:, 1].copy(), np.full(len(own), i), least_docs)]}
                if gone:
                    keys = long_keys(t, least_chars)
                    left = [x for x in t.split(b"\n") if keys.get(x) not in gone]
                    dropped.append(before[-1] - len(left))
                    t = b"\n".join(left)
                else:
                    dropped.append(0)
                texts.append(t)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            numbers = [pa.array(before, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=schema.names)

    return met.mapInArrow(rewritten, schema)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = deduplicated(df.select(key, text), key, text, counts=("n_lines", "n_dropped"))
    return out.select(key, "n_lines", "n_dropped", F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256"))
