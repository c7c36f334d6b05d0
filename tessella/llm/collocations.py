"""Phrase collocations per language from count tries of depth 3.

Each task counts runs of one to three words of its texts in tries of at most SHARD_WORDS words each. A trie is kept as its nodes in
preorder, which is the sorted order of their paths: for each node its depth, last word and count. It is cut at
the ends of prefix ranges of the whole corpus and serialised; each range's pieces, sorted runs, are merged in one task.
Ranges begin at any path, so even the followers of one word or one pair of words are spread over tasks; a piece that begins inside a subtree
also brings its shard's counts of the one or two nodes above, so that a walk down the merged trie reads the counts of
every left part. Right parts come by suffix links: each pair of words is linked to its last word, each triple to its last
pair and through it to its last word. Only nodes of LEAST occurrences or more leave the merge, as all parts of a candidate have that many.

The cuts are the paths at evenly spread places in the texts, about CUT_SAMPLES for a range; they balance the work and do not alter any count. The driver
holds these and a range has RANGE_BYTES of text or less, so they are small beside the corpus. The best phrases of a language are chosen within
PARTS parts of its candidates first, then among those.

Cases: a null or empty text has no words; a null language counts as 'und', the empty one as itself. Words hold any characters but space, tab and the
marks that end pieces, and are compared as UTF-8 bytes. Very long texts are taken TEXT_BYTES at a time without a break between. Repeated rows count as
often as they occur; equal scores go by count, then by phrase. An empty table gives no rows. Other columns are left out, so names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import named, saved, slices, utf8

LEAST, TOP = 10, 2_000
#: A phrase goes if a longer candidate that holds it has so many hundredths of its occurrences.
INSIDE = 50
UNKNOWN = "und"
#: Words of a task's tries before they are cut and sent on; ranks of words fit in BITS bits.
SHARD_WORDS, BITS = 600_000, 21
RANGE_BYTES, CUT_SAMPLES = 32 << 20, 16
TEXT_BYTES, PARTS = 1 << 18, 64
#: Nodes that are merged at a time.
BLOCK_NODES = 400_000
#: Letters in lower case, the marks that end a piece as line feeds, tabs as spaces.
MARKS = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
Path = tuple[str, bytes, bytes, bytes]


class Ids(dict):
    """Words' numbers from 1, in the order in which they are met; 0 is the end of a piece, -1 no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) - 1
        return value


class Shard:
    """The words of one language that a task has read, in order."""

    def __init__(self):
        self.ids, self.held, self.size = Ids(), [], 0

    def add(self, text: bytes) -> None:
        """Words of a text in which MARKS has replaced bytes; the next call goes on without a break."""
        tokens = text.replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
        self._put(found[found >= 0])

    def stop(self) -> None:
        self._put(np.zeros(1, np.int32))

    def _put(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)

    def trie(self, end: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """(sorted words, nodes in preorder as packed ranks of their words from 1, counts, words read) of the runs that begin in the shard. Unless
        it is the end, those at the last two words are left, with the words, for the next trie."""
        ids = np.concatenate([*self.held, np.zeros(2 if end else 0, np.int32)])
        names = list(self.ids)[2:]
        words = sorted(names)
        rank = np.zeros(len(names) + 1, np.int64)
        rank[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        r = rank[ids]
        one, two, three = r[:-2], r[1:-1], r[2:]
        a, ab, abc = one > 0, (one > 0) & (two > 0), (one > 0) & (two > 0) & (three > 0)
        keys = np.concatenate([one[a] << 2 * BITS, (one[ab] << 2 * BITS) | (two[ab] << BITS), (one[abc] << 2 * BITS) | (two[abc] << BITS) | three[abc]])
        nodes, counts = np.unique(keys, return_counts=True)
        rest = [names[i - 1] if i else b"\n" for i in ([] if end else ids[-2:].tolist())]
        self.__init__()
        self.add(b" ".join(rest))
        return words, nodes, counts, int(a.sum())


def place(words: list[bytes], nodes: np.ndarray, path: tuple[bytes, bytes, bytes]) -> tuple[int, bool]:
    """How many nodes come before a path, and whether it is a node."""
    key, known = 0, True
    for depth, w in enumerate(path):
        at = bisect_left(words, w) + 1 if w else 0
        key |= at << BITS * (2 - depth)
        known = not w or (at <= len(words) and words[at - 1] == w)
        if not known:
            break  # all that begin with a greater word here come after
    at = int(np.searchsorted(nodes, key))
    return at, known and at < len(nodes) and int(nodes[at]) == key


def pieces(lang: str, words: list[bytes], nodes: np.ndarray, counts: np.ndarray, cuts: list[Path]) -> Iterator[tuple[int, bytes, int, int]]:
    """(range, serialised nodes, their number, number of bytes of their words) of each range that the trie has nodes in or above."""
    first, last = bisect_left(cuts, (lang, b"", b"", b"")), bisect_left(cuts, (lang + "\0", b"", b"", b""))
    own = [c[1:] for c in cuts[first:last]]
    ends = [0, *(place(words, nodes, c)[0] for c in own), len(nodes)]
    press = zstandard.ZstdCompressor(level=3)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        at = np.arange(a, b)
        if k:
            w1, w2, w3 = own[k - 1]
            ups = ([(w1, b"", b"")] if w2 else []) + ([(w1, w2, b"")] if w3 else [])
            at = np.concatenate([np.array([i for i, known in (place(words, nodes, up) for up in ups) if known], np.int64), at])
        if len(at):
            yield first + k, *serialised(words, nodes[at], counts[at], press)


def serialised(words: list[bytes], nodes: np.ndarray, counts: np.ndarray, press: zstandard.ZstdCompressor) -> tuple[bytes, int, int]:
    mask = (1 << BITS) - 1
    two, three = nodes >> BITS & mask, nodes & mask
    depth = np.where(three > 0, 3, np.where(two > 0, 2, 1)).astype(np.uint8)
    last = np.where(three > 0, three, np.where(two > 0, two, nodes >> 2 * BITS))
    used, last = np.unique(last, return_inverse=True)
    vocabulary = b" ".join([words[k - 1] for k in used.tolist()])
    raw = vocabulary + depth.tobytes() + last.astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()
    return press.compress(raw), len(nodes), len(vocabulary)


def nodes_of(blob: bytes, n: int, vocabulary: int, unpress: zstandard.ZstdDecompressor) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, depth, places of last words, counts)."""
    raw = unpress.decompress(blob)
    words = raw[:vocabulary].split(b" ")
    rest = memoryview(raw)[vocabulary:]
    return words, np.frombuffer(rest[:n], np.uint8), np.frombuffer(rest[n : 5 * n], np.uint32), np.frombuffer(rest[5 * n :], np.uint32)


def above(depth: np.ndarray, of: int) -> np.ndarray:
    """For each node in preorder the place of the latest node of a depth, where its path passes it; -1 before the first."""
    return np.maximum.accumulate(np.where(depth == of, np.arange(len(depth), dtype=np.int32), np.int32(-1)))


def merged(blobs: list[tuple[bytes, int, int]], block: int = BLOCK_NODES) -> Iterator[tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted words, ranks of the first, second and third word from 1 or 0, counts, counts of the nodes above at depth 1 and 2) of the sum of serialised tries (blob,
    nodes, bytes of words), in preorder. Each run is sorted by its packed paths, and runs are merged some block nodes at a time, so that besides
    the runs themselves, 12 bytes a node, little is held. Too many words to pack are merged at once."""
    unpress = zstandard.ZstdDecompressor()
    words = sorted({w for blob, _, size in blobs for w in unpress.decompress(blob)[:size].split(b" ")})
    rank = {w: k + 1 for k, w in enumerate(words)}
    bits = max(1, len(words).bit_length())
    packs = 3 * bits <= 63
    runs = []
    for blob in blobs:
        own, depth, last, n = nodes_of(*blob, unpress)
        r = np.fromiter(map(rank.__getitem__, own), np.int64, len(own))[last]
        path = r[above(depth, 1)], np.where(depth > 1, r[above(depth, 2)], 0), np.where(depth > 2, r, 0)
        runs.append(([(path[0] << 2 * bits) | (path[1] << bits) | path[2]] if packs else [x.astype(np.int32) for x in path], n.copy()))
    del rank
    total = sum(len(n) for _, n in runs)
    cuts = np.zeros(0, np.int64)
    if packs and total > block:
        some = np.sort(np.concatenate([key[0][:: max(1, block // 512)] for key, _ in runs]))
        cuts = np.unique(some[:: max(1, len(some) * block // total)])[1:]
    ends = [np.concatenate([[0], np.searchsorted(key[0], cuts), [len(n)]]) for key, n in runs]
    one = two = 0  # counts of the latest nodes of depth 1 and 2
    for b in range(len(cuts) + 1):
        here = [slice(e[b], e[b + 1]) for e in ends]
        keys = [np.concatenate([key[part][h] for (key, _), h in zip(runs, here)]) for part in range(1 if packs else 3)]
        if not len(keys[0]):
            continue
        counts = np.concatenate([n[h] for (_, n), h in zip(runs, here)])
        order = np.argsort(keys[0], kind="stable") if packs else np.lexsort(keys[::-1])  # a stable sort of sorted runs merges them
        keys = [key[order] for key in keys]
        new = np.flatnonzero(np.append(True, np.any([key[1:] != key[:-1] for key in keys], axis=0)))
        counts = np.add.reduceat(counts[order].astype(np.int64), new)
        keys = [key[new] for key in keys]
        ranks = [keys[0] >> shift & (1 << bits) - 1 for shift in (2 * bits, bits, 0)] if packs else keys
        depth = 1 + (ranks[1] > 0).astype(np.uint8) + (ranks[2] > 0)
        first, second = above(depth, 1), above(depth, 2)
        first, second = np.where(first < 0, one, counts[first]), np.where(second < 0, two, counts[second])
        one, two = int(first[-1]), int(second[-1])
        yield words, ranks, counts, first, second


def cut_points(df: DataFrame, ranges: int) -> list[Path]:
    """Paths that cut the corpus into about that many ranges of equal text."""
    total = df.agg(F.sum("bytes")).first()[0] or 0
    if ranges < 2 or not total:
        return []
    step = max(1, total // (ranges * CUT_SAMPLES))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, paths = [], []
            for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                if not text:
                    continue
                at = xxhash.xxh3_64_intdigest(text) % step  # anywhere, so that long texts do not count for more than their share
                while at < len(text):
                    words = text[at : at + 200].translate(MARKS).replace(b"\n", b" ").split(b" ")
                    words = [w for w in words[1:-1] if w][:3]
                    if len(words) == 3:
                        langs.append(lang)
                        paths.append(words)
                    at += step
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(paths, pa.list_(pa.binary()))], names=["lang", "path"])

    found = df.select("lang", "text").mapInArrow(sampled, "lang string, path array<binary>")
    rows = sorted((lang, *map(bytes, path)) for lang, path in found.collect())  # CUT_SAMPLES a range
    return sorted({rows[len(rows) * k // ranges] for k in range(1, ranges)}) if rows else []


def frequent(df: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text", range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, depth, phrase, suffix: all but its first word, a, l1, l2: counts of its first word and of its first two), (lang, n));
    runs of up to three words with at least least occurrences."""
    spark = df.sparkSession
    own = df.select(F.coalesce(named(lang), F.lit(UNKNOWN)).alias("lang"), named(text).alias("text"), F.coalesce(F.octet_length(named(text)), F.lit(0)).alias("bytes"))
    total = own.agg(F.sum("bytes")).first()[0] or 0
    cuts = cut_points(own, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def sent(end: bool) -> Iterator[pa.RecordBatch]:
            for name, shard in list(shards.items()):
                words, nodes, counts, n = shard.trie(end)
                rows = list(pieces(name, words, nodes, counts, cuts))
                columns = [pa.array([name] * (len(rows) + 1)), pa.array([r[0] for r in rows] + [0], pa.int32()), pa.array([0] * len(rows) + [n], pa.int64())]
                columns += [pa.array([r[1] for r in rows] + [None], pa.binary()), pa.array([r[2] for r in rows] + [0], pa.int32()), pa.array([r[3] for r in rows] + [0], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "range", "words", "blob", "nodes", "vocabulary"])

        read = 0
        for part in slices(batches, 16):
            for name, raw in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                shard = shards.setdefault(name, Shard())
                raw = raw.translate(MARKS)
                at = 0
                while at < len(raw):
                    end = raw.find(b" ", at + TEXT_BYTES)
                    end = len(raw) if end < 0 else end
                    before = shard.size
                    shard.add(raw[at:end])
                    read, at = read + shard.size - before, end
                    if read >= shard_words:
                        yield from sent(False)
                        read = 0
                shard.stop()
        yield from sent(True)

    kept = "lang string, range int, words long, blob binary, nodes int, vocabulary int"
    tries = saved(own.select("lang", "text").mapInArrow(counted, kept), "tries")
    totals = tries.groupBy("lang").agg(F.sum("words").alias("n"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for name, at, blob, n, vocabulary in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                held.setdefault((name, at), []).append((blob, n, vocabulary))
        for name, at in list(held):
            start = cuts[at - 1] if at and cuts[at - 1][0] == name else None
            for words, ranks, counts, first, second in merged(held.pop((name, at))):
                rows = []
                for k in np.flatnonzero(counts >= least).tolist():
                    path = tuple(words[r[k] - 1] if r[k] else b"" for r in ranks)
                    if start is None or (name, *path) >= start:  # nodes above the range's first belong to the range before
                        some = [w.decode() for w in path if w]
                        rows.append((name, len(some), " ".join(some), " ".join(some[1:]), int(counts[k]), int(first[k]), int(second[k])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), FREQUENT.values())], names=list(FREQUENT))

    dealt = tries.where("blob IS NOT NULL").select("lang", "range", "blob", "nodes", "vocabulary").repartitionById(len(cuts) + 1, F.col("range"))
    phrases = dealt.mapInArrow(summed, "lang string, depth int, phrase string, suffix string, a long, l1 long, l2 long")
    return saved(phrases, "phrases"), totals


FREQUENT = {"lang": pa.string(), "depth": pa.int32(), "phrase": pa.string(), "suffix": pa.string(), "a": pa.int64(), "l1": pa.int64(), "l2": pa.int64()}


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two and three words, before any goes: the cut with the lowest score, of equal ones the first."""
    link = lambda d, *columns: phrases.where(F.col("depth") == d).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), *columns)
    linked = lambda df, to: df.join(to, (F.col("lang") == F.col("_lang")) & (F.col("suffix") == F.col("_phrase"))).drop("_lang", "_phrase")
    score = lambda l, r: F.expr(f"(cast(1000000 AS decimal(38, 0)) * a * a) div (cast({l} AS decimal(38, 0)) * {r})")
    two = linked(phrases.where("depth = 2"), link(1, F.col("a").alias("r1")))
    last = two.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("r1"), F.col("r1").alias("r2"))
    three = linked(phrases.where("depth = 3"), last).withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    best = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("l1", "l2", "l"), ("r1", "r2", "r"), ("s1", "s2", "score"))]
    shown = ["lang", "phrase", "a"]
    return two.select(*shown, F.col("l1").alias("l"), F.col("r1").alias("r"), score("l1", "r1").alias("score")).unionByName(three.select(*shown, *best))


def mined(df: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, lang: str = "lang", text: str = "text", **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first top phrases."""
    phrases, totals = frequent(df, least, lang, text, **sizes)
    longer = phrases.where("depth = 3")
    ends = F.array(F.expr("substring_index(phrase, ' ', 2)"), F.col("suffix"))
    within = longer.select(F.col("lang").alias("_lang"), F.explode(ends).alias("_phrase"), F.col("a").alias("_a")).groupBy("_lang", "_phrase").agg(F.max("_a").alias("_a"))
    met = scored(phrases).join(within, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    left = met.where(F.expr(f"_a IS NULL OR cast(100 AS decimal(38, 0)) * _a < cast({inside} AS decimal(38, 0)) * a")).drop("_lang", "_phrase", "_a")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = left.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
