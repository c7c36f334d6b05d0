"""Target-distribution importance resampling: documents weighted by how much more their features occur in a target than in the corpus.

Features are words and pairs of neighbouring words, hashed by crc32 into BUCKETS buckets. Each task counts its texts into one array of
BUCKETS counts; their sums over corpus and target, two arrays of fixed size, give a gain per bucket, and a document's
weight is the mean of its features' gains, read from that array. A keyed Gumbel number per id is added, so the highest scores are a
draw in proportion to the exponential of the weights.

The draw: a histogram of scores, which are integers of a bounded range, gives the least score that is drawn and the cuts of the
merge ranges; a score with more rows than a range takes is cut by id as well. Each task sorts its eligible rows above that score into runs of at
most RUN_ROWS, cut at the ranges' ends. Each range's runs are merged by a tournament tree, which stops once the draw is complete and gives
ranks from the number of rows in the ranges before. No task holds more than a range's rows, no driver more than a few numbers a range.

Cases: a null or empty text has no features, weight 0, and no draw. Rows of one id have one Gumbel number; equal scores go by id, null ids
last (they share the number of an empty id), then by n_features; rows equal in all of these differ in rank alone. An empty table gives no rows, an
empty target makes the gains those of no occurrences. Very long texts are taken in pieces of PIECE bytes that share a word.
Other columns are left out, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import named, saved, slices, utf8

BUCKETS = 10_000
LEAST_WORDS, DRAW, SEED = 20, (25, 100), 7
#: Bytes of a text that are taken apart at a time; words that are hashed at a time.
PIECE, WORDS = 1 << 20, 200_000
#: Rows of a sorted run, and of a merge range, at most (but for rows of one score and id).
RUN_ROWS, RANGE_ROWS = 250_000, 1_000_000
#: Letters in lower case, bytes of words as they are, all others to spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Longest second word of a pair whose hash is combined from those of its words.
TABLED = 64


def shift_tables() -> np.ndarray:
    """[length, byte of the hash, its value]: the crc32 of a text that goes on for length bytes is that of its end, xor these four entries."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for length in range(TABLED + 1):
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        for bit in range(32):
            byte, place = divmod(bit, 8)
            out[length, byte, 1 << place : 2 << place] = out[length, byte, : 1 << place] ^ np.uint32(zlib.crc32(zeros, 1 << bit) ^ none)
    return out


class PairHashes(dict):
    """word -> its crc32, above it that of the word and a space; kept between rows up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound, self.shifts = bound, shift_tables().ravel()

    def __missing__(self, word: bytes) -> int:
        own = zlib.crc32(word)
        value = zlib.crc32(b" ", own) << 32 | own
        if len(self) >= self.bound:
            self.clear()
        self[word] = value
        return value

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(crc32 of each word, crc32 of each word, a space and the next word)."""
        both = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        own, first = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)[:-1]
        at = np.minimum(length[1:], TABLED) * 1024
        pair = own[1:].copy()
        for byte in range(4):
            pair ^= self.shifts[at + 256 * byte + ((first >> (8 * byte)) & 255)]
        for k in np.flatnonzero(length[1:] > TABLED):
            pair[k] = zlib.crc32(words[k + 1], int(first[k]))
        return own, pair


def worded(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, their texts' places, whether the word is new) for at most about WORDS words at a time. A piece of a long text
    begins with the last word of the piece before, which is not new, so that no pair is lost."""
    words, rows, again = [], [], []
    size = 0
    for k, text in enumerate(texts):
        at, last = 0, None
        text = text.translate(WORD_BYTES)
        while at < len(text):
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            own = text[at:end].split()
            at = end
            if not own:
                continue
            if last is not None:
                again.append(size)
                own.insert(0, last)
            words += own
            rows.append((k, len(own)))
            size, last = size + len(own), own[-1]
            if size > WORDS:
                yield words, *_places(rows, again, size)
                words, rows, again, size = [], [], [], 0
    if size:
        yield words, *_places(rows, again, size)


def _places(rows: list[tuple[int, int]], again: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    of, n = np.array(rows, np.int64).reshape(-1, 2).T
    new = np.ones(size, bool)
    new[again] = False
    return np.repeat(of, n), new


def buckets(hashes: PairHashes, words: list[bytes], rows: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, bucket) of each feature."""
    own, pair = hashes.features(words)
    together = (rows[1:] == rows[:-1]) & new[1:]
    return np.concatenate([rows[new], rows[1:][together]]), np.concatenate([own[new], pair[together]]) % np.uint32(BUCKETS)


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often features of each bucket occur: an array per task, then their sum."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = PairHashes(), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for words, rows, new in worded(utf8(part.column(0))):
                total += np.bincount(buckets(hashes, words, rows, new)[1], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    sums = df.select(named(text)).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed shares' ratio) of each bucket, in doubles."""
    s_all, t_all = float(int(corpus.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    ratio = [(float(t + 1) * s_all) / (float(s + 1) * t_all) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def luck(id: int | None, seed: int) -> int:
    """The Gumbel number of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PairHashes()
        for part in slices(batches):
            n = part.num_rows
            count, total, n_words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for words, rows, new in worded(utf8(part.column(1))):
                of, bucket = buckets(hashes, words, rows, new)
                count += np.bincount(of, minlength=n)
                total += np.bincount(of, weights=gain[bucket], minlength=n).astype(np.int64)  # sums of a piece, exact in doubles
                n_words += np.bincount(rows[new], minlength=n)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            ids = part.column(0).to_pylist()
            score = weight + np.array([luck(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_words, count, weight, score))], names=["id", "n_words", "n_features", "weight", "score"])

    return df.select(named(key).cast("long"), named(text)).mapInArrow(scored, "id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """Merges sorted runs: a tree of matches whose leaves are the runs' next rows; taking the winner replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])

    def _better(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def pop(self) -> tuple | None:
        best = self.tree[1] if self.size > 1 else 0
        row = self.heads[best]
        if row is not None:
            self.heads[best] = next(self.runs[best], None)
            node = (best + self.size) >> 1
            while node:
                self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
                node >>= 1
        return row

    def rest(self) -> Iterator[tuple]:
        """What was not taken, in no order."""
        for head, run in zip(self.heads, self.runs):
            if head is not None:
                yield head
                yield from run


#: A row of a run: score, falling; null ids last; id; number of features. With it go its weight and how often it occurs.
RUN = ["minus", "none", "id", "n_features", "weight", "copies"]


def ranked(scored: DataFrame, draw: tuple[int, int] = DRAW, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """scored, a table as weighted() gives it, with rank: 1, 2, 3 ... for the draw[0] / draw[1] of the eligible rows that score highest."""
    spark = scored.sparkSession
    shown = [F.col(c) for c in ("id", "n_features", "weight", "score")]
    fit = F.col("n_words") >= least_words
    histogram = sorted(map(tuple, scored.where(fit).groupBy("score").count().collect()), reverse=True)  # scores are integers within some 10^5
    wanted = draw[0] * sum(n for _, n in histogram) // draw[1]
    if not wanted:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    scores, counts = (np.array(x, np.int64) for x in zip(*histogram))
    upto = np.cumsum(counts)
    last = int(np.searchsorted(upto, wanted))
    least = int(scores[last])
    scores, counts, upto = scores[: last + 1], counts[: last + 1], upto[: last + 1]
    per = max(1, min(range_rows, -(-int(upto[-1]) // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    heavy = {int(s): int(-(-n // per)) for s, n in zip(scores, counts) if n > 2 * per}
    tops = _tops(scored.where(fit), scores, counts, upto, per, heavy)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= run_rows:
                yield _run(held, tops)
                held, size = [], 0
        if size:
            yield _run(held, tops)

    kept = "range int, n long, " + ", ".join(f"{c} binary" for c in RUN)
    pieces = saved(scored.where(fit & (F.col("score") >= least)).select(*shown).mapInArrow(runs, kept), "runs")
    of_range = dict(map(tuple, pieces.groupBy("range").agg(F.sum("n")).collect()))  # a number for each range
    before, starts = 0, {}
    for r in sorted(of_range):
        starts[r], before = before, before + of_range[r]

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rank = starts[key[0].as_py()]
        tree = Tournament([_unpacked(r) for r in rows.select(RUN).to_pylist()])
        out = []
        while rank < wanted and (row := tree.pop()) is not None:
            drawn = min(row[5], wanted - rank)
            out.append((*row, rank + 1, drawn))
            if drawn < row[5]:  # of equal rows only some are drawn
                out.append((*row, None, row[5] - drawn))
            rank += drawn
        out += [(*row, None, row[5]) for row in tree.rest()]
        minus, none, id, n_features, weight, _, first, copies = zip(*out)
        ids = [None if x else i for x, i in zip(none, id)]
        columns = [pa.array(x, pa.int64()) for x in (ids, n_features, weight, [-x for x in minus], first, copies)]
        return pa.Table.from_arrays(columns, names=["id", "n_features", "weight", "score", "first", "copies"])

    met = pieces.groupBy("range").applyInArrow(merged, "id long, n_features long, weight long, score long, first long, copies long")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k")
    drawn = met.select(*shown, "first", place).select(*shown, (F.col("first") + F.col("k")).alias("rank"))
    rest = scored.where(~F.coalesce(fit & (F.col("score") >= least), F.lit(False))).select(*shown, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def _tops(fit: DataFrame, scores: np.ndarray, counts: np.ndarray, upto: np.ndarray, per: int, heavy: dict[int, int]) -> list[tuple[int, int, int]]:
    """The ranges' first rows (minus score, whether the id is null, id), in order, about per rows each."""
    none = (0, -(1 << 63))
    cuts: dict[int, list[int]] = {}
    if heavy:  # so few scores and cuts that there is one for each per rows
        most = max(heavy.values())
        points = F.percentile_approx("id", [k / most for k in range(1, most)], 10_000)
        cuts = {s: p for s, p in fit.where(F.col("score").isin(list(heavy))).groupBy("score").agg(points).collect() if p}
    tops, room = [], 0
    for s, n in zip(scores.tolist(), counts.tolist()):
        if s in heavy:
            step = max(1, -(-len(cuts.get(s, [])) // heavy[s]))
            tops += [(-s, *none), *sorted({(-s, 0, c) for c in cuts.get(s, [])[::step]}), (-s, 1, 0)]
            room = 0
        else:
            if room < n:
                tops.append((-s, *none))
                room = per
            room -= n
    return tops


def _run(held: list[pa.RecordBatch], tops: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """One sorted run, equal rows as one with their number, cut where ranges begin."""
    table = pa.Table.from_batches(held)
    id = table.column("id").combine_chunks()
    none = np.asarray(id.is_null()).astype(np.int64)
    minus, number, n_features, weight = -table.column("score").to_numpy(), id.fill_null(0).to_numpy(zero_copy_only=False), table.column("n_features").to_numpy(), table.column("weight").to_numpy()
    order = np.lexsort((n_features, number, none, minus))
    columns = [x[order] for x in (minus, none, number, n_features, weight)]
    first = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])
    at = np.flatnonzero(first)
    columns = [x[at] for x in columns] + [np.diff(np.append(at, len(order)))]
    begins = [_before(columns[:3], top) for top in tops]
    ends = [*begins[1:], len(at)]
    there = [(r, a, b) for r, (a, b) in enumerate(zip(begins, ends)) if a < b]
    packed = [[np.ascontiguousarray(x[a:b], np.int64).tobytes() for _, a, b in there] for x in columns]
    n = [int(columns[5][a:b].sum()) for _, a, b in there]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in there], pa.int32()), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], names=["range", "n", *RUN])


def _before(columns: list[np.ndarray], top: tuple[int, int, int]) -> int:
    """How many of the sorted rows come before top."""
    low, high = 0, len(columns[0])
    for column, value in zip(columns, top):
        low, high = low + int(np.searchsorted(column[low:high], value, "left")), low + int(np.searchsorted(column[low:high], value, "right"))
    return low


def _unpacked(row: dict) -> Iterator[tuple]:
    return zip(*[np.frombuffer(row[c], np.int64).tolist() for c in RUN])


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return ranked(saved(weighted(docs, gain), "weights")).withColumnRenamed("id", "doc_id")
