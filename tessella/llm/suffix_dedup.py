"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus.

Anchors: of the GRAM-byte strings in a window of LENGTH bytes the one with the least hash, of equal ones the leftmost, is the window's anchor. It depends on
the window's bytes alone, so equal windows have equal anchors at equal places. Consecutive windows of one anchor make a segment of
at most 2 LENGTH - GRAM bytes, and each window is in one segment. An anchor that occurs once has no repeated window, and a segment that
occurs more than once is repeated as a whole; both are settled from hashes (anchor and segment, 64 bits each), without moving any text.

What is left are anchors with segments that differ. Their segments' bytes are fetched, those of an anchor meet in one task, and a generalised suffix
array tells which windows they share. Its text has a symbol for each BLOCK bytes, counted from the anchor, ranked by their bytes, so that its order is
that of the bytes. It is built by linear grouping: suffixes are grouped by Lyndon prefix, groups are processed in descending order through pointers to
the previous smaller suffix, and then each group's order is emitted along these pointers; no symbols are renamed on the way. In suffix order
the suffixes that share LENGTH - d bytes stand together, and those among them with the same d bytes before start equal windows; d below BLOCK reaches
windows that start between blocks. Anchors with more than HOT different segments are dealt out instead, so that no task ever holds all segments of a common passage: cut
in pieces of WIDTHS windows at the same places around the anchor, which are settled like segments, by hashes (128 bits) of the bytes that all windows of a piece share, as its anchor, and
of the piece; what is left, pieces that occur once among others that share those bytes, by the hashes of their windows.

Texts are known by a 64-bit hash and their length; copies of a text have one result. Spans are joined per text and cut out of it.

Cases: a null or empty text, like any below LENGTH bytes, loses nothing, and neither does a text without a repeat. Repeated rows and rows with null or equal ids count as texts of
their own, so copies of LENGTH bytes lose all. A text that repeats itself loses the repeats, overlapping ones too. Very long texts are cut in pieces that
share LENGTH - 1 bytes. An empty table gives no rows. Other columns are left out, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import mix, named, saved, slices, utf8

LENGTH, GRAM, BLOCK = 200, 40, 8
#: Segments of one anchor that a suffix array takes, and symbols of one suffix array, about.
HOT, SYMBOLS = 2_000, 100_000
#: Windows of the pieces that the segments of an anchor with more segments are cut in, one width after the other, each a multiple of the next and of 8.
WIDTHS = (32, 8)
#: Bytes whose anchors are found at a time.
PIECE = 1 << 20
#: Texts whose hashes a task remembers, so as to send a copy once.
KNOWN = 500_000
FACTOR = np.uint64(0x9FB21C651E98DF25)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int]) -> list[int]:
    """The starts of all suffixes in their order; the last symbol is the least and occurs once. Linear grouping construction."""
    n = len(s)
    symbols = sorted(set(s))
    number = {c: k for k, c in enumerate(symbols)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    above, below = [*range(1, len(symbols)), -1], list(range(-1, len(symbols) - 1))
    previous, done = [-1] * n, bytearray(n)
    g = len(symbols) - 1
    while g >= 0:  # groups from the highest down; suffixes that are done are in this group or in higher ones
        own = [i for i in members[g] if group[i] == g] if size[g] else []
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                old = group[p]
                if size[old] > 1:
                    moved.setdefault((times, old), []).append(p)
            for (_, old), some in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
                if len(some) == size[old]:
                    continue  # all that is left of the group moves up together
                some.sort()
                new = len(members)
                members.append(some)
                size.append(len(some))
                size[old] -= len(some)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for p in some:
                    group[p] = new
        lowest, g = g, below[g]
    start, at = [0] * len(members), 0
    while lowest >= 0:
        start[lowest] = at
        at += size[lowest]
        lowest = above[lowest]
    out, placed = [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    start[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two neighbouring strings from those of either."""
    return (a ^ (a >> np.uint64(31))) * FACTOR + b


class Hashes:
    """64-bit hashes of strings of 8, 32 and GRAM bytes at each place of data; of others on demand."""

    def __init__(self, data: np.ndarray):
        h = BYTES[data]
        width, kept = 1, {}
        while width < 32:
            h = joined(h[:-width], h[width:]) if len(h) > width else h[:0]
            width *= 2
            kept[width] = h
        self.of8, self.of32 = kept[8], kept[32]
        self.gram = mix(joined(self.of32[: len(data) - GRAM + 1], self.of8[32 : len(data) - 8 + 1])) if len(data) >= GRAM else h[:0]

    def window(self, at: np.ndarray, seed: int = 0, length: int = LENGTH) -> np.ndarray:
        """Of length bytes, a multiple of 8, from each place."""
        h = np.full(len(at), seed, np.uint64)
        for k in range(0, length // 32 * 32, 32):
            h = mix(joined(h, self.of32[at + k]))
        for k in range(length // 32 * 32, length, 8):
            h = mix(joined(h, self.of8[at + k]))
        return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor's hash, segment's hash, first window's start, last window's start, anchor's place) for the texts that end at ends within data."""
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(data) < LENGTH:
        return nothing
    hashes = Hashes(data)
    best = (hashes.gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes.gram), dtype=np.uint64)
    span, wanted = 1, LENGTH - GRAM + 1
    while 2 * span <= wanted:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = wanted - span
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()) if b - a >= LENGTH] or [np.zeros(0, np.int64)])
    if not len(starts):
        return nothing
    anchor = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(starts)) - 1
    a, s0, s1 = anchor[first], starts[first], starts[last]
    own = mix(joined(hashes.window(s0), hashes.window(s1)) + ((a - s0) << 16 | (s1 - s0)).astype(np.uint64))
    return hashes.gram[a], own, s0, s1, a


def shared_windows(texts: list[bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the segment, start) of each window that occurs in more than one of some different segments; offsets are of their anchors.
    Sorted by both."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(bytes(BLOCK) + b"".join(texts) + bytes(BLOCK * (LENGTH // BLOCK + 2)), np.uint8)
    base = BLOCK + np.append(0, np.cumsum(n)[:-1])
    first = offsets % BLOCK
    blocks = -(-(n - first) // BLOCK)
    of = np.repeat(np.arange(len(texts)), blocks)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    q = first[of] + BLOCK * inside
    at = base[of] + q
    value = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[at].copy().view(">u8").ravel().astype(np.uint64)
    left = np.minimum(n[of] - q, BLOCK)
    value &= ~np.uint64(0) << (8 * (BLOCK - left)).astype(np.uint64)  # only a segment's last block can be shorter
    order = np.lexsort((left, value))
    symbol = np.empty(len(of), np.int64)
    symbol[order] = 2 + np.cumsum(np.append(0, (value[order][1:] != value[order][:-1]) | (left[order][1:] != left[order][:-1])))
    where = np.arange(len(of)) + of  # a separator, 1, follows each segment, and 0 ends all
    text = np.ones(len(of) + len(texts) + 1, np.int64)
    text[where], text[-1] = symbol, 0
    block = np.full(len(text), -1, np.int64)
    block[where] = np.arange(len(of))
    sorted_blocks = block[np.array(suffix_array(text.tolist()))]
    can = (q <= offsets[of]) & (n[of] - q > LENGTH - BLOCK)
    k = sorted_blocks[sorted_blocks >= 0]
    k = k[can[k]]
    if len(k) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = common_bytes(np.append(value, np.zeros(LENGTH // BLOCK, np.uint64)), k[:-1], k[1:], n[of] - q)
    before = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[at[k] - BLOCK].copy().view(">u8").ravel().astype(np.uint64)
    found_of, found_at = [], []
    for d in range(BLOCK):
        run = np.cumsum(np.append(True, common < LENGTH - d))
        fits = (q[k] >= d) & (n[of[k]] - q[k] >= LENGTH - d)
        fits &= np.bincount(run, fits)[run] > 1
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        lead = before[some] & np.uint64((1 << 8 * d) - 1)
        by = np.lexsort((lead, run[some]))
        new = np.append(True, (run[some][by][1:] != run[some][by][:-1]) | (lead[by][1:] != lead[by][:-1]))
        part = np.cumsum(new) - 1
        hit = k[some[by[np.bincount(part)[part] > 1]]]
        found_of.append(of[hit])
        found_at.append(q[hit] - d)
    if not found_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_, at_ = np.concatenate(found_of), np.concatenate(found_at)
    order = np.lexsort((at_, of_))
    return of_[order], at_[order]


def common_bytes(value: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many bytes, LENGTH at most, the segments share from blocks i and j on."""
    out = np.empty(len(i), np.int64)
    step = np.arange(LENGTH // BLOCK)
    for a in range(0, len(i), 20_000):
        b = slice(a, a + 20_000)
        differ = value[i[b][:, None] + step] ^ value[j[b][:, None] + step]
        any_ = differ != 0
        first = np.where(any_.any(1), any_.argmax(1), len(step))
        x = differ[np.arange(len(first)), np.minimum(first, len(step) - 1)]
        equal = sum((x >> np.uint64(8 * (BLOCK - 1 - k)) == 0).astype(np.int64) for k in range(BLOCK))
        out[b] = np.where(first < len(step), BLOCK * first + equal, LENGTH)
    return np.minimum(out, np.minimum(room[i], room[j]))


def spans_of(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, from, to): the union of windows from sorted starts, for each of."""
    first = np.append(True, (of[1:] != of[:-1]) | (start[1:] > start[:-1] + LENGTH))
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(of)) - 1
    return of[at], start[at], start[last] + LENGTH


OCCURRENCE = "h long, g long, a long, b int, start int, end int, anchor short, size short, many boolean"


def occurrences(texts: DataFrame) -> DataFrame:
    """A row for each segment of texts (a, b, text): start and end in the text, offset of its anchor, size. Equal segments that follow one another, as in
    texts of one repeated word, are one row, of many occurrences; so are copies within a batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            _, at, copies = np.unique(np.stack([a, b.astype(np.int64)], 1), axis=0, return_index=True, return_counts=True)
            raw = utf8(part.column(2))
            held, size = [], 0
            for k, c in zip(at.tolist(), copies.tolist()):
                text = raw[k]
                for begin in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                    held.append((a[k], b[k], begin, c > 1, text[begin : begin + PIECE + LENGTH - 1]))
                    size += len(held[-1][4])
                    if size >= PIECE:
                        yield _occurring(held)
                        held, size = [], 0
            if held:
                yield _occurring(held)

    return texts.mapInArrow(found, OCCURRENCE)


def _occurring(held: list[tuple]) -> pa.RecordBatch:
    a, b, begin, many, raw = zip(*held)
    ends = np.cumsum([len(x) for x in raw])
    h, g, s0, s1, anchor = segments(np.frombuffer(b"".join(raw), np.uint8), ends)
    of = np.searchsorted(ends, s0, "right")
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(of) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(of)) - 1 if len(of) else first
    of = of[first]
    shift = np.array(begin, np.int64)[of] - np.append(0, ends[:-1])[of]
    columns = [
        pa.array(h[first].view(np.int64)), pa.array(g[first].view(np.int64)), pa.array(np.array(a, np.int64)[of]), pa.array(np.array(b, np.int32)[of]),
        pa.array((s0[first] + shift).astype(np.int32)), pa.array((s1[last] + LENGTH + shift).astype(np.int32)), pa.array((anchor - s0)[first].astype(np.int16)),
        pa.array((s1 - s0 + LENGTH)[first].astype(np.int16)), pa.array((last > first) | np.array(many)[of]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OCCURRENCE.split(", ")])


def packed(texts: DataFrame, key: str | None = None) -> DataFrame:
    """texts (a, b, text, ...) with the text compressed as z, for joins; without a key, copies that a task meets again are left out."""

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdCompressor(level=3), set()
        for part in slices(batches):
            if key is None:
                new = []
                for k, x in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if x not in known:
                        new.append(k)
                        known.add(x)
                if len(known) > KNOWN:
                    known.clear()
                part = part.take(pa.array(new, pa.int64()))
            z = pa.array([press.compress(x) for x in utf8(part.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), z, *[part.column(k) for k in range(3, part.num_columns)]], names=["a", "b", "z"] + ([key] if key else []))

    columns = [F.col("a"), F.col("b"), F.col("text")] + ([F.col(key)] if key else [])
    kind = f", `{key}` {texts.schema[key].dataType.simpleString()}" if key else ""
    return texts.select(*columns).mapInArrow(pressed, f"a long, b int, z binary{kind}")


def fetched(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, g, a, b, start, anchor, open, hot, bytes) of the segments wanted, from their texts."""
    lists = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("h", "g", "start", "size", "anchor", "open", "hot")).alias("s"))
    met = packed(texts).join(lists, ["a", "b"]).select("a", "b", "z", "s")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches, 16):
            a, b, z, s = (part.column(k) for k in range(4))
            own = s.flatten()
            of = np.repeat(np.arange(part.num_rows), s.value_lengths().to_numpy())
            start, size = own.field("start").to_numpy(), own.field("size").to_numpy().astype(np.int64)
            raw = [unpress.decompress(x) for x in z.to_pylist()]
            for at in range(0, len(of), 10_000):
                to = min(len(of), at + 10_000)
                pieces = [raw[r][i : i + n] for r, i, n in zip(of[at:to].tolist(), start[at:to].tolist(), size[at:to].tolist())]
                where = pa.array(of[at:to])
                columns = [own.field(c).slice(at, to - at) for c in ("h", "g")] + [a.take(where), b.take(where)] + [own.field(c).slice(at, to - at) for c in ("start", "anchor", "open", "hot")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], names=["h", "g", "a", "b", "start", "anchor", "open", "hot", "bytes"])

    return met.mapInArrow(cut, "h long, g long, a long, b int, start int, anchor short, open boolean, hot boolean, bytes binary")


SPAN = "a long, b int, start int, end int"


def compared(cold: DataFrame) -> DataFrame:
    """Spans of the open segments' windows that another segment of their anchor has too."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        of, start = shared_windows([r[7] for r in rows], np.array([r[5] for r in rows], np.int64))
        open_ = np.array([r[6] for r in rows], bool)
        of, start = of[open_[of]], start[open_[of]]
        of, low, high = spans_of(of, start) if len(of) else (of, start, start)
        base = np.array([r[4] for r in rows], np.int64)[of]
        columns = [pa.array([rows[k][2] for k in of.tolist()], pa.int64()), pa.array([rows[k][3] for k in of.tolist()], pa.int32()), pa.array((base + low).astype(np.int32)), pa.array((base + high).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "start", "end"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if held and row[0] == held[-1][0] and row[1] == held[-1][1]:
                    continue  # of a text of which a copy was sent too
                if size >= SYMBOLS and row[0] != held[-1][0]:
                    yield told(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7]) // BLOCK + 2
        if held:
            yield told(held)

    columns = ["h", "g", "a", "b", "start", "anchor", "open", "bytes"]
    return cold.select(*columns).repartition("h").sortWithinPartitions("h", "g").mapInArrow(scanned, SPAN)


PIECES = "x long, y long, u long, v long, a long, b int, start int, anchor short, open boolean, bytes binary"


def narrowed(hot: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of different segments (a, b, start, anchor, open, bytes) spans of the open ones' pieces that occur more than once, and the different pieces that are to be looked
    into, in the same columns. A piece is up to width windows: those with the anchor at the same places, by width. x and y are of the bytes that all windows there share, u and v of the piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = utf8(part.column(5))
            n = np.array([len(x) for x in raw])
            base = np.cumsum(n) - n
            hashes = Hashes(np.frombuffer(b"".join(raw), np.uint8))
            each = n - LENGTH + 1
            of = np.repeat(np.arange(len(raw)), each)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            anchor = part.column(3).to_numpy().astype(np.int64)
            place = (anchor[of] - inside) // width
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (place[1:] != place[:-1])))
            last = np.append(first[1:], len(of)) - 1
            of, low, high, place = of[first], inside[first], inside[last], place[first]
            core = base[of] + anchor[of] - width * place
            columns = [pa.array(hashes.window(core, seed, LENGTH - width).view(np.int64)) for seed in (1, 2)]
            columns += [pa.array(mix(joined(hashes.window(base[of] + low, seed), hashes.window(base[of] + high, seed)) + (high - low).astype(np.uint64)).view(np.int64)) for seed in (1, 2)]
            where = pa.array(of)
            columns += [part.column(0).take(where), part.column(1).take(where), pa.array((part.column(2).to_numpy()[of] + low).astype(np.int32)), pa.array((anchor[of] - low).astype(np.int16)), part.column(4).take(where)]
            columns.append(pa.array([raw[k][i : j + LENGTH] for k, i, j in zip(of.tolist(), low.tolist(), high.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    pieces = saved(hot.select("a", "b", "start", "anchor", "open", "bytes").mapInArrow(cut, PIECES), "pieces")
    rep = F.min(F.struct("a", "b", "start", "anchor", "bytes"))
    kinds = saved(pieces.groupBy("x", "y", "u", "v").agg(F.sum(F.when(F.col("open"), 1).otherwise(2)).alias("n"), rep.alias("rep")), "piece-kinds")
    whole = pieces.where("open").join(kinds.where("n > 1").select("x", "y", "u", "v"), ["x", "y", "u", "v"])
    sure = whole.select("a", "b", "start", (F.col("start") + F.length("bytes")).cast("int").alias("end"))
    cores = kinds.groupBy("x", "y").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("x", "y")
    return sure, kinds.join(cores, ["x", "y"]).select(F.col("x").alias("h"), F.col("u").alias("g"), "rep.*", (F.col("n") == 1).alias("open"))


def dealt(hot: DataFrame) -> DataFrame:
    """The same for anchors with very many different segments: by pieces that repeat whole, ever narrower, then by windows."""
    left, found = hot.dropDuplicates(["h", "g"]), []
    for width in WIDTHS:
        if left.isEmpty():
            break
        sure, left = narrowed(left, width)
        found.append(sure)
    return reduce(DataFrame.unionByName, found, counted(left))


def counted(hot: DataFrame) -> DataFrame:
    """The same by the windows' hashes. A segment that came with several copies of its text makes its
    windows once, and they are made once for both the count and the answer."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = utf8(part.column(3))
            n = np.array([len(x) for x in raw])
            ends = np.cumsum(n)
            hashes = Hashes(np.frombuffer(b"".join(raw), np.uint8))
            of = np.repeat(np.arange(len(raw)), n - LENGTH + 1)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(n - LENGTH + 1) - (n - LENGTH + 1), n - LENGTH + 1)
            at = (ends - n)[of] + inside
            where = pa.array(of)
            start = part.column(2).to_numpy()[of] + inside
            columns = [pa.array(hashes.window(at, 1).view(np.int64)), pa.array(hashes.window(at, 2).view(np.int64)), part.column(0).take(where), part.column(1).take(where), pa.array(start.astype(np.int32)), part.column(4).take(where)]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "a", "b", "start", "open"])

    one = hot.dropDuplicates(["h", "g"]).select("a", "b", "start", "bytes", "open")
    own = saved(one.mapInArrow(windows, "x long, y long, a long, b int, start int, open boolean"), "hot-windows")
    often = own.groupBy("x", "y").agg(F.sum(F.when(F.col("open"), 1).otherwise(2)).alias("n")).where("n > 1").select("x", "y")
    return own.where("open").join(often, ["x", "y"]).select("a", "b", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def repeats(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b, start, end): spans, together all bytes of texts (a, b, text) that are in a repeated window."""
    found = occurrences(texts)
    times = F.sum(F.when(F.col("many"), 2).otherwise(1))
    anchors = found.groupBy("h").agg(times.alias("n"), (F.min("g") != F.max("g")).alias("mixed")).where("n > 1").select("h", "mixed")
    met = saved(found.join(anchors, "h"), "repeated-anchors")
    mixed = met.where("mixed")
    rep = F.min(F.struct("a", "b", "start", "anchor", "size"))
    kinds = saved(mixed.groupBy("h", "g").agg(times.alias("n"), rep.alias("rep")), "segments")
    whole = mixed.join(kinds.where("n > 1").select("h", "g"), ["h", "g"])
    sure = met.where("NOT mixed").select("a", "b", "start", "end").unionByName(whole.select("a", "b", "start", "end"))
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    wanted = kinds.join(groups, "h").select("h", "g", "rep.*", (F.col("n") == 1).alias("open"), (F.col("kinds") > hot).alias("hot"))
    bytes_ = saved(fetched(wanted, texts), "segment-bytes")
    return sure.unionByName(compared(bytes_.where("NOT hot"))).unionByName(dealt(bytes_.where("hot")))


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every row."""
    own = df.select(named(key).alias("id"), F.coalesce(named(text), F.lit("")).alias("text"))
    own = own.select("id", F.xxhash64("text").alias("a"), F.octet_length("text").alias("b"), "text")
    spans = repeats(own.where(F.col("b") >= LENGTH).select("a", "b", "text"), hot)
    spans = saved(spans.groupBy("a", "b").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    met = packed(own.where(F.col("b") >= LENGTH), "id").join(spans, ["a", "b"], "left").select("id", "z", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches, 16):
            sizes, gone, number, rest = [], [], [], []
            for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = unpress.decompress(z)
                out, at, n = [], 0, 0
                last = -1
                for low, high in sorted((s["start"], s["end"]) for s in found or []):
                    if low > last:
                        n += 1
                    if low > at:
                        out.append(raw[at:low])
                    at = last = max(at, high)
                out.append(raw[at:])
                rest.append(b"".join(out))
                sizes.append(len(raw))
                gone.append(len(raw) - len(rest[-1]))
                number.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, number)], pa.array(rest, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = own.schema["id"].dataType.simpleString()
    long = met.mapInArrow(kept, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    short = own.where(F.col("b") < LENGTH).select("id", F.col("b").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return long.unionByName(short).withColumnRenamed("id", key)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return removed(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
