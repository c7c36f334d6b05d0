"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case; numbers, names (capitalised inside a sentence) and units
become typed placeholders, their slots. Windows of WINDOW template words are hashed, and the windows of
documents are hash-joined to those of the benchmark. A bit table of fixed size over the benchmark's hashes,
the only thing broadcast, lets documents emit only windows that can match. For each document, item and alignment (the
difference of positions) the slots of matching windows must be consistent: each value of the item
must stand for one value in the document, as it does in a copy (the same) and in a re-parameterised question.

A capital that begins a sentence or line tells nothing, so such a word is taken both ways, on both sides: a window
is hashed once for each choice of words and names that leaves it usable. A window that matches only with such a
name counts if its values agree with the others', but never rules out an alignment.

Each window is also hashed by its words as they are (case and surrounding punctuation apart), whatever their kinds.

A document is contaminated by an item if, at one alignment, it holds HITS windows (13 words in a row, or as many
in pieces), or all windows of a shorter item, either word for word, whatever the other slots, or as templates with
consistent slots. Items of fewer than WINDOW words have one window, of all their words, and match as such runs in any document.

Cases: null and empty texts and items have no windows; templates with fewer than PLAIN ordinary words say too
little and are not used, so that such windows match word for word only; an item without other windows is found
as a copy, not with other values. Rows with one doc_id are one document; equal items are all reported; unequal texts of
one item_id are items of their own, reported once, by the best of each figure. A null doc_id
cannot be reported and is never dropped. Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WordHashes, mix, named, rows_without, saved, slices, utf8

WINDOW, HITS, PLAIN = 8, 6, 4
#: Bits of the table that is broadcast: 2 MB whatever the benchmark's size; a fuller table lets more windows pass to the join.
BITS = 1 << 24

#: Words taken as units when they follow a number.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    b"month months year years percent % $ usd eur euro euros dollar dollars cent cents meter meters metre metres kilometer kilometers mile miles "
    b"foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres degrees mph kmh".split()
)
EDGES = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
NUMBER = re.compile(rb"[-+$]?[0-9]+(?:[.,:/][0-9]+)*%?")
BREAK = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Kinds of template words, in the top two bits of their hash's companion.
WORD, NUM, NAME, UNIT = range(4)


#: Keeps the hashes of windows of words apart from those of templates.
VERBATIM = np.uint64(0x5851F42D4C957F2D)
FACTOR = np.uint64(0x9FB21C651E98DF25)
#: FACTOR to the powers 0 to WINDOW - 1.
POWERS = np.array([pow(int(FACTOR), k, 1 << 64) for k in range(WINDOW)], np.uint64)
#: Bytes that are read at a time: a group of texts, or a piece of a longer one.
PIECE = 1 << 18
#: Words whose windows are made at a time: a bound for memory, as a window of capitalised words is hashed up to 163 times; windows handed on at a time.
STEP, ROWS = 4_096, 20_000
#: Parts that the occurrences of one window are dealt to, so that a common phrase of the benchmark does not meet in one task.
PARTS = 16


def _is(members: bytes) -> np.ndarray:
    """For each byte whether it is one of the members."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE, EDGE, END, DIGIT = _is(b" \t\n\x0b\x0c\r"), _is(EDGES), _is(b".!?:"), _is(b"0123456789")
UPPER, LOWER = _is(bytes(range(65, 91))), _is(bytes(range(97, 123)))
#: A 64-bit value for each byte, the same for both cases of an ASCII letter.
LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
LETTERS[UPPER] = LETTERS[LOWER]
SPREAD = 0xD1342543DE82EF95
SPREAD_BACK = pow(SPREAD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Templates(WordHashes):
    """(hash << 3) | flags for a word: 1 a number, 2 capitalised, 4 ends a sentence. The hash is of the lower-case core.

    The hash of an ASCII core is a sum of its bytes' values times powers, so that all words of a text are hashed at once from
    running sums; other words are hashed one by one and kept.
    """

    def __init__(self):
        super().__init__()
        self._room(0)

    def _room(self, n: int) -> None:
        self.up, self.down = _powers(SPREAD, n), _powers(SPREAD_BACK, n)

    def of(self, word: bytes) -> int:
        core = word.strip(EDGES) or word
        flags = 4 if word[-1:] in b".!?:" else 0
        if NUMBER.fullmatch(core):
            flags |= 1
        else:
            shown = core.decode("utf-8", "replace")
            if shown[:1].isupper() and shown[1:2].islower():
                flags |= 2
            core = shown.lower().encode()
        if core.isascii():
            value = sum(int(LETTERS[b]) * pow(SPREAD, k, 1 << 64) for k, b in enumerate(core)) + len(core)
            value = int(mix(np.array([value % (1 << 64)], np.uint64))[0])
        else:
            value = WordHashes.of(self, core)
        return ((value << 3) & ((1 << 64) - 1)) | flags

    def coded(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of() of each word, whether it is the first of its line, where it starts) of a text."""
        if len(text) <= PIECE:
            return self._coded(text)
        parts, at, line = [], 0, True  # cut before white space, so that no word and no line break is lost
        while at < len(text):
            rest = BREAK.search(text, at + PIECE)
            end = rest.start() if rest else len(text)
            codes, first, starts = self._coded(text[at:end])
            if len(codes):
                first[0] = line or b"\n" in text[at : at + int(starts[0])]
                line = b"\n" in text[at + int(starts[-1]) : end]
            else:
                line = line or b"\n" in text[at:end]
            parts.append((codes, first, starts + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _coded(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        letters = np.frombuffer(text, np.uint8)
        n = len(letters)
        if len(self.up) <= n:
            self._room(max(n + 1, PIECE + 1))
        blank = np.ones(n + 2, bool)
        blank[1:-1] = SPACE[letters]
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[::2], turns[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, bool), starts
        breaks = np.searchsorted(np.flatnonzero(letters == 10), starts)
        first = np.concatenate([[True], breaks[1:] != breaks[:-1]])
        # cores: without punctuation at the ends, unless nothing else is there
        low, high = starts.copy(), ends.copy()
        cut = np.flatnonzero(EDGE[letters[starts]] | EDGE[letters[ends - 1]])
        if len(cut):
            inner = np.flatnonzero(~EDGE[letters] & ~blank[1:-1])
            a, b = np.searchsorted(inner, starts[cut]), np.searchsorted(inner, ends[cut])
            some = b > a
            low[cut[some]], high[cut[some]] = inner[a[some]], inner[b[some] - 1] + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[letters] * self.up[:n], out=sums[1:])
        codes = mix((sums[high] - sums[low]) * self.down[low] + (high - low).astype(np.uint64)) << np.uint64(3)
        flags = END[letters[ends - 1]].astype(np.uint64) << np.uint64(2)
        flags[UPPER[letters[low]] & (high - low > 1) & LOWER[letters[np.minimum(low + 1, n - 1)]]] |= np.uint64(2)
        for k in np.flatnonzero(DIGIT[letters[low]]).tolist():
            if NUMBER.fullmatch(text, int(low[k]), int(high[k])):
                flags[k] |= np.uint64(1)
        codes |= flags
        wide = np.flatnonzero(letters > 127)
        if len(wide):
            for k in np.unique(np.searchsorted(ends, wide, "right")).tolist():
                codes[k] = self[text[starts[k] : ends[k]]]
        return codes, first, starts


UNIT_HASHES = np.sort(np.array([Templates().of(u) & ~7 & ((1 << 64) - 1) for u in UNITS], np.uint64))
PLACEHOLDER = mix(np.arange(1, 5, dtype=np.uint64))


def _kinds(coded: np.ndarray, first: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, kinds, the words' own hashes, places of words that may be names) of the words of texts; first: those that begin a
    line, heads: the places of those that begin a text."""
    own, flags = coded >> np.uint64(3), coded & np.uint64(7)
    kinds = np.zeros(len(coded), np.uint8)
    begins = first.copy()
    begins[1:] |= (flags[:-1] & np.uint64(4)) != 0
    capital, number = flags & np.uint64(2) != 0, flags & np.uint64(1) != 0
    kinds[capital & ~begins] = NAME
    kinds[number] = NUM
    after = np.zeros(len(coded) + 1, bool)
    after[1:] = number
    after[heads] = False
    after = np.flatnonzero(after[:-1])
    if len(after):
        bare = coded[after] & ~np.uint64(7)
        at = np.minimum(np.searchsorted(UNIT_HASHES, bare), len(UNIT_HASHES) - 1)
        kinds[after[(UNIT_HASHES[at] == bare) & (kinds[after] != NUM)]] = UNIT
    return np.where(kinds == WORD, own, PLACEHOLDER[kinds]), kinds, own, np.flatnonzero(capital & (kinds == WORD))


def template(text: bytes, words: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_kinds() of one text."""
    coded, first, _ = words.coded(text)
    return _kinds(coded, first, np.zeros(1, np.int64))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of PIECE bytes together at most, or of one text."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > PIECE:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if texts:
        yield start, len(texts)


def _sums(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width words the sum of their hashes, each times its place's factor."""
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = total * FACTOR + hashes[k : len(hashes) - width + 1 + k]
    return total


def _windows_at(shown: np.ndarray, kinds: np.ndarray, own: np.ndarray, either: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, names) of each window of width words: the usable templates, then the words themselves (names: -1).

    names has a bit for each word of the window's that may be a name, in order, set where it is taken as one.
    """
    least = min(PLAIN, width)
    plain = np.cumsum(np.concatenate([[0], kinds == WORD]))
    plain = plain[width:] - plain[:-width]
    starts = np.flatnonzero(plain >= least)
    totals, plain, names = _sums(shown, width)[starts], plain[starts], np.zeros(len(starts), np.int64)
    if len(either):
        first = np.searchsorted(either, starts)
        many = np.searchsorted(either, starts + width) - first
        for j in range(int(many.max(initial=0))):
            more = np.flatnonzero((many > j) & (plain > least))
            if not len(more):
                continue
            word = either[first[more] + j]
            changed = totals[more] + (PLACEHOLDER[NAME] - own[word]) * POWERS[width - 1 - (word - starts[more])]
            totals, names = np.concatenate([totals, changed]), np.concatenate([names, names[more] | (1 << j)])
            starts, plain = np.concatenate([starts, starts[more]]), np.concatenate([plain, plain[more] - 1])
            first, many = np.concatenate([first, first[more]]), np.concatenate([many, many[more]])
    words = _sums(own, width)
    hashes = np.concatenate([mix(totals + np.uint64(width)), mix(words + np.uint64(width)) ^ VERBATIM])
    return hashes, np.concatenate([starts, np.arange(len(words))]), np.concatenate([names, np.full(len(words), -1)])


def _slots(kinds: np.ndarray, own: np.ndarray, either: np.ndarray, at: int, width: int, names: int) -> list[int]:
    """The own hashes of the placeholders of a window, in order."""
    here = kinds[at : at + width] != WORD
    if names:
        inside = either[np.searchsorted(either, at) :][: names.bit_length()] - at
        here[inside[[bool(names >> j & 1) for j in range(len(inside))]]] = True
    return own[at : at + width][here].astype(np.int64).tolist()


FOUND = "id long, hash long, at int, names int, slots array<long>"


def _windows_of(batches: Iterator[pa.RecordBatch], table: np.ndarray | None, short: list[int]) -> Iterator[pa.RecordBatch]:
    """The windows whose hash has its bit in the table (without a table: all). short: the widths below WINDOW that the items have."""
    words = Templates()
    for part in slices(batches):
        keys, texts = part.column(0).to_pylist(), utf8(part.column(1))
        for low, high in _groups(texts):
            ids, found = keys[low:high], []
            for w, doc, hashes, at, names, word_at, shape in _windows_in(texts[low:high], words, short):
                if table is not None:
                    bit = mix(hashes) % np.uint64(BITS)
                    kept = (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0
                    doc, hashes, at, names, word_at = doc[kept], hashes[kept], at[kept], names[kept], word_at[kept]
                for c in range(0, len(doc), ROWS):
                    here = slice(c, c + ROWS)
                    for k, hash, place, taken, start in zip(*[x[here].tolist() for x in (doc, hashes.view(np.int64), at, names, word_at)], strict=True):
                        found.append((ids[k], hash, place, taken, [] if taken < 0 else _slots(*shape, start, w, taken)))
                    if len(found) >= ROWS:
                        yield _found(found)
                        found = []
            yield _found(found)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "hash", "at", "names", "slots"])


def _windows_in(texts: list[bytes], words: Templates, short: list[int]) -> Iterator[tuple]:
    """(width, the text's number, hash, place in the text, names, place in shape, shape) of the windows of texts, by width. A text of fewer than
    WINDOW words has one window of them all; it and the others have windows of the short widths too."""
    coded, first, starts = words.coded(b"\n".join(texts))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    heads = np.searchsorted(starts, begin)  # the number of the first word of each text
    sizes = np.diff(heads)
    shown, kinds, own, either = _kinds(coded, first, heads)
    for w in range(1, WINDOW + 1):
        has = (sizes >= w) if w == WINDOW or w in short else sizes == w
        if not has.any():
            continue
        mine, sub = np.flatnonzero(has), (shown, kinds, own, either)
        if len(mine) < len(sizes):
            inside = np.repeat(has, sizes)
            sub = (shown[inside], kinds[inside], own[inside], (np.cumsum(inside) - 1)[either[inside[either]]])
        at = np.concatenate([[0], np.cumsum(sizes[mine])])
        for s in range(0, len(sub[0]) - w + 1, STEP):  # windows that begin in a step; the choices of words and names are many
            e = min(len(sub[0]), s + STEP + w - 1)
            a, b = np.searchsorted(sub[3], [s, e])
            piece = (sub[0][s:e], sub[1][s:e], sub[2][s:e], sub[3][a:b] - s)
            hashes, places, names = _windows_at(*piece, w)
            doc = np.searchsorted(at, places + s, "right") - 1
            whole = places + s + w <= at[doc + 1]
            hashes, places, names, doc = hashes[whole], places[whole], names[whole], doc[whole]
            yield w, mine[doc], hashes, places + s - at[doc], names, places, piece[1:]


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, own, hash, item_at, item_names, item_slots, item_windows, item_templates, width) of the benchmark; own tells the texts of one
    item_id apart; item_templates counts the usable templates."""
    rows = benchmark.select(named(key).cast("long").alias("item"), named(text).alias("text")).where(F.col("item").isNotNull()).distinct()
    rows = rows.withColumn("own", F.xxhash64("item", "text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            widths = {i: min(WINDOW, len(t.split())) for i, t in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True)}
            for batch in _windows_of([part], None, []):
                yield batch.append_column("width", pa.array([widths[i] for i in batch.column("id").to_pylist()], pa.int32()))

    found = rows.select("own", "text").mapInArrow(made, FOUND + ", width int")
    sizes = found.groupBy("id").agg(F.count_if(F.col("names") == -1).alias("item_windows"), F.count_if(F.col("names") == 0).alias("item_templates"))
    return found.join(sizes, "id").join(rows.select("item", F.col("own").alias("id")), "id").select(
        "item", F.col("id").alias("own"), "hash", F.col("at").alias("item_at"), F.col("names").alias("item_names"), F.col("slots").alias("item_slots"), "item_windows", "item_templates", "width"
    )


def bit_table(items: DataFrame) -> bytes:
    """BITS bits, set at the items' hashes; gathered as the distinct bytes that are not zero, BITS / 8 rows at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 3), pa.array((1 << (bit & 7)).astype(np.int64))], names=["byte", "mask"])

    table = np.zeros(BITS // 8, np.uint8)
    for row in items.select("hash").mapInArrow(bits, "byte long, mask long").groupBy("byte").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        table[row["byte"]] = row["mask"]
    return table.tobytes()


def _agreeing(templates):
    """(the item's windows whose slots agree, pairs of values); if those of kind 1 disagree among themselves (0, pairs of equal values)."""
    values: dict[int, int] = {}
    places = set()
    for kind, _, at, pairs in sorted(templates):  # kind 1 first; the others from the fewest slots up
        if kind == 2 and at in places:
            continue
        more: dict[int, int] = {}
        if all(values.get(a, b) == b == more.setdefault(a, b) for a, b in pairs):
            values.update(more)
            places.add(at)
        elif kind == 1:
            return 0, len({a for k, _, _, x in templates for a, b in x if k == 1 and a == b})
    return len(places), len(values)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_agreeing() of each alignment."""
    for part in slices(batches):
        told = [_agreeing([(t["kind"], t["n"], t["item_at"], [tuple(p.values()) for p in t["pairs"]]) for t in row]) for row in part.column(5).to_pylist()]
        columns = [part.column(k) for k in range(5)] + [pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "n_words", "item_windows", "item_templates", "n_templates", "n_slots"])


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, n_windows, item_windows, n_slots) of each document and item whose best alignment is contaminated."""
    spark = docs.sparkSession
    items = saved(item_windows(benchmark), "item-windows")
    table = spark.sparkContext.broadcast(bit_table(items))
    short = [r["width"] for r in items.where(F.col("width") < WINDOW).select("width").distinct().collect()]  # WINDOW - 1 values at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows_of(batches, np.frombuffer(table.value, np.uint8), short)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")
    everywhere = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    found = rows.mapInArrow(run, FOUND).select("*", part).join(everywhere, ["hash", "part"]).where(F.size("slots") == F.size("item_slots"))
    sizes = ["item_windows", "item_templates"]
    pairs = F.arrays_zip("item_slots", "slots")
    kind = F.when(F.col("names") == -1, 0).when((F.col("names") == 0) & (F.col("item_names") == 0), 1).otherwise(2)
    aligned = found.select("id", "item", "own", "item_at", kind.alias("kind"), "item_windows", "item_templates", (F.col("at") - F.col("item_at")).alias("offset"), pairs.alias("pairs"))
    group = ["id", "item", "own", "offset"]
    counted = aligned.groupBy(*group).agg(
        F.countDistinct(F.when(F.col("kind") == 0, F.col("item_at"))).alias("n_words"),
        F.collect_set(F.when(F.col("kind") > 0, F.struct("kind", F.size("pairs").alias("n"), "item_at", "pairs"))).alias("templates"),
        F.first("item_windows").alias("item_windows"),
        F.first("item_templates").alias("item_templates"),
    )
    shown = ["id", "item", "n_words", "item_windows", "item_templates"]
    judged = counted.select(*shown, "templates").mapInArrow(_judged, "id long, item long, n_words long, item_windows long, item_templates long, n_templates long, n_slots long")
    as_words = F.col("n_words") >= F.least(F.lit(HITS), "item_windows")
    as_template = (F.col("item_templates") > 0) & (F.col("n_templates") >= F.least(F.lit(HITS), "item_templates"))
    kept = judged.where(as_words | as_template).select(*group[:2], "item_windows", F.greatest("n_words", "n_templates").alias("n_windows"), "n_slots")
    return kept.groupBy(F.col("id").alias(key), F.col("item").alias("item_id")).agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates."""
    return rows_without(docs, key, matches(docs, benchmark, key, text).select(key))
