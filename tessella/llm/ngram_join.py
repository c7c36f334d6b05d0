"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have a similarity of 0.8 or more.

1. Each text becomes its set of shingle hashes and a sketch of 128 min-wise values, of which 16 bits are kept:
   all low bytes, then all high bytes. Texts with one set are one class; classes go on, copies do not.
2. Chosen paths: RUNS trees split the classes. At each node the path's hash samples two coordinates of the
   sketch, and a class goes to the child named by its value there, so sets meet where they share sampled
   tokens. Two levels are taken at once; buckets above BUCKET classes are split further, unless children above
   half of BUCKET keep most of them (then they are truly similar, and splitting only multiplies them). A pair of similarity
   0.8 meets in one run with probability 0.94 (p = 1 - (1 - 0.8 p')^2 over four levels or fewer), in all RUNS
   with 1 - 0.06^RUNS, above TARGET_RECALL; RUNS is the least number that reaches it.
3. Buckets are compared by sketch; pairs far below the threshold are dropped, the others joined to
   candidate components, of which only a spanning forest is written.
4. Each candidate component meets once with its full sets, and its pairs are verified exactly. A class's links are counted
   there; again only a spanning forest leaves the task.

Groups of near copies, of any size, cost time in proportion to their members and not to their pairs. In a bucket of more than
BUCKET classes each member's sketch is compared with one center; two members that both agree with it in enough places must
agree with each other, so these form the core, and an edge to the center is all they need. In a component of more than BLOCK classes
the center is a set C, the shingles that most of about BLOCK members have. A member that lacks d of them and adds a others has the
load w = 5d + 4a; two members share |C| - d1 - d2 shingles or more, of |C| + a1 + a2 or fewer, so they are linked for
certain if w1 + w2 <= |C|. Members with 2w <= |C|, the core, are all linked to each other: their links are counted, not
compared. Only the rim, the members outside the core, is compared, in blocks, with all members. Which members serve as
center decides only how large the rim is, never a result, so no pair is lost to a cap.

Cases: a null or empty text, or one without words, has no set: all such are copies of each other, linked to
nothing else; a text of fewer than five words has one shingle of all its words. A row with a null doc_id is
returned with nulls. Rows with one doc_id are one document if equal; unequal texts under one doc_id are linked.
Ties go to the smallest doc_id. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WordHashes, mix, named, rows_without, saved, slices, utf8, windows
from tessella.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
SKETCH, BRANCH = 128, 2
TARGET_RECALL = 0.9999
BUCKET, BLOCK, MAX_LEVELS = 2048, 256, 7
#: A bucket whose large children keep this share of its members is one group of similar sets, which no split would part.
DENSE = 0.5
#: Buckets compare the lowest byte of each sketch value. Sketches that agree in less than this share belong to pairs
#: below the threshold: 5.1 standard errors away.
LEAST_AGREEMENT = THRESHOLD - 5.1 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)


def run_recall(levels: int, similarity: float = THRESHOLD) -> float:
    """The chance that a pair meets at the given depth of one tree."""
    met = 1.0
    for _ in range(levels):
        met = 1 - (1 - similarity * met) ** BRANCH
    return met


RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - run_recall(MAX_LEVELS)))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's five-word shingles."""
    return np.unique(windows(hashes.array(text.split()), WIDTH))


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * SKETCH + 1, dtype=np.uint64)
    return mix(seeds[:SKETCH]) | np.uint64(1), mix(seeds[SKETCH:])


def sketch(items: np.ndarray) -> np.ndarray:
    """SKETCH min-wise values of a set."""
    a, b = _multipliers()
    best = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 1024):
        part = ((items[at : at + 1024, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def children(paths: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """The BRANCH child paths of each (path, sketch) row: coordinates are sampled by the path alone."""
    rows = np.arange(len(paths))
    out = []
    for branch in range(BRANCH):
        coordinate = mix(paths ^ mix(np.array([branch + 77], np.uint64))) % np.uint64(SKETCH)
        value = sketches[rows, coordinate.astype(np.int64)].astype(np.uint64)
        out.append(mix(paths + mix(value + (coordinate << np.uint64(33)) + np.uint64(branch))))
    return np.stack(out, axis=1)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in slices(batches):
        sets = [shingles(t, hashes) for t in utf8(part.column(1))]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        sketches = [sketch(s) if len(s) else None for s in sets]
        packed = pa.array([None if x is None else x.astype(np.uint8).tobytes() + (x >> 8).astype(np.uint8).tobytes() for x in sketches], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), packed], names=["id", "a", "b", "sketch"])


def _bytes(column: pa.Array) -> np.ndarray:
    """A row of SKETCH bytes for each value, or two: its low bytes and its high bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _values(column: pa.Array) -> np.ndarray:
    planes = _bytes(column)
    return planes[::2] | planes[1::2].astype(np.uint16) << 8


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1024):
        sketches = _values(part.column(1))
        paths = []
        for run in range(RUNS):
            for first in children(np.full(len(sketches), run + 1, np.uint64), sketches).T:
                paths.extend(children(first, sketches).T)
        flat = np.stack(paths, axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "paths"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1024):
        parents, reps = part.column("path").to_numpy(), part.column("rep").to_numpy()
        below = children(parents.view(np.uint64), _values(part.column("sketch"))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(parents, BRANCH)), pa.array(below.T.ravel()), pa.array(np.tile(reps, BRANCH))], names=["parent", "path", "rep"])


class Forest:
    """Union-find over the positions of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, of input sorted by them; a run may span batches."""
    kept, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            own = tuple(c[start] for c in cols)
            if kept and own != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(start, end - start))
            last = own
    if kept:
        yield pa.Table.from_batches(kept)


def _blocked(df: DataFrame, block: int) -> DataFrame:
    """df (rep, core, n_rim, n_core, ...) gets own, bi, bj: the rim of a group is cut into blocks of about block rows, numbered before
    those of its core, and each row goes to every pair of blocks that has its own and one of the rim."""
    rim, core = (F.ceil(F.col(c) / F.lit(block)).cast("long") for c in ("n_rim", "n_core"))
    part = F.xxhash64("rep")
    own = F.when(F.col("core"), rim + F.pmod(part, F.greatest(core, F.lit(1)))).otherwise(F.pmod(part, F.greatest(rim, F.lit(1))))
    met = df.where("n_rim > 0").withColumn("own", own)
    other = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("core"), rim - 1).otherwise(rim + core - 1))))
    return other.withColumns({"bi": F.least("own", "_other"), "bj": F.greatest("own", "_other")}).drop("_other", "core", "n_rim", "n_core")


def _dealt(df: DataFrame, block: int) -> DataFrame:
    """df (rep, members, ...) with part: large groups are dealt to parts of about block rows."""
    return df.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / F.lit(block)).cast("long")))


def _to_parts(facts: DataFrame, block: int) -> DataFrame:
    """A row of facts about a group for each of its parts, so that a group's rows meet their facts in many tasks."""
    return facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / F.lit(block)).cast("long") - 1))).drop("members")


def _sketch_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a row's sketch agrees with its center's so well that any two such rows agree enough."""
    for batch in batches:
        agree = (_bytes(batch.column("low")) == _bytes(batch.column("center"))).sum(axis=1)
        core = pa.array(2 * agree >= SKETCH + LEAST_AGREEMENT * SKETCH)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "part", "rep", "hub")], core], names=["path", "part", "rep", "hub", "core"])


def _set_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether twice a row's load is within the size of its center."""
    for part in slices(batches):
        core = []
        for own, center in zip(part.column("items").to_pylist(), part.column("center"), strict=True):
            own, center = np.frombuffer(own, np.uint64), np.sort(center.values.to_numpy().view(np.uint64))
            both = int(np.isin(own, center, assume_unique=True, kind="sort").sum())
            core.append(2 * (5 * (len(center) - both) + 4 * (len(own) - both)) <= len(center))
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("comp", "part", "rep", "n_docs")], pa.array(core, pa.bool_())], names=["comp", "part", "rep", "n_docs", "core"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [np.frombuffer(x, np.int64) for x in part.column("items").to_pylist()]
        comps = np.repeat(part.column("comp").to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(comps), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["comp", "item"])


def _sides(rows: DataFrame, by: str) -> DataFrame:
    """(by, members, n_rim, n_core) of the groups of rows."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("core")).alias("n_rim"), F.count_if("core").alias("n_core"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of each bucket whose sketches agree enough."""
    for part in groups(batches, ["path", "bi", "bj"]):
        reps, own = part.column("rep").to_numpy(), part.column("own").to_numpy()
        order = np.lexsort((reps, own))
        reps, own = reps[order], own[order]
        sketches = _bytes(part.column("low"))[order]
        split = int(np.searchsorted(own, part.column("bj")[0].as_py())) if part.column("bi")[0] != part.column("bj")[0] else 0
        if split == len(reps) or (split == 0 and part.column("bi")[0] != part.column("bj")[0]):
            continue
        forest = Forest(len(reps))
        for x in range(split or len(reps) - 1):  # each item against the later ones, or against the other block
            first = split or x + 1
            alike = first + np.flatnonzero((sketches[first:] == sketches[x]).sum(axis=1) >= LEAST_AGREEMENT * SKETCH)
            forest.join(np.stack([np.full(len(alike), x), alike], axis=1))
        edges = [(reps[x], reps[forest.root(x)]) for x in range(len(reps)) if forest.root(x) != x]
        if edges:
            u, v = np.array(edges, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections, by products of 0/1 matrices over slices of the vocabulary."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    items = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    vocabulary, inverse, uses = np.unique(items, return_inverse=True, return_counts=True)
    common = uses[inverse] > 1
    rows, inverse = rows[common], (np.cumsum(uses > 1) - 1)[inverse[common]]
    order = np.argsort(inverse, kind="stable")
    rows, inverse = rows[order], inverse[order]
    for low in range(0, int((uses > 1).sum()), 4096):
        a, b = np.searchsorted(inverse, [low, low + 4096])
        cells = np.zeros((n, 4096), np.float32)
        cells[rows[a:b], inverse[a:b] - low] = 1
        out += cells @ cells.T
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a block pair: the documents it is linked to, and a class it hangs on in the spanning forest."""
    for part in groups(batches, ["comp", "bi", "bj"]):
        reps, own, weight = (part.column(c).to_numpy() for c in ("rep", "own", "n_docs"))
        sets = [np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.float64)
        both = shared_counts(sets).astype(np.float64)
        alike = both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(alike, False)
        if part.column("bi")[0] != part.column("bj")[0]:
            alike &= own[:, None] != own[None, :]
        forest = Forest(len(reps))
        order = np.argsort(reps, kind="stable")
        i, j = np.nonzero(np.triu(alike[np.ix_(order, order)], 1))
        forest.join(np.stack([i, j], axis=1))
        hangs = np.empty(len(reps), np.int64)
        hangs[order] = reps[order][[forest.root(x) for x in range(len(reps))]]
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(hangs), pa.array((alike * weight[None, :]).sum(axis=1).astype(np.int64))], names=["rep", "hangs", "links"])


def buckets(classes: DataFrame) -> DataFrame:
    """(path, rep, members) of all buckets of two classes or more that are to be compared."""
    light = classes.where(F.col("sketch").isNotNull()).select("rep", "sketch")
    rows = saved(light.mapInArrow(_roots, "rep long, paths array<long>").select(F.explode("paths").alias("path"), "rep"), "paths")
    done = []
    for level in range(2, MAX_LEVELS + 1):
        sizes = saved(rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
        large = sizes.where(F.col("members") > BUCKET)
        if level == MAX_LEVELS or large.limit(1).count() == 0:
            done.append(rows.join(sizes.hint("merge"), "path"))
            break
        split = rows.join(large.select("path"), "path").join(light, "rep").select("path", "rep", "sketch")
        below = saved(split.mapInArrow(_deeper, "parent long, path long, rep long"), "paths")
        met = below.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET // 2).groupBy("parent").agg(F.sum("n").alias("n"))
        parted = large.join(met.select(F.col("parent").alias("path"), "n"), "path", "left").where(F.coalesce("n", F.lit(0)) < DENSE * BRANCH * F.col("members"))
        parted = saved(parted.select("path"), "parted")
        done.append(rows.join(sizes.join(parted, "path", "left_anti"), "path"))
        rows = saved(below.join(parted.select(F.col("path").alias("parent")), "parent").select("path", "rep"), "paths")
    return reduce(DataFrame.unionByName, [x.select("path", "rep", "members") for x in done])


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the pairs of classes whose sketches agree enough in some bucket."""
    met = buckets(classes)
    low = classes.select("rep", F.substring("sketch", 1, SKETCH).alias("low")).hint("merge")  # merge: this side grows with the data at every size
    alone = met.where(F.col("members") <= BUCKET).withColumns({"core": F.lit(False), "n_rim": F.col("members"), "n_core": F.lit(0).cast("long")}).drop("members")
    large = met.where(F.col("members") > BUCKET)
    stars = None
    if large.limit(1).count():
        large = saved(_dealt(large, BUCKET).join(low, "rep"), "large")
        first = F.xxhash64("rep")
        center = large.groupBy("path").agg(F.min_by("low", first).alias("center"), F.min_by("rep", first).alias("hub"), F.count(F.lit(1)).alias("members"))
        judged = large.select("path", "part", "rep", "low").join(_to_parts(center, BUCKET), ["path", "part"])
        judged = saved(judged.mapInArrow(_sketch_core, "path long, part long, rep long, hub long, core boolean"), "cores")
        stars = judged.where(F.col("core") & (F.col("rep") != F.col("hub"))).select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v"))
        rest = judged.join(_to_parts(_sides(judged, "path"), BUCKET), ["path", "part"]).select("path", "rep", "core", "n_rim", "n_core")
        alone = alone.unionByName(rest)
    order = ["path", "bi", "bj"]
    pairs = _blocked(alone, BUCKET).join(low, "rep")
    edges = pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(_candidates, "u long, v long")
    return (edges if stars is None else edges.unionByName(stars)).distinct()


def verified_links(source: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, hangs, links): the exact links within the components of members (rep, comp, n_docs), in parts to be added up."""
    counts = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    texts = source.join(members.join(counts, "comp").hint("merge"), F.col("id") == F.col("rep")).select("rep", "comp", "n_docs", "members", "text")
    sets = texts.mapInArrow(_sets, "rep long, comp long, n_docs long, members long, items binary")
    sides = {"core": F.lit(False), "n_rim": F.col("members"), "n_core": F.lit(0).cast("long")}
    shown = ["rep", "comp", "n_docs", "items", "core", "n_rim", "n_core"]
    certain = None
    if counts.where(F.col("members") > BLOCK).limit(1).count():
        sets = saved(sets, "sets")
        large = _dealt(sets.where(F.col("members") > BLOCK), BLOCK)
        some = large.where("part = 0").select("comp", "items")
        asked = some.groupBy("comp").agg(F.count(F.lit(1)).alias("asked"))
        usual = some.mapInArrow(_shingle_rows, "comp long, item long").groupBy("comp", "item").agg(F.count(F.lit(1)).alias("n")).join(asked, "comp").where("2 * n > asked")
        center = usual.groupBy("comp").agg(F.collect_list("item").alias("center"))  # at most twice as many as a set has on average
        known = counts.where(F.col("members") > BLOCK).join(center, "comp", "left").withColumn("center", F.coalesce("center", F.array().cast("array<long>")))
        judged = large.select("comp", "part", "rep", "n_docs", "items").join(_to_parts(known, BLOCK), ["comp", "part"])
        judged = saved(judged.mapInArrow(_set_core, "comp long, part long, rep long, n_docs long, core boolean"), "cores")
        of_core = judged.where("core").groupBy("comp").agg(F.sum("n_docs").alias("docs"), F.min("rep").alias("hub"))
        facts = _to_parts(_sides(judged, "comp").join(of_core, "comp", "left"), BLOCK)
        met = judged.join(facts, ["comp", "part"])
        certain = met.where("core").select("rep", F.col("hub").alias("hangs"), (F.col("docs") - F.col("n_docs")).alias("links"))
        rest = met.where("n_rim > 0").select("rep", "comp", "n_docs", "core", "n_rim", "n_core").join(sets.select("rep", "items").hint("merge"), "rep")
        sets = sets.where(F.col("members") <= BLOCK).withColumns(sides).select(*shown).unionByName(rest.select(*shown))
    else:
        sets = sets.withColumns(sides).select(*shown)
    order = ["comp", "bi", "bj"]
    checked = _blocked(sets, BLOCK).repartition(*order).sortWithinPartitions(*order).mapInArrow(_verified, "rep long, hangs long, links long")
    return checked if certain is None else checked.unionByName(certain)


def joined(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: key, class_id (the smallest id of its connected group), copy_id (the smallest id with the same
    set of shingles), n_links (the other rows of similarity 0.8 or more, copies included)."""
    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = saved(source.mapInArrow(_sketched, "id long, a long, b long, sketch binary"), "sketches")
    found = rows.where(F.col("id").isNotNull()).groupBy("a", "b").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("sketch").alias("sketch")
    )
    found = saved(found, "classes")

    parts = components(candidate_edges(found))
    members = saved(parts.join(found.select(F.col("rep").alias("id"), "n_docs"), "id").select(F.col("id").alias("rep"), "comp", "n_docs"), "members")
    links = saved(verified_links(source, members), "links")

    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(links.where("rep <> hangs").select(F.col("rep").alias("u"), F.col("hangs").alias("v")).distinct())
    verdicts = found.join(linked, "rep", "left").join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left").select(
        "a", "b", "rep", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")
    )
    out = rows.select("id", "a", "b").join(verdicts, ["a", "b"], "left")
    given = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(key), F.when(given, F.col("class_id")).alias("class_id"), F.when(given, F.col("rep")).alias("copy_id"), F.when(given, F.col("n_links")).alias("n_links")
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in slices(batches):
        items = [shingles(t, hashes).tobytes() for t in utf8(part.column(4))]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(items, pa.binary())], names=["rep", "comp", "n_docs", "members", "items"])


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df but those whose group has a smaller id."""
    extra = joined(df, key, text).where(named(key) != F.col("class_id")).select(key)
    return rows_without(df, key, extra)
