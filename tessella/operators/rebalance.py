"""Buckets of unequal intervals: layouts with a number of buckets per group, and splits and merges of stored buckets carried out in one rewrite."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import keys
from tessella.functions.grid import GridSpec
from tessella.operators import layout
from tessella.operators.select import Rect, place_among, viewport
from tessella.plans import ranges as R
from tessella.sources.shared import removed

#: Per group the buckets (first key, bucket) in order of keys; a bucket's keys end where the next one's begin.
Bounds = dict[str, list[tuple[int, int]]]


def uniform(buckets: dict[str, int], order: int) -> Bounds:
    """The equal intervals of each group's number of buckets; buckets without keys are left out."""
    out = {}
    for group, n in buckets.items():
        cut = [(keys.bucket_interval(b, n, order), b) for b in range(n)]
        out[group] = [(low, b) for (low, high), b in cut if low < high]
    return out


def interval(bounds: Bounds, group: str, bucket: int, order: int) -> tuple[int, int]:
    own = bounds[group]
    at = next((k for k, (_, b) in enumerate(own) if b == bucket), None)
    if at is None:
        raise KeyError(f"group {group} has no bucket {bucket}")
    return own[at][0], own[at + 1][0] if at + 1 < len(own) else 1 << 2 * order


def split(bounds: Bounds, group: str, bucket: int, order: int, at: int | None = None) -> Bounds:
    """bounds with a bucket cut at a key, by default the middle one: what lies above gets a number of its own. A bucket of one key stays."""
    low, high = interval(bounds, group, bucket, order)
    at = (low + high) // 2 if at is None else at
    if high - low < 2:
        return bounds
    if not low < at < high:
        raise ValueError("the cut must be inside the bucket")
    new = max(b for _, b in bounds[group]) + 1
    return {**bounds, group: sorted([*bounds[group], (at, new)])}


def merge(bounds: Bounds, group: str, bucket: int, into: int) -> Bounds:
    """bounds with the keys of a bucket given to a neighbour."""
    places = [b for _, b in bounds[group]]
    a, b = places.index(bucket), places.index(into)
    if abs(a - b) != 1:
        raise ValueError("only neighbours can be merged")
    own = [(low, into if n == bucket else n) for low, n in bounds[group]]
    del own[max(a, b)]
    return {**bounds, group: own}


def advised(bounds: Bounds, advice: Iterable[tuple[str, int, str]], order: int) -> Bounds:
    """bounds after advice (group, bucket, 'split' or 'merge': with the next bucket by keys). What concerns a bucket that has gone is left out."""
    for group, bucket, what in sorted(advice, key=lambda a: (a[2] != "split", a[0], a[1])):
        places = [b for _, b in bounds.get(group, [])]
        if bucket not in places:
            continue
        if what == "split":
            bounds = split(bounds, group, bucket, order)
        elif places.index(bucket) + 1 < len(places):
            bounds = merge(bounds, group, places[places.index(bucket) + 1], bucket)
    return bounds


def bucket_of_key(bounds: Bounds, key: str = "h_key") -> Column:
    """The bucket of group_id and a key; null for groups without bounds."""
    cases = [f"WHEN {_quoted(g)} THEN element_at(array({', '.join(str(b) for _, b in own)}), {place_among([low for low, _ in own], key)})" for g, own in bounds.items() if own]
    return F.expr(f"CASE group_id {' '.join(cases)} END").cast("int") if cases else F.lit(None).cast("int")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def met(own: list[tuple[int, int]], found: R.Ranges, order: int) -> list[int]:
    """A group's buckets that hold keys of the intervals."""
    ends = [low for low, _ in own[1:]] + [1 << 2 * order]
    return sorted(b for (low, b), high in zip(own, ends, strict=True) if any(a < high and low < z for a, z in found))


def viewport_bounded(df: DataFrame, spec: GridSpec, rect: Rect, bounds: Bounds, group: str | None = None, cap: int = R.CAP) -> DataFrame:
    """The rectangle over a layout of such buckets: each group's own bucket numbers prune its folders, groups with the same list share a term;
    key ranges and the exact test follow."""
    found = R.key_ranges(spec, rect, cap=cap)
    lists: dict[tuple[int, ...], list[str]] = {}
    for g, own in bounds.items():
        if group is None or g == group:
            lists.setdefault(tuple(met(own, found, spec.order)), []).append(g)
    terms = [F.col("group_id").isin(names) & F.col("bucket").isin(list(numbers)) for numbers, names in lists.items() if numbers]
    from tessella.operators.select import in_ranges

    return viewport(df, rect, group).where(in_ranges("h_key", found)).where(reduce(lambda a, b: a | b, terms, F.lit(False)))


def write_budgeted(df: DataFrame, path: str, spec: GridSpec, buckets: dict[str, int]) -> Bounds:
    """Objects with keys as a layout of two levels with each group's own number of buckets; its bounds."""
    bounds = uniform(buckets, spec.order)
    layout.write(df.withColumn("bucket", bucket_of_key(bounds)), path, "two_level", order=spec.order)
    return bounds


def rebalanced(spark: SparkSession, path: str, before: Bounds, after: Bounds, order: int) -> int:
    """Rewrites the folders of buckets whose keys differ between the bounds, and no others, in one job; then removes folders of buckets that have gone.
    The number of buckets rewritten. Run again after a failure it does the same, since rows go by their keys."""
    spans = lambda bounds: {(g, b, *interval(bounds, g, b, order)) for g, own in bounds.items() for _, b in own}
    changed = {(g, b) for g, b, _, _ in spans(before) ^ spans(after)}
    if not changed:
        return 0
    table = spark.read.parquet(path)
    by_group: dict[str, list[int]] = {}
    for g, b in changed:
        by_group.setdefault(g, []).append(b)
    touched = reduce(lambda a, b: a | b, [(F.col("group_id") == g) & F.col("bucket").isin(n) for g, n in by_group.items()])
    rows = table.where(touched)
    gone = changed - {(g, b) for g, own in after.items() for _, b in own}
    files = rows.where(reduce(lambda a, b: a | b, [(F.col("group_id") == g) & (F.col("bucket") == b) for g, b in gone])) if gone else None
    folders = {r[0].rsplit("/", 1)[0] for r in files.select(F.input_file_name()).distinct().collect()} if gone else set()  # a few buckets' files
    moved = rows.withColumn("bucket", bucket_of_key({g: after[g] for g in by_group}))
    layout.replace_partitions(spark, moved.select(*table.columns), path, ["group_id", "bucket"])
    for folder in folders:
        removed(spark, folder)
    spark.catalog.refreshByPath(path)
    return len(changed)
