"""From a rectangle to half-open key intervals, by descent through quadrants rather than cell by cell.

A quadrant's keys are one interval on either curve, so a quadrant inside the rectangle is taken whole and one
outside is left; the work follows the rectangle's perimeter in cells.
"""

from __future__ import annotations

import heapq
from dataclasses import replace

from tessella.functions.curves import hilbert, morton
from tessella.functions.grid import GridSpec
from tessella.functions.keys import bucket_of

CAP = 64
Ranges = list[tuple[int, int]]


def cells_of(spec: GridSpec, rect: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1), inclusive cells of a closed rectangle, clamped like the points themselves: always a cover."""
    (x0, y0), (x1, y1) = spec.cell(rect[0], rect[1]), spec.cell(rect[2], rect[3])
    return x0, y0, x1, y1


def key_ranges_or_all(spec: GridSpec, rect: tuple[float, float, float, float], on_empty: str = "empty", **options) -> Ranges:
    """key_ranges; for a rectangle without cells, one with its ends in the wrong order, no interval, the interval of all keys ("full") or an error ("raise")."""
    if on_empty not in ("empty", "full", "raise"):
        raise ValueError(f"unknown choice {on_empty}")
    found = key_ranges(spec, rect, **options)
    if not found and on_empty == "raise":
        raise ValueError("the rectangle has no cells")
    return found or ([(0, 1 << 2 * spec.order)] if on_empty == "full" else [])


def key_ranges(spec: GridSpec, rect: tuple[float, float, float, float], curve: str = "hilbert", cap: int | None = CAP, order: int | None = None) -> Ranges:
    """Sorted disjoint [low, high) that hold all keys of the rectangle's cells, at most cap of them. An order other than the
    spec's walks coarser quadrants, or, if finer, smaller cells; the intervals are in keys of the spec's order all the same."""
    if order is not None and order > spec.order:
        if curve != "hilbert":
            raise ValueError("finer orders are for the Hilbert curve")
        return ranges_and_cells(spec, rect, order, cap)[0]
    if rect[0] > rect[2] or rect[1] > rect[3]:
        return []
    x0, y0, x1, y1 = cells_of(spec, rect)
    stop = max(0, spec.order - order) if order is not None else 0
    key = {"hilbert": hilbert, "morton": lambda x, y, p: morton(x, y)}[curve]
    found: Ranges = []
    stack = [(0, 0, spec.order)]
    while stack:
        qx, qy, level = stack.pop()
        left, low, right, high = qx << level, qy << level, ((qx + 1) << level) - 1, ((qy + 1) << level) - 1
        if left > x1 or right < x0 or low > y1 or high < y0:
            continue
        if level <= stop or (left >= x0 and right <= x1 and low >= y0 and high <= y1):
            depth = spec.order - level
            first = key(qx, qy, depth) << 2 * level if depth else 0
            found.append((first, first + (1 << 2 * level)))
        else:
            stack.extend((2 * qx + a, 2 * qy + b, level - 1) for a in (0, 1) for b in (0, 1))
    return capped(merged(found), cap)


def merged(ranges: Ranges) -> Ranges:
    """Sorted, with touching and overlapping intervals joined."""
    out: Ranges = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def capped(ranges: Ranges, cap: int | None) -> Ranges:
    """At most cap intervals: the intervals are cut apart only at the cap - 1 widest gaps, of equal ones at the later."""
    if cap is None or len(ranges) <= cap:
        return ranges
    gaps = [(after[0] - before[1], place) for place, (before, after) in enumerate(zip(ranges, ranges[1:]))]
    cuts = sorted(place for _, place in heapq.nlargest(cap - 1, gaps))
    firsts, lasts = [0, *[c + 1 for c in cuts]], [*cuts, len(ranges) - 1]
    return [(ranges[i][0], ranges[j][1]) for i, j in zip(firsts, lasts, strict=True)]


def ranges_and_cells(spec: GridSpec, rect: tuple[float, float, float, float], order: int | None = None, cap: int | None = CAP) -> tuple[Ranges, int]:
    """key_ranges on a grid of any order, and the number of that grid's cells in the cover before the cap. The intervals are in keys
    of the spec's order: those of a finer grid are cut down to it, which leaves out cells that the rectangle only seems to touch."""
    order = spec.order if order is None else order
    if order <= spec.order:
        found = key_ranges(spec, rect, cap=None, order=order)
        return capped(found, cap), sum(high - low for low, high in found) >> 2 * (spec.order - order)
    fine = key_ranges(replace(spec, order=order), rect, cap=None)
    shift = 2 * (order - spec.order)
    return capped(merged([(low >> shift, ((high - 1) >> shift) + 1) for low, high in fine]), cap), sum(high - low for low, high in fine)


def buckets_of(ranges: Ranges, buckets: int, order: int) -> list[int]:
    """The buckets that hold keys of the intervals."""
    return sorted({b for low, high in ranges for b in range(bucket_of(low, buckets, order), bucket_of(high - 1, buckets, order) + 1)})


def composite_ranges(ranges: Ranges, codes: list[int]) -> Ranges:
    """The intervals within each class; ends are added, so an end of 2^48 does not reach the class bits by OR."""
    return merged([((code << 48) + low, (code << 48) + high) for code in codes for low, high in ranges])
