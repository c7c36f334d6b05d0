"""Analytical models of pruning, cost and bucket size: small functions on the driver."""

from __future__ import annotations

import math

#: Curve constants, published fits.
CURVE = {"hilbert": 2.0, "morton": 3.2}
CALIBRATED = 2.03


def expected_buckets(fraction: float, buckets: int, c: float = CURVE["hilbert"]) -> float:
    """Buckets that a rectangle of an area fraction meets: its share and its border, at most all."""
    return min(fraction * buckets + c * math.sqrt(fraction * buckets), buckets)


def pruning_rate(fraction: float, buckets: int, c: float = CURVE["hilbert"]) -> float:
    return 1 - expected_buckets(fraction, buckets, c) / buckets


def density_constant(cv: float | None) -> float:
    """The curve constant for a coefficient of variation of tile densities."""
    return CALIBRATED if cv is None else 1.5 + 0.75 * cv


def implied_constant(seen: float, fraction: float, buckets: int) -> float:
    """The constant that would have predicted the buckets seen."""
    return (seen - fraction * buckets) / math.sqrt(fraction * buckets)


def false_positive_bound(fraction: float, order: int) -> float:
    """A cover's largest share of points outside the rectangle, for uniform points."""
    return 4 / (math.sqrt(fraction) * (1 << order))


def bucket_cost(target: float, n: int, fraction: float, alpha: float = 0.05, per_object: float = 2e-5, c: float = CALIBRATED) -> float:
    """Milliseconds at a bucket size: overhead of the buckets met and objects read in them."""
    b = max(1.0, n / target)
    met = expected_buckets(fraction, b, c)
    return alpha * met + per_object * met * n / b


def best_target(n: int, fraction: float, low: float = 1_000, high: float = 1_000_000, tolerance: float = 1.0, **cost: float) -> float:
    """The bucket size of least cost by golden-section search on its logarithm; the cost has one valley there."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    f = lambda t: bucket_cost(math.exp(t), n, fraction, **cost)
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = f(x), f(y)
    while math.exp(b) - math.exp(a) > tolerance:
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - ratio * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (b - a)
            fy = f(y)
    return math.exp((a + b) / 2)


def partition_ceiling(planning_ms: float, alpha: float) -> int:
    """The number of partitions whose planning fits the time."""
    return int(planning_ms / alpha)


def choose_layout(n_objects: int, n_groups: int, ceiling: int, target: int = 50_000) -> str:
    """Two levels if their partitions fit under the ceiling, else one level if the groups do, else none."""
    if sum([max(1, n_objects // max(1, n_groups) // target)]) * n_groups <= ceiling:
        return "two_level"
    return "grouped_clustered" if n_groups <= ceiling else "mono_clustered"


#: The mixed workload: shares of rectangle, neighbour, tile and class queries.
MIX = {"viewport": 0.70, "knn": 0.15, "tiles": 0.10, "classes": 0.05}


def workload_cost(n: int, buckets: int, mix: dict[str, float] | None = None, alpha: float = 0.051, per_object: float = 2e-5) -> float:
    """Mean cost of a query on one group with that many buckets."""
    mix = MIX if mix is None else mix
    rect = lambda f: (alpha + per_object * n / buckets) * expected_buckets(f, buckets, CALIBRATED)
    each = {"viewport": rect(0.05), "knn": rect(min(1.0, 400 / max(n, 1))), "tiles": alpha * buckets + per_object * n, "classes": rect(0.02)}
    return sum(share * each[k] for k, share in mix.items())


def allocate(counts: dict[str, int], budget: int) -> dict[str, int]:
    """Buckets per group within a budget: one each, then always to the group that gains most, while any gains."""
    import heapq

    if budget < len(counts):
        raise ValueError("the budget is smaller than the number of groups")
    out = dict.fromkeys(counts, 1)
    gain = lambda g: workload_cost(counts[g], out[g]) - workload_cost(counts[g], out[g] + 1)
    heap = [(-gain(g) * counts[g], g) for g in sorted(counts)]
    heapq.heapify(heap)
    for _ in range(budget - len(counts)):
        worth, g = heapq.heappop(heap)
        if worth >= 0:
            break
        out[g] += 1
        heapq.heappush(heap, (-gain(g) * counts[g], g))
    return out


def allocate_uniform(counts: dict[str, int], budget: int) -> dict[str, int]:
    if budget < len(counts):
        raise ValueError("the budget is smaller than the number of groups")
    each, rest = divmod(budget, len(counts))
    return {g: each + (i < rest) for i, g in enumerate(sorted(counts))}


def allocate_proportional(counts: dict[str, int], budget: int) -> dict[str, int]:
    """One each, the rest by size; fractions are rounded up from the largest."""
    if budget < len(counts):
        raise ValueError("the budget is smaller than the number of groups")
    total, spare = sum(counts.values()) or 1, budget - len(counts)
    shares = {g: spare * n / total for g, n in counts.items()}
    out = {g: 1 + int(s) for g, s in shares.items()}
    for g in sorted(counts, key=lambda g: (int(shares[g]) - shares[g], g))[: budget - sum(out.values())]:
        out[g] += 1
    return out


def compare_allocations(counts: dict[str, int], budget: int) -> list[tuple[str, int, float]]:
    """(strategy, buckets used, mean cost by objects) of the three allocations."""
    total = sum(counts.values()) or 1
    plans = {"optimal": allocate(counts, budget), "uniform": allocate_uniform(counts, budget), "proportional": allocate_proportional(counts, budget)}
    return [(k, sum(p.values()), sum(counts[g] / total * workload_cost(counts[g], b) for g, b in p.items())) for k, p in plans.items()]
