"""Small summaries of one group in numpy: what a task adds values to, and what merges.

Each is a pair of arrays: values in ascending order and their weights (or gaps); see the functions.
"""

from __future__ import annotations

import numpy as np


def _sorted(values: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(values, kind="stable")
    return [np.asarray(x, float)[order] for x in (values, *others)]


def _alternate(chosen: np.ndarray) -> np.ndarray:
    """Of indices in ascending order, every second one of each run of consecutive ones, from its first."""
    place = np.arange(len(chosen))
    start = np.maximum.accumulate(np.where(np.diff(chosen, prepend=-2) != 1, place, 0))
    return chosen[(place - start) % 2 == 0]


def nearest_merged(centers: np.ndarray, counts: np.ndarray, size: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """At most size centers with counts, none nearer than least to the next: the nearest neighbours become their weighted mean.

    A round merges those of the nearest quarter of neighbours that share no center, so that rounds
    grow with the logarithm of the number of values.
    """
    x, n = _sorted(centers, counts)
    while len(x) > 1:
        gaps = np.diff(x)
        over, near = len(x) - size, int((gaps < least).sum())
        most = max(over, near)
        if most <= 0:
            break
        order = np.argsort(gaps, kind="stable")
        i = _alternate(np.sort(order[: max(near, min(over, len(x) // 4 + 1))]))
        if len(i) > most:
            i = np.sort(i[np.argsort(gaps[i], kind="stable")[:most]])
        total = n[i] + n[i + 1]
        x[i] = (x[i] * n[i] + x[i + 1] * n[i + 1]) / total
        n[i] = total
        x, n = np.delete(x, i + 1), np.delete(n, i + 1)
    return x, n


def _trapezoids(centers: np.ndarray, counts: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of the trapezoids between neighbouring centers, from lo to hi: places, heights, and the count below each."""
    x, m = np.concatenate([[lo], centers, [hi]]), np.concatenate([[0.0], counts, [0.0]])
    return x, m, np.concatenate([[0.0], np.cumsum((m[1:] + m[:-1]) / 2)])


def trapezoid_share(centers: np.ndarray, counts: np.ndarray, lo: float, hi: float, x: float) -> float:
    """The share of values up to x: half of each center's count on either side of it, in a trapezoid between the heights of two."""
    if x < lo:
        return 0.0
    if x >= hi:
        return 1.0
    at, m, below = _trapezoids(centers, counts, lo, hi)
    i = int(np.searchsorted(at, x, "right")) - 1
    z = (x - at[i]) / (at[i + 1] - at[i])
    return float((below[i] + m[i] * z + (m[i + 1] - m[i]) * z * z / 2) / below[-1])


def trapezoid_quantiles(centers: np.ndarray, counts: np.ndarray, lo: float, hi: float, ps) -> list[float]:
    """Where trapezoid_share reaches each p: the root of a trapezoid's quadratic, in the form that divides by no small number."""
    at, m, below = _trapezoids(centers, counts, lo, hi)
    target = np.clip(np.asarray(ps, float), 0.0, 1.0) * below[-1]
    i = np.clip(np.searchsorted(below, target, "left") - 1, 0, len(at) - 2)
    over = np.maximum(target - below[i], 0.0)
    root = np.sqrt(np.maximum(m[i] ** 2 + 2 * (m[i + 1] - m[i]) * over, 0.0))
    z = np.divide(2 * over, m[i] + root, out=np.zeros_like(over), where=m[i] + root > 0)
    return (at[i] + np.clip(z, 0.0, 1.0) * (at[i + 1] - at[i])).tolist()


def share_below(centers: np.ndarray, counts: np.ndarray, lo: float, hi: float, x: float) -> float:
    """The share of values up to x, half of each center's count on either side of it, straight between centers."""
    if x < lo:
        return 0.0
    if x >= hi:
        return 1.0
    upto = (np.cumsum(counts) - counts / 2) / counts.sum()
    return float(np.interp(x, np.concatenate([[lo], centers, [hi]]), np.concatenate([[0.0], upto, [1.0]])))


def drawn(values: np.ndarray, *seeds: float) -> np.random.Generator:
    """A generator that is the same for the same values, and another for those of another task or batch."""
    return np.random.default_rng([*map(int, seeds), *np.ascontiguousarray(values[:4], float).view(np.uint32).tolist()])


def buffer_sizes(error: float) -> tuple[int, int, int]:
    """(room, size, full): how many values buffers for a rank error hold in all, how many one holds, and how many values enter before sampling starts.

    With h levels of halving there are h + 1 buffers. Sampling starts late enough that its own
    deviation at the median is at most a quarter of the error.
    """
    h = max(1, int(np.ceil(np.log2(1 / error))))
    size = int(np.ceil(np.sqrt(h) / error))
    return (h + 1) * size, size, size << (h + 1)


def collapsed(values: np.ndarray, weights: np.ndarray, room: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At most room values, or two of each weight: values of the least weight that several have are sorted and every second goes up with twice the weight.

    Which of two neighbours stays is drawn once a collapse, so that errors of collapses cancel; the
    sum of weights is kept.
    """
    while len(values) > room:
        kinds, n = np.unique(weights, return_counts=True)
        if n.max() < 2:
            break
        w = kinds[np.argmax(n > 1)]
        low = np.sort(values[weights == w])
        even = len(low) // 2 * 2
        up, odd = low[:even][draw.integers(2) :: 2], low[even:]
        rest = weights != w
        values = np.concatenate([values[rest], odd, up])
        weights = np.concatenate([weights[rest], np.full(len(odd), w), np.full(len(up), 2 * w)])
    return tuple(_sorted(values, weights))


def sampling_block(n: float, full: int) -> int:
    """Of how many values one is taken, after n values: a power of two, 1 until full of them are there."""
    return 1 if n <= full else 1 << int(np.ceil(np.log2(n / full)))


def buffers_added(state, values: np.ndarray, error: float, seed: int = 0):
    """A state (held, weights, open) with more values; open is the value taken from a block that is not whole, and how many that block has so far."""
    held, weights, opened = state or (np.zeros(0), np.zeros(0), np.zeros(0))
    room, _, full = buffer_sizes(error)
    pick, n_open = opened if len(opened) else (0.0, 0.0)
    n = weights.sum() + n_open
    draw, block = drawn(values, seed, n), sampling_block(n, full)
    first, rest = values[: int(block - n_open)], values[int(block - n_open) :]
    if n_open and len(first):
        stays = draw.random() * (n_open + len(first)) < n_open
        pick, n_open = pick if stays else draw.choice(first), n_open + len(first)
        taken = [np.array([pick])] if n_open == block else []
        n_open = 0.0 if n_open == block else n_open
    else:
        rest, taken = values, []
    whole = len(rest) // block
    taken.append(rest[: whole * block].reshape(whole, block)[np.arange(whole), draw.integers(block, size=whole)])
    left = rest[whole * block :]
    if len(left):
        pick, n_open = draw.choice(left), float(len(left))
    fresh = np.concatenate(taken)
    held, weights = collapsed(np.concatenate([held, fresh]), np.concatenate([weights, np.full(len(fresh), float(block))]), room, draw)
    return held, weights, np.array([pick, n_open] if n_open else [])


def buffers_merged(held, weights, opened, error: float, seed: int = 0):
    """States of buffers_added as one. Open blocks join: whole ones are drawn from them at even distances, a last one stays open."""
    values, w = np.concatenate(held), np.concatenate(weights)
    room, _, full = buffer_sizes(error)
    open_ = np.array([o for o in opened if len(o)], float).reshape(-1, 2)
    total = open_[:, 1].sum()
    draw, block = drawn(values, seed, w.sum() + total), sampling_block(w.sum() + total, full)
    left = np.zeros(0)
    if total:
        whole = int(total // block)
        at = (draw.random() * total + block * np.arange(whole + 1)) % total
        picks = open_[np.searchsorted(np.cumsum(open_[:, 1]), at, "right").clip(max=len(open_) - 1), 0]
        values, w = np.concatenate([values, picks[:whole]]), np.concatenate([w, np.full(whole, float(block))])
        if total > whole * block:
            left = np.array([picks[whole], total - whole * block])
    return *collapsed(values, w, room, draw), left


def reservoirs_joined(samples, counts, k: int, seed: int = 0) -> tuple[np.ndarray, int]:
    """(sample, n): k of the values that even samples of parts stand for, each with the same chance; a part's sample has k values or all.

    How many come from each part is drawn as k distinct places among all the values that the parts had.
    """
    counts = np.asarray(counts, np.int64)
    n = int(counts.sum())
    draw = drawn(np.concatenate(samples), seed, n)
    if n <= k:
        return np.concatenate(samples), n
    places = draw.choice(n, size=k, replace=False, shuffle=False)
    shares = np.bincount(np.searchsorted(np.cumsum(counts), places, "right"), minlength=len(counts))
    return np.concatenate([draw.permutation(s)[:m] for s, m in zip(samples, shares, strict=True)]), n


def reservoir_added(state, values: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, int]:
    """An even sample (sample, n) with more values."""
    sample, n = state or (np.zeros(0), 0)
    fresh = values if len(values) <= k else drawn(values, seed, n).choice(values, size=k, replace=False)
    return reservoirs_joined([sample, fresh], [n, len(values)], k, seed)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, ps) -> list[float]:
    """The least value whose weight with that of smaller ones reaches p of all."""
    x, n = _sorted(values, weights)
    upto = np.cumsum(n)
    return [float(x[min(len(x) - 1, int(np.searchsorted(upto, p * upto[-1] - 1e-9)))]) for p in ps]


def fresh_tuples(values: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tuples of values not seen before: in order, both ends and every so many-th value that gaps fit in twice the error."""
    x = np.sort(values)
    step = max(1, int(2 * error * len(x)))
    at = np.unique(np.concatenate([[0], np.arange(step, len(x), step), [len(x) - 1]]))
    return x[at], np.diff(at, prepend=-1).astype(float), np.zeros(len(at))


def tuples_merged(values, gaps, slacks, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greenwald-Khanna tuples of several lists as one: a value, how far its least rank is above the one before, and how far ranks may be off.

    A tuple from one list lies between two of another, whose uncertainty adds to its own. Then
    neighbours whose gaps and slack fit in twice the error become one, from the top down.
    """
    lists = [_sorted(v, g, d) for v, g, d in zip(values, gaps, slacks, strict=True) if len(v)]
    if not lists:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    x, g, d = lists[0]
    for y, h, e in lists[1:]:
        behind = lambda a, b, gap, slack, side: np.append(gap + slack, 1)[np.searchsorted(a, b, side)] - 1
        slack = np.concatenate([d + behind(y, x, h, e, "left"), e + behind(x, y, g, d, "right")])  # of equal values, x's come first
        x, g, d = _sorted(np.concatenate([x, y]), np.concatenate([g, h]), slack)
    return collapsed_tuples(x, g, d, np.floor(2 * error * g.sum()))


def collapsed_tuples(x: np.ndarray, g: np.ndarray, d: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tuples of which each took in those before it whose gaps, with its own and its slack, fit in room; the first stays.

    Where a tuple stops comes from one search over all; only kept tuples are walked.
    """
    if len(x) < 3:
        return x, g, d
    upto = np.cumsum(g)
    stop = np.minimum(np.searchsorted(upto - g, upto + d - room, "left") - 1, np.arange(len(x)) - 1).tolist()
    keep = [len(x) - 1]
    while stop[keep[-1]] > 0:
        keep.append(stop[keep[-1]])
    i = np.array([0, *keep[::-1]])
    return x[i], np.diff(upto[i], prepend=0.0), d[i]


#: Values that wait before they become tuples, at least; more where there are more tuples.
PENDING = 1_000


def adaptive_added(state, values: np.ndarray, error: float):
    """A state (tops, gaps, slacks, pending) with more values: when enough wait they enter as tuples of their own, and tuples that fit become one.

    A value's slack is what the tuple behind it leaves open, so that no tuple's gap and slack is
    above twice the error; as sums of both parts' bounds keep to it, merging costs no accuracy.
    """
    x, g, d, pending = state or (np.zeros(0),) * 4
    waiting = np.concatenate([pending, values])
    while len(waiting) >= (many := max(PENDING, 2 * len(x))):
        block, waiting = np.sort(waiting[:many]), waiting[many:]
        x, g, d = tuples_merged((x, block), (g, np.ones(many)), (d, np.zeros(many)), error)
    return x, g, d, waiting


def adaptive_whole(x, g, d, pending, error: float):
    """The tuples of a state with all that waits."""
    waiting = np.sort(np.asarray(pending, float))
    return tuples_merged((x, waiting), (g, np.ones(len(waiting))), (d, np.zeros(len(waiting))), error)


def adaptive_merged(tops, gaps, slacks, pending, error: float):
    """States of adaptive_added as one: lists of tuples merge, values that wait are added."""
    x, g, d = tuples_merged(tops, gaps, slacks, error)
    return adaptive_added((x, g, d, np.zeros(0)), np.concatenate([np.asarray(p, float) for p in pending]), error)


def tuple_quantile(values, gaps, slacks, ps) -> list[float]:
    """Values whose furthest possible rank is nearest to p: off by at most half the greatest gap and slack of a tuple."""
    least, n = np.cumsum(gaps), np.sum(gaps)
    return [float(values[int(np.argmin(np.maximum(p * n - least, least + slacks - p * n)))]) for p in ps]
