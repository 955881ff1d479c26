import numpy as np
import pytest

from sketchwell.functions import buffers as B
from sketchwell.operators import summaries as Y

PS = (0.05, 0.25, 0.5, 0.75, 0.95)


def worst(values, qs, ps=PS):
    own = np.sort(values)
    low, high = np.searchsorted(own, qs, "left") / len(own), np.searchsorted(own, qs, "right") / len(own)
    return max(max(a - p, p - b, 0) for a, b, p in zip(low, high, ps, strict=True))


def test_collapse_walks_as_one_tuple_at_a_time_would():
    rng = np.random.default_rng(1)
    for room in (0, 3, 10, 40, 1000):
        x, g, d = np.sort(rng.normal(size=200)), rng.integers(1, 6, 200).astype(float), rng.integers(0, 5, 200).astype(float)
        keep, gap = [199], [g[199]]
        for i in range(198, 0, -1):
            if g[i] + gap[-1] + d[keep[-1]] <= room:
                gap[-1] += g[i]
            else:
                keep.append(i)
                gap.append(g[i])
        keep, gap = [0, *keep[::-1]], [g[0], *gap[::-1]]
        got = B.collapsed_tuples(x, g, d, room)
        assert got[0].tolist() == x[keep].tolist() and got[1].tolist() == gap and got[2].tolist() == d[keep].tolist()


@pytest.mark.parametrize("order", ["drawn", "rising", "falling", "repeated"])
def test_adaptive_tuples_keep_ranks_through_batches_and_merges(order):
    rng = np.random.default_rng(3)
    values = rng.exponential(size=60_000)
    values = {"drawn": values, "rising": np.sort(values), "falling": np.sort(values)[::-1], "repeated": np.floor(values * 3)}[order]
    parts = []
    for part in np.array_split(values, [100, 30_000, 31_500]):
        state = None
        for batch in np.array_split(part, 7):
            state = B.adaptive_added(state, batch, 0.01)
        parts.append(state)
    x, g, d, pending = B.adaptive_merged(*zip(*parts, strict=True), 0.01)
    x, g, d = B.adaptive_whole(x, g, d, pending, 0.01)
    assert g.sum() == len(values) and (g + d)[1:].max() <= 2 * 0.01 * len(values) and len(x) < 600
    least = np.cumsum(g)
    own = np.sort(values)
    high, low = np.searchsorted(own, x, "right"), np.searchsorted(own, x, "left") + 1
    assert (least <= high).all() and (low <= least + d).all()
    assert worst(values, B.tuple_quantile(x, g, d, PS)) <= 0.01


def buffered(values, seed, parts=3):
    states = []
    for part in np.array_split(values, parts):
        state = None
        for batch in np.array_split(part, 20):
            state = B.buffers_added(state, batch, 0.02, seed)
        states.append(state)
    return B.buffers_merged(*zip(*states, strict=True), 0.02, seed)


def test_buffers_sample_once_full_and_stay_bounded():
    room, _, full = B.buffer_sizes(0.02)
    sizes = []
    for n in (1_000, full, 8 * full, 64 * full):
        held, weights, opened = buffered(np.random.default_rng(n).normal(size=n), 0)
        assert weights.sum() + (opened[1] if len(opened) else 0) == n
        sizes.append(len(held))
    assert max(sizes) <= room and B.sampling_block(full, full) == 1 and B.sampling_block(full + 1, full) == 2 and B.sampling_block(64 * full, full) == 64


def test_buffers_keep_the_error_over_seeds():
    values = np.random.default_rng(5).exponential(size=400_000)
    for seed in range(30):
        held, weights, opened = buffered(values, seed)
        assert worst(values, B.weighted_quantile(np.append(held, opened[:1]), np.append(weights, opened[1:]), PS)) <= 0.02


def test_open_blocks_are_drawn_evenly():
    """Values of states that have not filled a block keep their weight on average, also where parts are unequal."""
    counts = np.array([3.0, 1.0, 12.0, 6.0])
    total = np.zeros(4)
    for seed in range(4000):
        held, weights, opened = B.buffers_merged([np.full(1, 9.0)] + [np.zeros(0)] * 3, [np.full(1, float(1 << 18))] + [np.zeros(0)] * 3, [np.array([float(i), c]) for i, c in enumerate(counts)], 0.02, seed)
        for v, w in [*zip(held, weights, strict=True), tuple(opened)]:
            if v < 4:
                total[int(v)] += w
    assert np.allclose(total / 4000, counts, rtol=0.12)


def test_joined_reservoirs_are_even():
    """Chi-square over seeds: parts of unequal sizes give by their counts, and each value has the same chance."""
    sizes, k, runs = [30, 300, 1170], 40, 2000
    values = np.arange(1500.0)
    parts = np.split(values, np.cumsum(sizes)[:-1])
    seen = np.zeros(1500)
    for seed in range(runs):
        states = [B.reservoir_added(None, p, k, seed) for p in parts]
        sample, n = B.reservoirs_joined(*zip(*states, strict=True), k, seed)
        assert n == 1500 and len(set(sample)) == k
        seen[sample.astype(int)] += 1
    by_part = np.array([s.sum() for s in np.split(seen, np.cumsum(sizes)[:-1])])
    expected = runs * k * np.array(sizes) / 1500
    assert ((by_part - expected) ** 2 / expected).sum() < 13.8  # 0.001 at 2 degrees
    assert ((seen - runs * k / 1500) ** 2 / (runs * k / 1500)).sum() < 1670  # 0.001 at 1499 degrees
    small, n = B.reservoirs_joined([np.arange(3.0), np.zeros(0)], [3, 0], k)
    assert n == 3 and sorted(small) == [0, 1, 2]
    assert len(B.reservoirs_joined([values[:40], values[40:80]], [10**14, 10**13], k)[0]) == k


def test_trapezoids_invert_and_meet_the_ends():
    rng = np.random.default_rng(8)
    values = rng.exponential(size=20_000)
    x, n = B.nearest_merged(values, np.ones(len(values)), 60)
    lo, hi = values.min(), values.max()
    assert len(x) <= 60 and n.sum() == len(values)
    ps = np.linspace(0, 1, 101)
    qs = B.trapezoid_quantiles(x, n, lo, hi, ps)
    assert (np.diff(qs) >= 0).all() and qs[0] == lo and np.isclose(qs[-1], hi)
    assert np.allclose([B.trapezoid_share(x, n, lo, hi, q) for q in qs], ps, atol=1e-9)
    assert worst(values, qs, ps) <= 0.02
    assert B.trapezoid_quantiles(np.array([2.0]), np.array([7.0]), 2.0, 2.0, [0.0, 0.5, 1.0]) == [2.0, 2.0, 2.0]


def test_no_centers_are_nearer_than_the_least_distance():
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=3000), rng.normal(50, 0.01, 3000)])
    x, n = B.nearest_merged(values, np.ones(len(values)), 500, 0.5)
    assert np.diff(x).min() >= 0.5 and n.sum() == 6000 and np.isclose((x * n).sum(), values.sum())
    assert len(B.nearest_merged(values, np.ones(len(values)), 500)[0]) == 500
    rising = np.cumsum(np.arange(5000.0))
    assert len(B.nearest_merged(rising, np.ones(5000), 100)[0]) == 100


def test_stored_states_on_odd_groups(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0), (None, 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for build, quantiles in [
        (lambda d: Y.gk_adaptive(d, ["k"], "x", 100), lambda s: Y.gk_adaptive_quantiles(s, ["k"], [0.5], 100)),
        (lambda d: Y.random_buffers(d, ["k"], "x", 50), lambda s: Y.random_quantiles(s, ["k"], [0.5])),
        (lambda d: Y.drawn_reservoir(d, ["k"], "x", 10), lambda s: Y.drawn_reservoir_quantiles(s, ["k"], [0.5])),
        (lambda d: Y.streaming_histogram(d, ["k"], "x", 10, least=0.5), lambda s: Y.streaming_histogram_quantiles(s, ["k"], [0.5])),
    ]:
        assert {r["k"]: r["qs"] for r in quantiles(build(df)).collect()} == {"a": [1.0], None: [2.0]}
        assert build(df.limit(0)).count() == 0
