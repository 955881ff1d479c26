import numpy as np
import pytest

from sketchwell.functions import solver as S

# Published sufficient statistics of four data sets (range, power sums, log power sums).
MILAN = S.State(
    2.3314976995293306e-06, 7936.2653798841566, (81109777.0, 2982688169.6811647, 978439974358.73865, 871718166698519.75, 1.3802820224027354e18, 3.1721196216284679e21, 9.4920224710331096e24, 3.4822245172502998e28, 1.5113747392231059e32, 7.5487997054766176e35, 4.2236053442107682e39),
    -12.968999707389781, 8.9791980884111684, (81109777.0, 39954311.084389985, 975086507.65943003, 405866981.35082442, 22518788911.620308, -22190675853.522003, 840220861538.83716, -3008231730689.7461, 47081672847213.734, -301156754002264.44, 3606454337590192.0),
)
EXPONENTIAL = S.State(
    5.0366845333122605e-07, 15.619130152703306, (1000000.0, 998677.78490783856, 1991896.3142772249, 5947596.181134684, 23651528.771513801, 117830113.75301118, 710308609.25475609, 5073006703.31318, 42241259442.990211),
    -14.501347616032602, 2.7484964548137394, (1000000.0, -578739.68503790628, 1983294.7107239107, -5476131.5807481054, 23699783.595155567, -118308097.22723247, 712931526.56406581, -4933389056.9205084, 38572700905.764816),
)
OCCUPANCY = S.State(412.75, 2076.5, (20560.0, 14197775.359523809, 11795382081.900866, 11920150330935.938, 14243310876969824.0, 1.9248869180998238e19, 2.8335762132634282e22))
RETAIL = S.State(
    1.0, 80995.0, (531285.0, 5660981.0, 13127647799.0, 943385744203541.0, 7.3401290527335825e19, 5.7374634895753686e24, 4.4941878460622702e29),
    0.0, float(np.log(80995.0)), (531285.0, 733706.08385088702, 1803377.9327264477, 5313341.6192785092, 18079041.058607381, 69790609.377532199, 302287816.89519858),
)
SHUTTLE = S.State(27.0, 126.0, (43500.0, 2098864.0, 107800016.0, 6005831428.0, 369924186368.0, 25475420299084.0, 1954803892405976.0, 1.6430830896853082e17, 1.4790926986227182e19, 1.3971091486866444e21, 1.3638448459556252e23))


def state(x, k=10, logs=True):
    x = np.asarray(x, float)
    sums = tuple(float((x**i).sum()) for i in range(k + 1))
    if not logs or not (x > 0).any():
        return S.State(x.min(), x.max(), sums)
    y = np.log(x[x > 0])
    return S.State(x.min(), x.max(), sums, y.min(), y.max(), tuple(float((y**i).sum()) for i in range(k + 1)))


@pytest.mark.parametrize(("given", "p", "want", "within"), [(MILAN, 0.5, 3, 1), (MILAN, 0.99, 476, 150), (OCCUPANCY, 0.5, 565, 7), (RETAIL, 0.5, 3.5, 1)])
def test_published_statistics(given, p, want, within):
    qs, _ = S.quantiles(given, [p])
    assert abs(qs[0] - want) <= within


def test_published_shares_and_bounds():
    assert abs(S.fit(EXPONENTIAL).share_below(4) - 0.98) < 0.01
    assert abs(S.Canonical(SHUTTLE.sums, 27, 126).rank_error(45, 0.5) - 0.2) < 0.01
    uniform = state(np.linspace(0, 1, 101), 6, logs=False)
    canonical = S.Canonical(uniform.sums, 0, 1)
    assert abs(canonical.width(0.5) - 0.4444) < 1e-4 and abs(canonical.rank_error(0.5, 0.5) - 0.2222) < 1e-4 and canonical.rank_error(0.6, 0.6) < 0.2222
    assert np.allclose(S.chebyshev_means(state(np.arange(1001), 3, logs=False).sums, 0, 1000), [1, 0, -0.332, 0], atol=1e-12)


@pytest.mark.parametrize("name", ["exponential", "uniform", "lognormal", "integers", "gaussian", "pareto"])
def test_rank_errors_and_bounds_hold(name):
    rng = np.random.default_rng(1)
    x = {"exponential": rng.exponential(1, 50_000), "uniform": rng.uniform(1, 50, 50_000), "lognormal": rng.lognormal(0, 1.5, 50_000), "integers": rng.integers(1, 51, 50_000), "gaussian": rng.normal(0, 1, 50_000), "pareto": rng.pareto(2, 50_000) + 0.01}[name]
    s, ps = state(x), np.arange(0.05, 1, 0.05)
    qs, converged = S.quantiles(s, ps)
    assert converged and qs == sorted(qs)
    for p, q in zip(ps, qs, strict=True):
        true = min(abs((x < q).mean() - p), abs((x <= q).mean() - p))
        assert true < 0.015 and true <= S.rank_error_bound(s, q, p) + 1e-6
        lo, hi = S.above_bounds(s, q)
        assert lo - 1e-6 <= (x > q).mean() <= hi + 1e-6


def test_more_moments_never_loosen_and_canonical_matches_moments():
    x = np.random.default_rng(2).gamma(2, 1, 10_000)
    widths = [S.Canonical(state(x, k).sums, x.min(), x.max()).width(2.0) for k in (2, 4, 6, 8)]
    assert all(a >= b - 1e-12 for a, b in zip(widths, widths[1:], strict=False))
    at, weight = S.Canonical(state(x, 6).sums, x.min(), x.max()).points(2.0)
    for i in range(7):
        assert abs((weight * at**i).sum() / (x**i).mean() - 1) < 1e-6


def test_edge_states():
    assert S.quantiles(state([3.0, 3.0, 3.0]), [0.1, 0.9]) == ([3.0, 3.0], True)
    assert S.quantiles(state([1.0, 2.0]), [0.0, 1.0])[0] == [1.0, 2.0]
    assert S.quantiles(S.State(0, 0, (0.0, 0.0)), [0.5])[1] is False
    mixed = state(np.concatenate([np.full(50, 0.0), np.full(25, 1.0), np.full(25, np.e)]), 4)
    lo, hi = S.above_bounds(mixed, float(np.exp(0.01)))
    assert lo - 1e-9 <= 0.25 <= hi + 1e-9 and not S.choose(mixed)


def test_other_estimators_and_digests():
    rng = np.random.default_rng(4)
    x = rng.normal(10, 2, 20_000)
    s = state(x, 8, logs=False)
    for found in (S.gaussian_quantiles(s, [0.5]), S.least_squares_quantiles(s, [0.5])):
        assert abs((x <= found[0]).mean() - 0.5) < 0.05
    parts = [S.digest(c, np.ones(len(c)), 200) for c in np.split(x, 20)]
    means, weights = S.digest(np.concatenate([m for m, _ in parts]), np.concatenate([w for _, w in parts]), 200)
    assert len(means) <= 202 and weights.sum() == len(x)
    for p in (0.001, 0.05, 0.5, 0.99):
        q = S.digest_quantile(means, weights, x.min(), x.max(), p)
        assert abs((x <= q).mean() - p) < 0.005
        assert abs(S.digest_share_below(means, weights, x.min(), x.max(), q) - p) < 1e-6


def test_densities_solved_together_equal_those_solved_apart():
    rng = np.random.default_rng(5)
    states = [state(rng.exponential(1 + i, 3000)) for i in range(6)] + [state(rng.normal(i, 1, 2000), 8) for i in range(4)] + [state(rng.integers(0, 3, 500), 10), state([1.0, 2.0], 6)]
    ps = (0.1, 0.5, 0.9)
    together, apart = S.quantiles_all(states, ps), [S.quantiles(s, ps) for s in states]
    for (a, ok), (b, ok2) in zip(together, apart, strict=True):
        assert ok == ok2 and np.allclose(a, b, rtol=1e-6, atol=1e-6)
    assert S.fit_all([]) == []


def test_hybrid_takes_the_scale_with_the_smaller_errors():
    rng = np.random.default_rng(6)
    skewed, even = state(rng.lognormal(0, 2, 5000)), state(rng.uniform(1, 2, 5000))
    ps = (0.25, 0.5, 0.75)
    for s in (skewed, even):
        (got, _), = S.hybrid_all([s], ps)
        each = [S.quantiles(s, ps, both=False, logs=x)[0] for x in (False, True)]
        error = [np.mean([S.rank_error_bound(s, q, p) for q, p in zip(qs, ps, strict=True)]) for qs in each]
        assert np.allclose(got, each[int(error[1] < error[0])])


def test_widths_agree_and_orders_are_guarded():
    canonical = S.Canonical(SHUTTLE.sums[:9], 27, 126)
    for x in (30.0, 45.0, 100.0):
        assert abs(canonical.width(x) - canonical.width_by_determinants(x)) < 1e-4
    assert S.usable_order(0, 10) == 12 and S.usable_order(1000, 1001) < 4
    far = state(1e6 + np.linspace(0, 1, 500), 10, logs=False)
    qs, _ = S.quantiles(far, [0.5])
    assert abs(qs[0] - 1e6 - 0.5) < 0.05


def test_bounds_of_many_states_are_those_of_each():
    """Few and equal values, signs, ties at the cut, narrow and wide groups, numbers that overflow."""
    rng = np.random.default_rng(8)
    draws = [lambda n: rng.exponential(50, n), lambda n: rng.normal(0, 1, n), lambda n: rng.integers(0, 3, n).astype(float), lambda n: 1e6 + rng.random(n), lambda n: rng.lognormal(0, 3, n), lambda n: rng.random(n) * 1e80]
    states, xs = [], []
    for i in range(600):
        x = draws[i % len(draws)](1 + i % 40)
        sums, positive = [float((x**k).sum()) for k in range(7)], x[x > 0]
        logs = np.log(positive) if len(positive) else np.array([0.0])
        states.append(S.State(float(x.min()), float(x.max()), tuple(sums), float(logs.min()), float(logs.max()), tuple(float((logs**k).sum()) for k in range(7)) if len(positive) else ()))
        xs.append(float([x.mean(), x[0], x.min() - 1, x.max(), 1.0][i % 5]))
    with np.errstate(all="ignore"):
        each = [S.above_bounds(s, x) for s, x in zip(states, xs)]
    many = S.above_bounds_all(states, xs)
    assert np.abs(np.array(each) - np.array(many)).max() < 1e-6  # MOMENT_SLACK
    assert S.above_bounds_all([], []) == []
