import numpy as np
from numpy.polynomial import chebyshev as C

from sketchwell.functions import chebyshev as K
from sketchwell.functions import solver as S

PS = (0.05, 0.25, 0.5, 0.75, 0.95)


def state_of(values, order):
    return S.State(float(values.min()), float(values.max()), tuple(float((values**i).sum()) for i in range(order + 1)))


def test_identities_of_series():
    rng = np.random.default_rng(1)
    a, b, y = rng.normal(size=9), rng.normal(size=14), np.linspace(-1, 1, 101)
    assert np.allclose(C.chebval(y, K.multiply(a, b)), C.chebval(y, a) * C.chebval(y, b), atol=1e-10, rtol=0)
    for k in (0, 1, 5, 30):
        basis = np.append(np.zeros(k), 1.0)
        assert np.allclose(K.multiply_by_basis(a, k), C.chebmul(a, basis), atol=1e-10, rtol=0)
    assert np.allclose(K.antiderivative(a), C.chebint(a, lbnd=-1), atol=1e-10, rtol=0)
    assert np.isclose(K.integral(a), C.chebval(1, C.chebint(a, lbnd=-1)), atol=1e-10, rtol=0)
    assert np.allclose(K.coefficients(C.chebval(K.nodes(16), b)), np.append(b, np.zeros(3)), atol=1e-10, rtol=0)
    assert np.allclose(K.values(b, 16), C.chebval(K.nodes(16), b), atol=1e-10, rtol=0)
    assert np.allclose([K.weights(64) @ np.cos(K.nodes(64) * k) for k in (1, 7)], [2 * np.sin(k) / k for k in (1, 7)], atol=1e-10, rtol=0)


def test_nodes_double_until_the_rest_vanishes():
    series, converged = K.fit(np.exp)
    assert converged and len(series) < 20 and np.isclose(K.integral(series), np.e - 1 / np.e, atol=1e-13)
    for center in (0.0, 0.3337):
        narrow = lambda y, c=center: np.exp(-(((y - c) / 2e-4) ** 2) / 2) / (2e-4 * (2 * np.pi) ** 0.5)
        series, converged = K.fit(narrow)
        assert converged and abs(K.integral(series) - 1) < 1e-10 and len(series) > 10_000
        assert abs(C.chebval(center, K.antiderivative(series)) - 0.5) < 1e-8
    several, converged = K.fit(lambda y: np.stack([np.exp(y), np.sin(20 * y)]))
    assert converged and np.allclose(K.integral(several), [np.e - 1 / np.e, 0], atol=1e-12)
    assert K.fit(np.sign, most=1 << 12)[1] is False and K.fit(np.zeros_like, most=1 << 10)[1] is False


def test_narrow_densities_are_solved_on_finer_grids():
    values = np.random.default_rng(2).normal(size=200_000)
    values[:2] = -1000, 1000
    inner = values[2:]
    s = S.State(-1000.0, 1000.0, tuple(float((inner**i).sum()) for i in range(3)))
    density = S.fit(s)
    assert density.converged and density.points is not None
    assert np.allclose(density.quantile([0.05, 0.25, 0.5, 0.75, 0.95]), np.quantile(inner, PS), atol=0.03)
    wide = S.fit(state_of(np.random.default_rng(3).normal(size=5000), 6))
    assert wide.converged and wide.points is None


def test_cell_estimators_have_the_moments():
    for values in (np.random.default_rng(4).normal(size=20_000), np.random.default_rng(5).gamma(2.0, size=20_000), np.random.default_rng(6).uniform(3, 9, 20_000)):
        s, own = state_of(values, 6), np.sort(values)
        for quantiles in (S.cell_entropy_quantiles, S.smallest_density_quantiles):
            qs, converged = quantiles(s, PS)
            assert converged and np.abs(np.searchsorted(own, qs) / len(own) - PS).max() <= 0.04, (quantiles, qs)


def test_smallest_density_reaches_the_cap_of_an_even_one():
    """Masses of a box half as wide as the range: no smaller cap than twice the even mass has the box's first moments."""
    y = np.linspace(-1, 1, S.CELLS)
    box = np.abs(y) <= 0.5
    sums = tuple(float((y[box] ** i).mean()) for i in range(9))
    qs, converged = S.smallest_density_quantiles(S.State(-1.0, 1.0, sums), (0.25, 0.5, 0.75))
    assert converged and np.allclose(qs, [-0.25, 0.0, 0.25], atol=0.01)
