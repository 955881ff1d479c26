"""Estimates from one group's moment state, in numpy: maximum entropy densities, bounds, simple fits.

A density on y in [-1, 1] is exp of a linear combination of functions: Chebyshev polynomials in y
and, where logarithms are at hand, Chebyshev polynomials in the other scale. All integrals are sums
over one fixed Clenshaw-Curtis grid, so a fit is a few small matrix products a Newton step. A density
too narrow for that grid, as the last coefficients of its series show, is solved again on finer ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from math import comb
from statistics import NormalDist

import numpy as np
from numpy.polynomial import chebyshev as C

from . import chebyshev as K

NODES, FINE = 256, 2049
#: Nodes that a narrow density may take, and what its last coefficients may be of its greatest.
MOST_NODES, LEFT_OUT = 1 << 16, 1e-6
WELL_CONDITIONED, LARGEST = 1e4, 1.1


@dataclass(frozen=True)
class State:
    """A group's state; sums start with the count."""

    lo: float
    hi: float
    sums: tuple[float, ...]
    log_lo: float = 0.0
    log_hi: float = 0.0
    log_sums: tuple[float, ...] = ()

    @property
    def n(self) -> float:
        return self.sums[0]

    @property
    def positive(self) -> bool:
        return bool(self.log_sums) and self.log_sums[0] == self.sums[0] and self.lo > 0


@cache
def _binomials(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Binomials of m over j, and m - j where it is not negative, for m and j below k."""
    m, j = np.arange(k)[:, None], np.arange(k)[None]
    return np.array([[float(comb(a, b)) for b in range(k)] for a in range(k)]), np.maximum(m - j, 0)


@cache
def _chebyshev_rows(k: int) -> np.ndarray:
    """Coefficients of powers in the first k Chebyshev polynomials, a row each."""
    rows = np.zeros((k, k))
    for i in range(k):
        rows[i, : i + 1] = C.cheb2poly([0] * i + [1])
    return rows


def scaled(sums, lo: float, hi: float) -> np.ndarray:
    """Means of powers of the values scaled to [-1, 1]."""
    center, half = (hi + lo) / 2, (hi - lo) / 2
    binomials, powers = _binomials(len(sums))
    about = (binomials * (-center) ** powers) @ np.asarray(sums, float)
    return about / half ** np.arange(len(sums)) / sums[0]


def chebyshev_means(sums, lo: float, hi: float) -> np.ndarray:
    return _chebyshev_rows(len(sums)) @ scaled(sums, lo, hi)


def trusted(means: np.ndarray) -> int:
    """Leading Chebyshev means that can be right: none is above one in size."""
    bad = np.flatnonzero(np.abs(means) > LARGEST)
    return int(bad[0]) if len(bad) else len(means)


def from_uniform(means: np.ndarray) -> float:
    """Distance of Chebyshev means from those of a uniform density, root mean square."""
    i = np.arange(len(means))
    uniform = np.where(i % 2 == 0, 1.0 / (1.0 - np.where(i % 2 == 0, i, 0) ** 2), 0.0)
    return float(np.sqrt(np.mean((means - uniform) ** 2)))


@cache
def grid() -> tuple[np.ndarray, np.ndarray]:
    """Nodes in [-1, 1], ascending, and their weights."""
    angle = np.pi * np.arange(NODES + 1) / NODES
    even = np.arange(0, NODES + 1, 2)
    coefficient = np.where((even == 0) | (even == NODES), 1.0, 2.0) / (1.0 - even**2.0)
    weights = (2.0 / NODES) * (np.cos(np.outer(angle, even)) @ coefficient)
    weights[[0, -1]] /= 2
    return np.cos(angle)[::-1].copy(), weights[::-1].copy()


@cache
def _fine() -> np.ndarray:
    return -np.cos(np.pi * np.arange(FINE) / (FINE - 1))


@cache
def _cumulative() -> np.ndarray:
    """Takes values at the nodes to integrals from -1 up to each fine point: cosine series, then its integral."""
    j = np.arange(NODES + 1)
    cosines = (2.0 / NODES) * np.cos(np.pi * np.outer(j, j[::-1]) / NODES)
    cosines[:, [0, -1]] /= 2
    cosines[[0, -1]] /= 2
    integral = C.chebint(np.eye(NODES + 1), lbnd=-1)
    return C.chebvander(_fine(), NODES + 1) @ integral @ cosines


@dataclass
class Density:
    """A fitted density; quantile and share_below speak in the values' own scale."""

    lo: float
    hi: float
    logs: bool
    below: np.ndarray
    converged: bool
    entropy: float = 0.0
    points: np.ndarray | None = None  # where below is given; the fine grid if none

    @property
    def at(self) -> np.ndarray:
        return _fine() if self.points is None else self.points

    def quantile(self, p):
        p = np.asarray(p, float)
        y = np.interp(p, self.below, self.at)
        x = y * (self.hi - self.lo) / 2 + (self.hi + self.lo) / 2
        x = np.exp(x) if self.logs else x
        ends = np.exp([self.lo, self.hi]) if self.logs else (self.lo, self.hi)
        return np.where(p <= 0, ends[0], np.where(p >= 1, ends[1], x))

    def share_below(self, x: float) -> float:
        if self.logs:
            if x <= 0:
                return 0.0
            x = np.log(x)
        y = (x - (self.hi + self.lo) / 2) / ((self.hi - self.lo) / 2)
        return float(np.interp(y, self.at, self.below, 0.0, 1.0))


def newton(functions: np.ndarray, means: np.ndarray, weights: np.ndarray, tol: float = 1e-9, most: int = 200, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the densities whose means of the functions are the given ones, and which converged.

    functions is densities x functions x nodes, means densities x functions; the first function is 1.
    All densities step together; one that is done is left out of later steps.
    """
    at = np.zeros(means.shape) if start is None else start.copy()
    if start is None:
        at[:, 0] = -np.log(2.0)
    value = lambda f, m, c: np.exp(np.minimum(np.matmul(c[:, None], f)[:, 0], 700.0)) @ weights - (c * m).sum(axis=1)
    potential, converged, going = value(functions, means, at), np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(most):
        if not len(going):
            break
        f, m, c = functions[going], means[going], at[going]
        mass = weights * np.exp(np.minimum(np.matmul(c[:, None], f)[:, 0], 700.0))
        slope = np.matmul(f, mass[:, :, None])[:, :, 0] - m
        done = np.abs(slope).max(axis=1) < tol
        converged[going[done]] = True
        curve = np.matmul(f * mass[:, None], f.transpose(0, 2, 1))
        step = -_solved(curve, slope)
        usable = np.isfinite(step).all(axis=1) & ~done
        step[~usable] = 0
        downhill, size, before = (slope * step).sum(axis=1), np.ones(len(going)), potential[going]
        after = value(f, m, c + step)
        while (short := usable & (size > 1e-6) & ~(after <= before + 0.3 * size * downhill + 1e-14)).any():
            size[short] /= 4
            after[short] = value(f[short], m[short], c[short] + size[short, None] * step[short])
        stuck = usable & (size <= 1e-6)
        converged[going[stuck & (np.abs(slope).max(axis=1) < 1e-6)]] = True
        moved = usable & ~stuck
        at[going[moved]] = (c + size[:, None] * step)[moved]
        potential[going[moved]] = after[moved]
        going = going[moved]
    return at, converged


def _solved(curve: np.ndarray, slope: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # one is singular: solve them apart
        out = np.full(slope.shape, np.nan)
        for i, (a, b) in enumerate(zip(curve, slope, strict=True)):
            if np.isfinite(a).all():
                out[i] = np.linalg.pinv(a) @ b
        return out


def _densities(functions, coefficients, ends, logs, converged) -> list[Density]:
    _, weights = grid()
    power = np.matmul(coefficients[:, None], functions)[:, 0]
    f = np.exp(np.minimum(power, 700.0))
    below = np.maximum.accumulate(np.clip(f @ _cumulative().T, 0, None), axis=1)
    out = []
    for i, (lo, hi) in enumerate(ends):
        share = below[i] / below[i][-1] if below[i][-1] > 0 else (_fine() + 1) / 2
        out.append(Density(lo, hi, bool(logs[i]), share, bool(converged[i]), -float(weights @ (f[i] * power[i]))))
    return out


def usable_order(lo: float, hi: float) -> int:
    """The highest power whose scaled sums keep some digits in double precision."""
    center = abs((hi + lo) / (hi - lo)) if hi > lo else 0.0
    return int((53 * np.log10(2) - 2.58) / (np.log10(6) + np.log10(center + 1)))


def usable_means(sums, lo: float, hi: float) -> np.ndarray:
    """Chebyshev means that can be right: of usable orders, and up to the first above one in size."""
    means = chebyshev_means(sums[: max(3, usable_order(lo, hi) + 1)], lo, hi)
    return means[: trusted(means)]


def choose(state: State) -> bool:
    """Whether the logarithm is the primary scale: as many usable moments, and closer to uniform."""
    if not state.positive or state.log_hi <= state.log_lo:
        return False
    plain, logs = usable_means(state.sums, state.lo, state.hi), usable_means(state.log_sums, state.log_lo, state.log_hi)
    return len(logs) >= len(plain) and from_uniform(logs) < from_uniform(plain)


@dataclass
class _Plan:
    """One density to be fitted: its scale, and the functions that it takes of it and of the other."""

    logs: bool
    ends: tuple[float, float]
    means: np.ndarray
    other: np.ndarray
    other_means: np.ndarray
    size: int
    other_size: int = 0
    other_ends: tuple[float, float] = (0.0, 0.0)
    least: float = 0.0

    def of_other(self, y: np.ndarray, k: int) -> np.ndarray:
        """The first k polynomials of the other scale, but for the constant, at places y of this one."""
        x = y * (self.ends[1] - self.ends[0]) / 2 + (self.ends[0] + self.ends[1]) / 2
        moved = np.exp(x) if self.logs else np.log(np.maximum(x, self.least))
        z = np.clip((moved - sum(self.other_ends) / 2) / ((self.other_ends[1] - self.other_ends[0]) / 2), -1, 1)
        return C.chebvander(z, k).T[1:]

    def functions_at(self, y: np.ndarray) -> np.ndarray:
        rows = C.chebvander(y, self.size - 1).T
        return np.concatenate([rows, self.of_other(y, self.other_size)]) if self.other_size else rows

    def functions(self) -> np.ndarray:
        return np.concatenate([_polynomials(self.size), self.other[: self.other_size]])

    def wanted(self) -> np.ndarray:
        return np.concatenate([self.means[: self.size], self.other_means[: self.other_size]])


@cache
def _polynomials(k: int) -> np.ndarray:
    return C.chebvander(grid()[0], k - 1).T


def _plan(state: State, both: bool, logs: bool | None) -> _Plan:
    y, weights = grid()
    log_first = choose(state) if logs is None else bool(logs and state.positive)
    scales = [((state.lo, state.hi), state.sums), ((state.log_lo, state.log_hi), state.log_sums)]
    (ends, sums), (other_ends, other_sums) = scales[::-1] if log_first else scales
    means = usable_means(sums, *ends)
    if len(means) < 2:
        means = chebyshev_means(sums, *ends)[:2]
    plan = _Plan(log_first, ends, means, np.zeros((0, len(y))), np.zeros(0), len(means), 0, other_ends, state.lo)
    if both and state.positive and state.log_hi > state.log_lo:
        other = usable_means(other_sums, *other_ends)
        plan.other, plan.other_means = plan.of_other(y, max(1, len(other) - 1)), other[1:]
        stack = np.concatenate([_polynomials(plan.size), plan.other])
        gram = (stack * weights) @ stack.T
        while plan.other_size < len(plan.other_means) and np.linalg.cond(gram[: (n := plan.size + plan.other_size + 1), :n]) <= WELL_CONDITIONED:
            plan.other_size += 1
    return plan


def _narrow(functions: np.ndarray, coefficients: np.ndarray) -> bool:
    """Whether a density given at nodes is too narrow for them."""
    with np.errstate(all="ignore"):
        return not K.left_out(K.coefficients(np.exp(np.minimum(coefficients @ functions, 700.0)))) <= LEFT_OUT


def _refined(plan: _Plan, coefficients: np.ndarray) -> Density | None:
    """The density of a plan on four times as many nodes, and again, until they resolve it; none if the most do not, or it does not converge."""
    n = 4 * NODES
    while n <= MOST_NODES:
        y, weights = K.nodes(n), K.weights(n)
        functions = plan.functions_at(y)
        found, converged = newton(functions[None], plan.wanted()[None], weights, start=coefficients[None])
        if not (converged[0] and np.isfinite(found).all()):
            return None
        coefficients = found[0]
        if not _narrow(functions, coefficients):
            power = coefficients @ functions
            f = np.exp(np.minimum(power, 700.0))
            upto = np.maximum.accumulate(np.clip(K.values(K.antiderivative(K.coefficients(f)), n + 1), 0, None)[::-1])
            return Density(*plan.ends, plan.logs, upto / upto[-1], True, -float(weights @ (f * power)), K.nodes(n + 1)[::-1])
        n *= 4
    return None


def fit_all(states: list[State], both: bool = True, logs: bool | None = None) -> list[Density]:
    """Maximum entropy densities, those of as many functions solved together.

    both: take functions of the other scale too while they stay well conditioned. A density that does
    not converge is solved again with a function less, down to two.
    """
    _, weights = grid()
    found: dict[int, Density] = {}
    open_plans = {i: _plan(s, both, logs) for i, s in enumerate(states)}
    while open_plans:
        shapes: dict[int, list[int]] = {}
        for i, plan in open_plans.items():
            shapes.setdefault(plan.size + plan.other_size, []).append(i)
        for n, members in shapes.items():
            plans = [open_plans[i] for i in members]
            functions, wanted = np.stack([p.functions() for p in plans]), np.stack([p.wanted() for p in plans])
            coefficients, converged = newton(functions, wanted, weights)
            densities = _densities(functions, coefficients, [p.ends for p in plans], [p.logs for p in plans], converged)
            for i, plan, density, f, c in zip(members, plans, densities, functions, coefficients, strict=True):
                if density.converged and _narrow(f, c):
                    density = _refined(plan, c) or density
                if density.converged or n <= 2:
                    found[i] = density
                    del open_plans[i]
                elif plan.other_size:
                    plan.other_size -= 1
                else:
                    plan.size -= 1
    return [found[i] for i in range(len(states))]


def fit(state: State, both: bool = True, logs: bool | None = None) -> Density:
    return fit_all([state], both, logs)[0]


def quantiles_all(states: list[State], ps, **how) -> list[tuple[list[float], bool]]:
    """Each state's quantiles, and whether its density converged."""
    out: list[tuple[list[float], bool]] = []
    fitted = [i for i, s in enumerate(states) if s.n > 0 and np.isfinite([s.lo, s.hi]).all() and s.lo < s.hi]
    densities = dict(zip(fitted, fit_all([states[i] for i in fitted], **how), strict=True))
    for i, s in enumerate(states):
        if i in densities:
            out.append(([float(min(s.hi, max(s.lo, x))) for x in densities[i].quantile(list(ps))], densities[i].converged))
        elif s.n > 0 and np.isfinite([s.lo, s.hi]).all():
            out.append(([s.lo] * len(ps), True))
        else:
            out.append(([float("nan")] * len(ps), False))
    return out


def hybrid_all(states: list[State], ps) -> list[tuple[list[float], bool]]:
    """Quantiles of each state in the one scale, plain or logarithmic, whose worst rank errors are smaller on average."""
    plain, logs = quantiles_all(states, ps, both=False, logs=False), quantiles_all(states, ps, both=False, logs=True)

    def worst(s: State, qs: list[float]) -> float:
        return float(np.mean([rank_error_bound(s, q, p) for q, p in zip(qs, ps, strict=True)]))

    return [b if s.positive and s.log_lo < s.log_hi and b[1] and worst(s, b[0]) < worst(s, a[0]) else a for s, a, b in zip(states, plain, logs, strict=True)]


def quantiles(state: State, ps, **how) -> tuple[list[float], bool]:
    return quantiles_all([state], ps, **how)[0]


class Canonical:
    """Distributions that match the scaled moments and have most mass at a point: the reach of any CDF there.

    With M the moments' Hankel matrix and v(x) = (1, x, .., x^n), the weight at x is 1 / v'Mv (M
    inverted); the other points are the roots in t of v(t)'Mv(x), with their weights alike.
    """

    def __init__(self, sums, lo: float, hi: float):
        raw = scaled(sums, lo, hi)
        self.lo, self.hi = lo, hi
        n = (len(raw) - 1) // 2
        while n > 1:
            hankel = raw[np.add.outer(np.arange(n + 1), np.arange(n + 1))]
            if np.linalg.eigvalsh(hankel)[0] > 1e-11:
                break
            n -= 1
        self.n, self.inverse = n, np.linalg.inv(raw[np.add.outer(np.arange(n + 1), np.arange(n + 1))])

    def _weight(self, y) -> np.ndarray:
        v = np.power.outer(np.atleast_1d(y), np.arange(self.n + 1))
        return 1.0 / np.einsum("ij,jk,ik->i", v, self.inverse, v)

    def points(self, x: float) -> tuple[np.ndarray, np.ndarray]:
        y = (x - (self.hi + self.lo) / 2) / ((self.hi - self.lo) / 2)
        others = np.real(np.roots((self.inverse @ y ** np.arange(self.n + 1))[::-1]))
        at = np.append(others, y)
        order = np.argsort(at)
        weight = self._weight(at)
        return at[order] * (self.hi - self.lo) / 2 + (self.hi + self.lo) / 2, weight[order]

    def width(self, x: float) -> float:
        return float(self._weight((x - (self.hi + self.lo) / 2) / ((self.hi - self.lo) / 2))[0])

    def width_by_determinants(self, x: float) -> float:
        """The weight at x as the ratio of the Hankel determinants of the moments, and of the moments about x less one order."""
        y = (x - (self.hi + self.lo) / 2) / ((self.hi - self.lo) / 2)
        hankel = np.linalg.inv(self.inverse)
        shift = np.array([[comb(i, j) * (-y) ** (i - j) if j <= i else 0.0 for j in range(self.n + 1)] for i in range(self.n + 1)])
        moved = shift @ hankel @ shift.T
        return float(np.linalg.det(moved) / np.linalg.det(moved[1:, 1:]))

    def below(self, x: float) -> tuple[float, float]:
        """Least and greatest share of values at or below x."""
        at, weight = self.points(x)
        lower = float(weight[at < x - 1e-12 * (self.hi - self.lo)].sum())
        return max(0.0, lower), min(1.0, lower + self.width(x))

    def rank_error(self, x: float, p: float) -> float:
        lo, hi = self.below(x)
        return max(abs(p - lo), abs(hi - p))


def above_bounds(state: State, x: float) -> tuple[float, float]:
    """Least and greatest share above x from moments, and from logarithms' for the positive share; [0, 1] where numbers fail."""
    if x < state.lo:
        return 1.0, 1.0
    if x >= state.hi:
        return 0.0, 0.0
    low, high = 0.0, 1.0
    tries = [(state.sums, state.lo, state.hi, x, 1.0)]
    if state.log_sums and state.log_sums[0] and x > 0 and state.log_lo < np.log(x) < state.log_hi:
        tries.append((state.log_sums, state.log_lo, state.log_hi, float(np.log(x)), state.log_sums[0] / state.n))
    for sums, lo, hi, at, share in tries:
        try:
            a, b = Canonical(sums, lo, hi).below(at)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite([a, b]).all() and a <= b + 1e-9:
            low, high = max(low, share * (1 - b)), min(high, share * (1 - a))
    return (low, high) if low <= high + 1e-9 else (0.0, 1.0)


def _below_all(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Canonical's `below` of many states of one order, a row each; nan where numbers fail."""
    center, half, k = (hi + lo) / 2, (hi - lo) / 2, sums.shape[1]
    binomials, powers = _binomials(k)
    raw = ((binomials * (-center)[:, None, None] ** powers) @ sums[:, :, None])[:, :, 0] / half[:, None] ** np.arange(k) / sums[:, :1]
    y, found = (x - center) / half, np.full((len(sums), 2), np.nan)
    left, alone = np.flatnonzero(np.isfinite(raw).all(axis=1) & np.isfinite(y)), []
    for n in range(max(1, (k - 1) // 2), 0, -1):
        hankel = raw[left][:, np.add.outer(np.arange(n + 1), np.arange(n + 1))]
        fits = np.linalg.eigvalsh(hankel)[:, 0] > 1e-11
        if n == 1:
            alone += left[~fits].tolist()
        now, hankel, left = left[fits], hankel[fits], left[~fits]
        inverse = np.linalg.inv(hankel)
        series = (inverse @ (y[now, None] ** np.arange(n + 1))[:, :, None])[:, ::-1, 0]
        usual = (series[:, 0] != 0) & (series[:, -1] != 0)
        alone += now[~usual].tolist()
        now, inverse, series = now[usual], inverse[usual], series[usual]
        companion = np.zeros((len(now), n, n))
        companion[:, np.arange(1, n), np.arange(n - 1)] = 1
        companion[:, 0] = -series[:, 1:] / series[:, :1]
        usable = np.isfinite(companion).all(axis=(1, 2))
        now, inverse, companion = now[usable], inverse[usable], companion[usable]
        at = np.column_stack([np.real(np.linalg.eigvals(companion)), y[now]])
        v = at[:, :, None] ** np.arange(n + 1)
        weight = 1.0 / ((v @ inverse) * v).sum(axis=2)
        before = at * half[now, None] + center[now, None] < (x - 1e-12 * (hi - lo))[now, None]
        lower = np.where(before, weight, 0.0).sum(axis=1)
        found[now] = np.column_stack([np.maximum(0.0, lower), np.minimum(1.0, lower + weight[:, -1])])
    for i in alone:
        try:
            found[i] = Canonical(sums[i], lo[i], hi[i]).below(x[i])
        except np.linalg.LinAlgError:
            continue
    return found


def above_bounds_all(states: list[State], xs: list[float]) -> list[tuple[float, float]]:
    """above_bounds of each state at its x, those of one order together."""
    bounds = [(1.0, 1.0) if x < s.lo else (0.0, 0.0) if x >= s.hi else (0.0, 1.0) for s, x in zip(states, xs, strict=True)]
    tries: dict[int, list] = {}
    for i, (s, x) in enumerate(zip(states, xs, strict=True)):
        if s.lo <= x < s.hi:
            tries.setdefault(len(s.sums), []).append((i, s.sums, s.lo, s.hi, x, 1.0))
            if s.log_sums and s.log_sums[0] and x > 0 and s.log_lo < np.log(x) < s.log_hi:
                tries.setdefault(len(s.log_sums), []).append((i, s.log_sums, s.log_lo, s.log_hi, float(np.log(x)), s.log_sums[0] / s.n))
    for some in tries.values():
        of, sums, *rest = zip(*some, strict=True)
        lo, hi, at, share = (np.array(r, float) for r in rest)
        with np.errstate(all="ignore"):
            found = _below_all(np.array(sums, float), lo, hi, at)
            usable = np.isfinite(found).all(axis=1) & (found[:, 0] <= found[:, 1] + 1e-9)
        for i, (a, b), w, use in zip(of, found.tolist(), share.tolist(), usable, strict=True):
            if use:
                bounds[i] = max(bounds[i][0], w * (1 - b)), min(bounds[i][1], w * (1 - a))
    return [(low, high) if low <= high + 1e-9 else (0.0, 1.0) for low, high in bounds]


def rank_error_bound(state: State, x: float, p: float) -> float:
    if state.lo == state.hi:
        return 0.0
    low, high = above_bounds(state, x)
    return float(max(abs(p - (1 - high)), abs((1 - low) - p)))


def gaussian_quantiles(state: State, ps) -> list[float]:
    mean = state.sums[1] / state.n
    sd = max(state.sums[2] / state.n - mean * mean, 0.0) ** 0.5
    inner = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    return [min(state.hi, max(state.lo, NormalDist(mean, sd).inv_cdf(inner(p)) if sd else mean)) for p in ps]


CELLS = 1000


def _on_cells(state: State, order: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of cells in [-1, 1], trusted functions there (a row each), and their means."""
    y = np.linspace(-1, 1, CELLS)
    means = chebyshev_means(state.sums, state.lo, state.hi)
    k = min(order or len(means), trusted(means))
    return y, C.chebvander(y, k - 1).T, means[:k]


def _of_masses(state: State, y: np.ndarray, mass: np.ndarray, ps) -> list[float]:
    below = np.cumsum(np.clip(mass, 0, None))
    return [float(np.interp(p, below / below[-1], y) * (state.hi - state.lo) / 2 + (state.hi + state.lo) / 2) for p in ps]


def least_squares_quantiles(state: State, ps) -> list[float]:
    """Quantiles of the grid of masses nearest to uniform that has the moments; negative masses are cut."""
    y, functions, means = _on_cells(state)
    uniform = np.full(CELLS, 1 / CELLS)
    mass = uniform + np.linalg.lstsq(functions, means - functions @ uniform, rcond=None)[0]
    return _of_masses(state, y, mass, ps)


def cell_entropy_quantiles(state: State, ps) -> tuple[list[float], bool]:
    """Quantiles of the masses of greatest entropy on cells that have the moments; with a moment less while that does not converge."""
    for k in range(len(state.sums), 1, -1):
        y, functions, means = _on_cells(state, k)
        found, converged = newton(functions[None], means[None], np.full(CELLS, 2 / CELLS))
        if converged[0]:
            break
    return _of_masses(state, y, np.exp(np.minimum(found[0] @ functions, 700.0)), ps), bool(converged[0])


def _under(cap: float, functions: np.ndarray, means: np.ndarray, start: np.ndarray, tol: float = 1e-7, most: int = 60) -> tuple[np.ndarray, bool]:
    """Coefficients of the masses from 0 to a cap that have the means, and whether there are any.

    Of all such masses it takes those of greatest entropy with their distances from the cap, which
    have the form of a logistic curve: Newton steps on a smooth convex function of few coefficients.
    """
    at = start.copy()
    value = lambda c: cap * np.logaddexp(0.0, c @ functions).sum() - c @ means
    before = value(at)
    for _ in range(most):
        share = 1 / (1 + np.exp(-np.clip(at @ functions, -500, 500)))
        slope = functions @ (cap * share) - means
        if np.abs(slope).max() < tol:
            return at, True
        curve = (functions * (cap * share * (1 - share))) @ functions.T
        step = -np.linalg.lstsq(curve + 1e-14 * np.eye(len(curve)), slope, rcond=None)[0]
        size, downhill = 1.0, slope @ step
        while size > 1e-8 and not (after := value(at + size * step)) <= before + 0.1 * size * downhill:
            size /= 3
        if size <= 1e-8:
            return at, False
        at, before = at + size * step, after
    return at, False


def smallest_density_quantiles(state: State, ps, precision: float = 1e-3) -> tuple[list[float], bool]:
    """Quantiles of masses on cells whose greatest is as small as the moments allow, to a relative precision; and whether any masses have them.

    The dual of that linear programme has as many unknowns as there are moments; its cap is found by
    halving between the even mass, under which none can lie, and one that is wide enough. A moment
    less is taken while no cap is.
    """
    for k in range(len(state.sums), 1, -1):
        y, functions, means = _on_cells(state, k)
        low, high = 1 / CELLS, 1.0
        found, feasible = _under(high, functions, means, np.append(-np.log(CELLS - 1.0), np.zeros(len(means) - 1)))
        if feasible:
            break
    cap = high
    while feasible and high > low * (1 + precision):
        middle = (low * high) ** 0.5
        # the same coefficients under another cap are not the same masses: the constant takes up the difference
        tried, fits = _under(middle, functions, means, np.append(found[0] + np.log(cap / middle), found[1:]))
        if fits:
            high, found, cap = middle, tried, middle
        else:
            low = middle
    mass = cap / (1 + np.exp(-np.clip(found @ functions, -500, 500)))
    return _of_masses(state, y, mass, ps), feasible


def digest(values: np.ndarray, weights: np.ndarray, compression: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and weights of a merging t-digest: one pass over sorted values under the arcsine scale."""
    order = np.argsort(values, kind="stable")
    x, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    if not len(x):
        return x, w
    before = (np.cumsum(w) - w) / w.sum()
    place = compression / (2 * np.pi) * np.arcsin(np.clip(2 * (before + w / (2 * w.sum())) - 1, -1, 1))
    key = np.floor(place - place[0]).astype(int)
    starts = np.flatnonzero(np.append(True, np.diff(key) > 0))
    total = np.add.reduceat(w, starts)
    return np.add.reduceat(x * w, starts) / total, total


def digest_quantile(means: np.ndarray, weights: np.ndarray, lo: float, hi: float, p) -> np.ndarray:
    """Quantiles between centroid centers, with the ends at the extremes."""
    center = (np.cumsum(weights) - weights / 2) / weights.sum()
    return np.interp(p, np.concatenate([[0.0], center, [1.0]]), np.concatenate([[lo], means, [hi]]))


def digest_share_below(means, weights, lo, hi, x) -> np.ndarray:
    center = (np.cumsum(weights) - weights / 2) / weights.sum()
    return np.interp(x, np.concatenate([[lo], means, [hi]]), np.concatenate([[0.0], center, [1.0]]))
