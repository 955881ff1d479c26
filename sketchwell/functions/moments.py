"""Moment states as flat columns, and what has a closed form over them.

A state is n, mn, mx, p1..pk (power sums) and, with logs, ln_n, ln_mn, ln_mx, l1..lk over the values
above zero. Flat columns keep every sum a built-in aggregate that combines on the map side.
"""

from __future__ import annotations

from functools import reduce
from math import comb, log10

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def power(x: Column, i: int) -> Column:
    return reduce(lambda a, b: a * b, [x] * i)


def building(x: Column, order: int, logs: bool = False) -> list[Column]:
    """Aggregates that make a state of x."""
    x = x.cast("double")
    out = [F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx")]
    out += [F.sum(power(x, i)).alias(f"p{i}") for i in range(1, order + 1)]
    if logs:
        y = F.when(x > 0, F.log(x))
        out += [F.count(y).alias("ln_n"), F.min(y).alias("ln_mn"), F.max(y).alias("ln_mx")]
        out += [F.sum(power(y, i)).alias(f"l{i}") for i in range(1, order + 1)]
    return out


def merging(columns: list[str]) -> list[Column]:
    """Aggregates that merge states: sums of counts and sums, least and greatest ends."""
    out = []
    for c in columns:
        if c in ("mn", "ln_mn"):
            out.append(F.min(c).alias(c))
        elif c in ("mx", "ln_mx"):
            out.append(F.max(c).alias(c))
        elif c in ("n", "ln_n") or (c[0] in "pl" and c[1:].isdigit()):
            out.append(F.sum(c).alias(c))
    return out


def state_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c in ("n", "mn", "mx", "ln_n", "ln_mn", "ln_mx") or (c[0] in "pl" and c[1:].isdigit())]


def order_of(columns: list[str], letter: str = "p") -> int:
    return max((int(c[1:]) for c in columns if c[0] == letter and c[1:].isdigit()), default=0)


def _sums(letter: str, order: int) -> list[Column]:
    return [F.col("n" if letter == "p" else "ln_n").cast("double"), *[F.col(f"{letter}{i}") for i in range(1, order + 1)]]


def shifted(sums: list[Column], m: int, center: Column, half: Column | None = None) -> Column:
    """Sum of ((x - center) / half) ** m from the sums of powers of x."""
    total = sum((comb(m, j) * power(-center, m - j) * sums[j] if m - j else sums[j] for j in range(m + 1)), F.lit(0.0))
    return total / power(half, m) if half is not None and m else total


def scaled_moments(order: int, letter: str = "p") -> list[Column]:
    """Means of y ** m, y being the values scaled to [-1, 1]."""
    lo, hi = ("mn", "mx") if letter == "p" else ("ln_mn", "ln_mx")
    center, half = (F.col(hi) + F.col(lo)) / 2, (F.col(hi) - F.col(lo)) / 2
    sums = _sums(letter, order)
    return [shifted(sums, m, center, half) / sums[0] for m in range(order + 1)]


def chebyshev_coefficients(order: int) -> list[list[int]]:
    rows = [[1], [0, 1]]
    while len(rows) <= order:
        doubled = [0, *[2 * c for c in rows[-1]]]
        rows.append([c - (rows[-2][i] if i < len(rows[-2]) else 0) for i, c in enumerate(doubled)])
    return rows[: order + 1]


def chebyshev_moments(order: int, letter: str = "p") -> list[Column]:
    scaled = scaled_moments(order, letter)
    return [sum((c * scaled[j] for j, c in enumerate(row) if c), F.lit(0.0)) for row in chebyshev_coefficients(order)]


def unit_moments(order: int) -> list[Column]:
    """Means of u ** m, u being the values scaled to [0, 1]."""
    sums = _sums("p", order)
    return [shifted(sums, m, F.col("mn"), F.col("mx") - F.col("mn")) / sums[0] for m in range(order + 1)]


def inversion_quantile(p: float, order: int) -> Column:
    """Quantile by binomial inversion of the moments: a step of the range, 1/order wide."""
    u = unit_moments(order)
    mass = [sum(((-1) ** (j - k) * comb(order, j) * comb(j, k) * u[j] for j in range(k, order + 1)), F.lit(0.0)) for k in range(order + 1)]
    below = [sum(mass[: k + 1], F.lit(0.0)) for k in range(order + 1)]
    step = reduce(lambda rest, k: F.when(below[k] >= p, F.lit(k)).otherwise(rest), range(order, -1, -1), F.lit(order))
    return step / F.lit(float(order)) * (F.col("mx") - F.col("mn")) + F.col("mn")


def inversion_quantiles(ps, order: int) -> Column:
    """inversion_quantile of every p, as an array; the moments are worked out once."""
    weights = [[float(sum((-1) ** (j - i) * comb(order, j) * comb(j, i) for i in range(min(j, k) + 1))) for j in range(order + 1)] for k in range(order + 1)]
    table = F.array(*[F.array(*[F.lit(w) for w in row]) for row in weights])
    product = lambda row, u: F.aggregate(F.zip_with(row, u, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    below = F.flatten(F.transform(F.array(F.array(*unit_moments(order))), lambda u: F.transform(table, lambda row: product(row, u))))
    step = lambda b, p: F.when(F.exists(b, lambda x: x >= p), F.array_position(F.transform(b, lambda x: x >= p), True) - 1).otherwise(F.lit(order))
    steps = F.flatten(F.transform(F.array(below), lambda b: F.transform(F.array(*[F.lit(float(p)) for p in ps]), lambda p: step(b, p))))
    return F.transform(steps, lambda k: k / F.lit(float(order)) * (F.col("mx") - F.col("mn")) + F.col("mn"))


def _markov(sums: list[Column], lo: Column, hi: Column, t: Column) -> tuple[Column, Column]:
    """Markov's least and greatest share above t, lo < t < hi, over all orders; higher-order functions keep the generated code small."""
    order = len(sums) - 1
    held, binomials = F.array(*sums), F.array(*[F.array(*[F.lit(float(comb(m, j))) for j in range(m + 1)]) for m in range(order + 1)])
    term = lambda m, j, center: F.get(F.get(binomials, m), j) * F.pow(-center, m - j) * F.get(held, j)
    about = lambda m, center: F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda total, j: total + term(m, j, center)) / sums[0]
    orders = F.sequence(F.lit(1), F.lit(order))
    upper = F.array_min(F.transform(orders, lambda m: about(m, lo) / F.pow(t - lo, m)))
    lower = F.array_max(F.transform(orders, lambda m: 1 - F.when(m % 2 == 0, 1).otherwise(-1) * about(m, hi) / F.pow(hi - t, m)))
    return lower, upper


def markov_bounds(t: Column, order: int, logs: bool = False) -> tuple[Column, Column]:
    """Least and greatest possible share above t, by Markov's inequality on every moment; 0 or 1 outside the range.

    Values of at most zero are never above a positive t, so bounds from logarithms cover the positive
    share only.
    """
    lo, hi = _markov(_sums("p", order), F.col("mn"), F.col("mx"), t)
    lower, upper = [F.lit(0.0), lo], [F.lit(1.0), hi]
    if logs:
        n, y = _sums("l", order), F.log(t)
        share = F.col("ln_n") / F.col("n")
        usable = (t > 0) & (F.col("ln_mn") < y) & (y < F.col("ln_mx"))
        lo, hi = _markov(n, F.col("ln_mn"), F.col("ln_mx"), y)
        lower.append(F.when(usable, share * lo))
        upper.append(F.when(usable, share * hi))
    inside = (F.col("mn") < t) & (t < F.col("mx"))
    edge = F.when(t < F.col("mn"), F.lit(1.0)).when(t >= F.col("mx"), F.lit(0.0))
    lo = F.when(inside, F.greatest(*lower)).otherwise(F.coalesce(edge, F.lit(0.0)))
    hi = F.when(inside, F.least(*upper)).otherwise(F.coalesce(edge, F.lit(1.0)))
    return lo, hi


def markov_quantile_error(q: Column, p: float) -> Column:
    """The greatest rank error of q as the p-quantile of a state, by Markov's inequality on its mean alone."""
    reach = F.when(q > F.col("mn"), (F.col("p1") / F.col("n") - F.col("mn")) / (q - F.col("mn"))).otherwise(F.lit(1.0))
    return F.greatest(F.lit(float(p)), F.least(F.lit(1.0), reach) - (1 - p))


def usable_order(center_over_half: Column) -> Column:
    """The highest order whose scaled sums keep some digits in double precision."""
    return F.floor((53 * log10(2) - 2.58) / (log10(6) + F.log10(F.abs(center_over_half) + 1))).cast("long")


def state_bytes(order: int, logs: bool) -> int:
    """Size of a state: its counts, ends and sums as doubles."""
    return 8 * (3 + order) * (2 if logs else 1)
