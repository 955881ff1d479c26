import math

import numpy as np
import pytest

from sketchwell.functions import binomial
from sketchwell.operators import selection as L


def true_quantile(values, p):
    xs = sorted(v for v in values if v is not None and not math.isnan(v))
    return xs[max(1, len(xs) - math.floor(len(xs) - p * len(xs))) - 1]


@pytest.mark.parametrize("kind", ["distinct", "ties", "mixed", "infinite"])
def test_selection_equals_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(L, "FIT", 40)
    rng = np.random.default_rng(len(kind))
    rows = []
    for g, n in (("a", 5000), ("b", 700), ("c", 41), ("d", 40), ("e", 1), (None, 900)):
        values = {"distinct": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "mixed": np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n)), "infinite": np.where(rng.random(n) < 0.2, np.inf, rng.normal(size=n))}[kind]
        rows += [(g, float(v)) for v in values] + [(g, None), (g, float("nan"))]
    rows.append(("none", None))
    ps = (0.0, 0.01, 0.3, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: [r[f"q_{i}"] for i in range(len(ps))] for r in L.quantiles(df, ["g"], "v", ps).collect()}
    of = lambda g: [v for k, v in rows if k == g]
    assert got == {g: [true_quantile(of(g), p) for p in ps] for g in ("a", "b", "c", "d", "e", None)}
    mid = {r["g"]: r["median"] for r in L.median(df, ["g"], "v").collect()}
    for g in got:
        assert mid[g] == pytest.approx(np.median([v for v in of(g) if v is not None and not math.isnan(v)])) or math.isinf(mid[g])


def test_one_group_of_a_million_values_is_never_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(L, "FIT", 1000)
    n, seen = 1_000_000, []
    finish = L._finished
    monkeypatch.setattr(L, "_finished", lambda rows, searched, keys: seen.extend(r["inside"] for r in searched.collect()) or finish(rows, searched, keys))
    df = spark.range(n).selectExpr("cast((id * 7919) % 1000003 as double) as v")
    values = np.sort((np.arange(n) * 7919) % 1000003)
    r = L.select_ranks(df, [], "v", [L.disc_rank(0.2), L.disc_rank(0.999)]).first()
    assert (r["n"], r["q_0"], r["q_1"]) == (n, values[200_000 - 1], values[999_000 - 1])
    assert seen == [] or max(seen) <= 1000


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert L.quantiles(empty, ["g"], "v", (0.5,)).count() == 0 and L.median(empty, [], "v").count() == 0


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_binomial_limits_leave_the_stated_tails():
    hits, n = np.array([1, 3, 40, 99, 50]), np.array([10, 3, 100, 100, 120])
    lo, hi = binomial.limits(hits, n, 0.05)
    for k, m, a, b in zip(hits, n, lo, hi, strict=True):
        assert binomial_tail(int(k), int(m), a) == pytest.approx(0.025, rel=1e-6)
        assert b == 1 if k == m else 1 - binomial_tail(int(k) + 1, int(m), b) == pytest.approx(0.025, rel=1e-6)
    assert binomial.limits(np.array([0]), np.array([5]), 0.05)[0][0] == 0
    assert binomial.incomplete_beta(np.array([0.5]), np.array([2.0]), np.array([2.0]))[0] == pytest.approx(0.5)
