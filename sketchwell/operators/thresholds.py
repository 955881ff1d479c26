"""Is more than a share of a group above a value? A cascade from cheap bounds to a fitted density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import moments as M
from ..functions import solver as S
from .quantiles import per_state


def by_range(t: Column, share: Column) -> Column:
    """The verdict where the group's ends decide it, else null."""
    return F.when(share >= 1, F.lit(False)).when(t < F.col("mn"), F.lit(True)).when(t >= F.col("mx"), F.lit(False))


#: What bounds must clear a share by, since they are computed in floating point: Markov's, and those of moments.
MARKOV_SLACK, MOMENT_SLACK = 1e-9, 1e-6


def by_bounds(lo: Column, hi: Column, share: Column) -> Column:
    return F.when(lo > share + MARKOV_SLACK, F.lit(True)).when(hi < share - MARKOV_SLACK, F.lit(False))


def cascade(states: DataFrame, t: str, share: float, order: int | None = None, fit: bool = True) -> DataFrame:
    """states with above (more than `share` of the values exceed column t) and stage, that of the decision.

    With fit=False no density is fitted: groups that the bounds leave open have a null verdict and the
    stage 'open', for a caller that counts them.

    Range and Markov tests are columns. Only groups that they leave open go to Python, where moment
    bounds decide or else the fitted density; the densities of many groups are solved together. Both
    kinds come from one aggregation, whose exchange Spark reads twice.
    """
    order = order or M.order_of(states.columns)
    x, phi = F.col(t).cast("double"), F.lit(float(share))
    logs = "l1" in states.columns
    lo, hi = M.markov_bounds(x, order, logs)
    ranged, bounded = by_range(x, phi), by_bounds(lo, hi, phi)
    stage = F.when(ranged.isNotNull(), "range").when(bounded.isNotNull(), "markov")
    first = states.drop("above", "stage").withColumns({"above": F.coalesce(ranged, bounded), "stage": stage})
    fields = [T.StructField("above", T.BooleanType()), T.StructField("stage", T.StringType())]

    def use(found, pdf):
        at = pdf[t].astype("float64").tolist()
        bounds = S.above_bounds_all(found, at)
        open_ = [i for i, (low, high) in enumerate(bounds) if not (low > share + MOMENT_SLACK or high < share - MOMENT_SLACK)]
        if not fit:
            left = set(open_)
            return [[None if i in left else low > share for i, (low, _) in enumerate(bounds)], ["open" if i in left else "moments" for i in range(len(found))]]
        densities = dict(zip(open_, S.fit_all([found[i] for i in open_]), strict=True))
        above = [densities[i].share_below(at[i]) < 1 - share if i in densities else low > share for i, (low, _) in enumerate(bounds)]
        return [above, ["density" if i in densities else "moments" for i in range(len(found))]]

    decided = first.where(F.col("stage").isNotNull())
    return decided.unionByName(per_state(first.where(F.col("stage").isNull()), fields, use))


def counted_where_open(decided: DataFrame, keys: list[str], df: DataFrame, x: str, share: float) -> DataFrame:
    """decided (keys, t, above, stage, ...) with verdicts that are open, or that only a fitted density gave, counted on df's rows instead.

    All other stages are certain, so the result is exact; only the rows of open groups are read again.
    t may differ between a group's rows.
    """
    undecided = decided.where("stage IN ('open', 'density')").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("t").alias("_t")).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where(M.finite(F.col("_x"))).join(undecided, on)
    true = rows.groupBy(*[f"_k_{k}" for k in keys], "_t").agg((F.avg((F.col("_x") > F.col("_t")).cast("double")) > share).alias("_true"))
    joined = decided.join(true, [*on, F.col("t") == F.col("_t")], "left")
    seen = F.col("_true").isNotNull()
    return joined.select(*[F.coalesce("_true", "above").alias(c) if c == "above" else F.when(seen, "count").otherwise(F.col("stage")).alias(c) if c == "stage" else c for c in decided.columns])


def tail_bounds(states: DataFrame, t: float) -> DataFrame:
    """states with lo and hi, the bounds of the share above t, and share, its estimate."""

    def use(found, _):
        bounds = S.above_bounds_all(found, [t] * len(found))
        inside = [i for i, s in enumerate(found) if s.lo <= t < s.hi]
        densities = dict(zip(inside, S.fit_all([found[i] for i in inside]), strict=True))
        return [[b[0] for b in bounds], [b[1] for b in bounds], [1 - densities[i].share_below(t) if i in densities else b[0] for i, b in enumerate(bounds)]]

    return per_state(states, [T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "share")], use)


def stage_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("stage").agg(F.count(F.lit(1)).alias("groups"))
