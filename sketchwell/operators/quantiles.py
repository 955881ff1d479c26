"""Quantiles, shares and bounds from states: one Arrow pass over groups, never over data rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import moments as M
from ..functions import solver as S
from ..functions.lineage import checkpointed

QS = (0.01, *[round(0.05 * i, 2) for i in range(1, 20)], 0.99)

SOLVERS: dict[str, Callable[[list[S.State], tuple], list[tuple[list[float], bool]]]] = {
    "maxent": lambda ss, ps: S.quantiles_all(ss, ps),
    "maxent_single": lambda ss, ps: S.quantiles_all(ss, ps, both=False),
    "maxent_plain": lambda ss, ps: S.quantiles_all(ss, ps, both=False, logs=False),
    "maxent_log": lambda ss, ps: S.quantiles_all(ss, ps, both=False, logs=True),
    "hybrid": S.hybrid_all,
    "gaussian": lambda ss, ps: [(S.gaussian_quantiles(s, ps), True) for s in ss],
    "least_squares": lambda ss, ps: [(S.least_squares_quantiles(s, ps) if s.hi > s.lo else [s.lo] * len(ps), True) for s in ss],
    "cell_entropy": lambda ss, ps: [S.cell_entropy_quantiles(s, ps) if s.hi > s.lo else ([s.lo] * len(ps), True) for s in ss],
    "smallest_density": lambda ss, ps: [S.smallest_density_quantiles(s, ps) if s.hi > s.lo else ([s.lo] * len(ps), True) for s in ss],
}
#: States that are solved together; groups whose estimates are sent to every task.
TOGETHER, SENT = 256, 10_000


def states_of(pdf: pd.DataFrame, order: int, log_order: int) -> list[S.State]:
    """The states of a frame's rows, taken column by column."""
    plain = pdf[["n", *[f"p{i}" for i in range(1, order + 1)]]].to_numpy("float64")
    lo, hi = pdf["mn"].to_numpy("float64"), pdf["mx"].to_numpy("float64")
    if not log_order:
        return [S.State(a, b, tuple(x)) for a, b, x in zip(lo, hi, plain.tolist(), strict=True)]
    logs = pdf[["ln_n", *[f"l{i}" for i in range(1, log_order + 1)]]].to_numpy("float64")
    ends = pdf[["ln_mn", "ln_mx"]].to_numpy("float64").tolist()
    return [S.State(a, b, tuple(x), *e, tuple(y)) if y[0] > 0 else S.State(a, b, tuple(x)) for a, b, x, e, y in zip(lo, hi, plain.tolist(), ends, logs.tolist(), strict=True)]


def per_state(states: DataFrame, fields: list[T.StructField], use: Callable[[list[S.State], pd.DataFrame], list[list]]) -> DataFrame:
    """states with fields from use(states, frame), which gives a list for each field; groups come in batches.

    A group is a few bytes and much work, so groups are dealt over all cores, or over as many tasks as a
    shuffle has where those are more: their size alone would put many in one task.
    """
    order, log_order = M.order_of(states.columns), M.order_of(states.columns, "l")
    kept = [c for c in states.columns if c not in {f.name for f in fields}]
    states = states.select(*kept)
    schema = T.StructType([*states.schema.fields, *fields])

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[start : start + TOGETHER].reset_index(drop=True)
                for f, values in zip(fields, use(states_of(pdf, order, log_order), pdf), strict=True):
                    pdf[f.name] = pd.Series(values, index=pdf.index, dtype="object" if isinstance(f.dataType, (T.ArrayType, T.StructType)) else None)
                yield pdf

    spark = states.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return states.repartition(tasks).mapInPandas(run, schema)


def quantiles(states: DataFrame, ps=QS, method: str = "maxent") -> DataFrame:
    """states with qs (array, in the order of ps) and converged."""
    solve, ps = SOLVERS[method], tuple(ps)
    fields = [T.StructField("qs", T.ArrayType(T.DoubleType())), T.StructField("converged", T.BooleanType())]
    return per_state(states, fields, lambda ss, _: [list(x) for x in zip(*solve(ss, ps), strict=True)] or [[], []])


def error_bounds(solved: DataFrame, ps=QS) -> DataFrame:
    """solved (with qs) with errors: the greatest rank error each quantile can have."""
    ps = tuple(ps)
    use = lambda ss, pdf: [[[S.rank_error_bound(s, x, p) for x, p in zip(qs, ps, strict=True)] for s, qs in zip(ss, pdf["qs"], strict=True)]]
    return per_state(solved, [T.StructField("errors", T.ArrayType(T.DoubleType()))], use)


def exploded(solved: DataFrame, keys: list[str], ps=QS) -> DataFrame:
    """(keys, p, q): a row per group and quantile."""
    rows = F.arrays_zip(F.array(*[F.lit(float(p)) for p in ps]).alias("p"), F.col("qs").alias("q"))
    return solved.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.p", "x.q")


def canonical_points(states: DataFrame, t: float) -> DataFrame:
    """states with points: the (pos, weight) of the distribution with most mass at t."""
    item = T.StructType([T.StructField("pos", T.DoubleType()), T.StructField("weight", T.DoubleType())])

    def points(state):
        if not state.lo < t < state.hi:
            return []
        return [{"pos": float(a), "weight": float(b)} for a, b in zip(*S.Canonical(state.sums, state.lo, state.hi).points(t), strict=True)]

    return per_state(states, [T.StructField("points", T.ArrayType(item))], lambda ss, _: [[points(s) for s in ss]])


def canonical_entropy(pointed: DataFrame) -> DataFrame:
    """canonical_points with entropy, that of the points' weights."""
    return pointed.withColumn("entropy", F.aggregate("points", F.lit(0.0), lambda a, p: a - F.when(p["weight"] > 0, p["weight"] * F.log(p["weight"])).otherwise(0.0)))


def rank_errors(df: DataFrame, keys: list[str], x: str, estimates: DataFrame, ps) -> DataFrame:
    """(keys, p, q, n, rank_error) of estimates (keys, p, q) of the shares ps, against all rows of df.

    A group's estimates are one row, which each row of df meets once; what it lies below is counted
    in that row's place, so that counts combine on the map side. The estimates are cut from their
    lineage and counted first: those of up to SENT groups go to every task, those of more are merged.
    Left to Spark, the rows of df may be broadcast, since it takes them for as small as their file.
    """
    ps = sorted(float(p) for p in ps)
    per_group = estimates.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"_q{i}") for i, p in enumerate(ps)])
    qs = [f"_q{i}" for i in range(len(ps))]
    few = checkpointed(per_group.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *qs))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    sent = few.limit(SENT + 1).count() <= SENT
    joined = df.select(*keys, x).join(F.broadcast(few) if sent else few.hint("merge"), on) if keys else df.select(x).crossJoin(F.broadcast(few))  # one row without keys
    below = lambda i: [F.sum((F.col(x) < F.col(f"_q{i}")).cast("long")).alias(f"_l{i}"), F.sum((F.col(x) <= F.col(f"_q{i}")).cast("long")).alias(f"_r{i}")]
    counted = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(q).alias(q) for q in qs], *[c for i in range(len(ps)) for c in below(i)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_q{i}").alias("q"), F.col(f"_l{i}").alias("l"), F.col(f"_r{i}").alias("r")) for i, p in enumerate(ps)]))
    rows = counted.select(*keys, "n", each.alias("e")).where(F.col("e.q").isNotNull())
    at = F.floor(F.col("e.p") * F.col("n"))
    return rows.select(*keys, "e.p", "e.q", "n", (F.greatest(F.lit(0), at - F.col("e.r"), F.col("e.l") - at) / F.col("n")).alias("rank_error"))
