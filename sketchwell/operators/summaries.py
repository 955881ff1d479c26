"""Other quantile summaries behind one interface: build, merge, quantiles, size.

Histograms on power-of-two grids and KLL use Spark's own aggregates; reservoirs are the rows of least
hash. T-digests, streaming histograms that merge, Greenwald-Khanna tuples and random buffers are
stored states (adaptive tuples and drawn reservoirs too): each task keeps one a group through all its batches, and states of a group merge in
two levels, so that no task gets more than a share of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import buffers as B
from ..functions import moments as M
from ..functions import solver as S
from ..functions.binomial import limits
from . import quantiles as Q
from . import states

#: Groups whose states a task holds before it hands them on; shares in which a group's states merge first.
HELD, SHARES = 10_000, 64
#: Rows that a task gathers before it drops those that cannot be in a reservoir.
GATHERED = 200_000


def grid_histogram(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """(keys, width, origin, bin, n): bins on a grid whose width is a power of two, so that grids nest."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.pow(F.lit(2.0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / (bins - 1))))).otherwise(F.lit(1.0))
    ends = ends.withColumn("width", width).withColumn("origin", F.floor(F.col("_lo") / F.col("width")) * F.col("width"))
    joined = df.join(ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "width", "origin"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else df.crossJoin(F.broadcast(ends))
    spot = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("origin")) / F.col("width"))).cast("int")
    return joined.groupBy(*keys, "width", "origin", spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of one grid family brought to the widest grid of each group and added."""
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    wide = hist.withColumn("_w", F.max("width").over(group)).withColumn("_at", F.col("origin") + F.col("bin") * F.col("width"))
    wide = wide.withColumn("_o", F.floor(F.min("origin").over(group) / F.col("_w")) * F.col("_w"))
    return wide.groupBy(*keys, F.col("_w").alias("width"), F.col("_o").alias("origin"), F.floor((F.col("_at") - F.col("_o")) / F.col("_w")).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def histogram_quantile(hist: DataFrame, keys: list[str], p: float) -> DataFrame:
    """(keys, q): linear inside the bin that reaches p of the count."""
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    run = hist.withColumn("_upto", F.sum("n").over(group.orderBy("bin"))).withColumn("_all", F.sum("n").over(group))
    reached = run.where(F.col("_upto") >= p * F.col("_all"))
    inside = (F.col("bin") + (p * F.col("_all") - (F.col("_upto") - F.col("n"))) / F.col("n")) * F.col("width") + F.col("origin")
    return reached.groupBy(*keys).agg(F.min_by(inside, F.col("bin")).alias("q"))


def kll(df: DataFrame, keys: list[str], x: str, k: int = 200) -> DataFrame:
    """(keys, sketch): mergeable KLL sketches."""
    return df.groupBy(*keys).agg(F.call_function("kll_sketch_agg_double", F.col(x).cast("double"), F.lit(k)).alias("sketch"))


def merge_kll(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"))


def kll_quantiles(sketches: DataFrame, keys: list[str], ps) -> DataFrame:
    """(keys, qs)."""
    return sketches.select(*keys, F.array(*[F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(p))) for p in ps]).alias("qs"))


def kll_rank(sketches: DataFrame, keys: list[str], x: float) -> DataFrame:
    return sketches.select(*keys, F.call_function("kll_sketch_get_rank_double", F.col("sketch"), F.lit(float(x))).alias("rank"))


def gk_quantiles(df: DataFrame, keys: list[str], x: str, ps, accuracy: int = 100) -> DataFrame:
    """(keys, qs) within a rank error of 1 / accuracy."""
    return df.groupBy(*keys).agg(F.percentile_approx(x, [float(p) for p in ps], accuracy).alias("qs"))


def built(df: DataFrame, keys: list[str], x: str, fields: str, add) -> DataFrame:
    """(keys, fields, mn, mx): states of the finite values of x, one a group and task; add(state or None, values) gives a state as a tuple of arrays."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where(M.finite(F.col("_x")))
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], fields, "mn double", "mx double"])

    def out(held):
        found = [[*key, *state, lo, hi] for key, (state, lo, hi) in held.items()]
        return pd.DataFrame(found, columns=[*keys, *names, "mn", "mx"])

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False)["_x"] if keys else [((), pdf["_x"])]:
                key = tuple(None if k is pd.NaT or k != k else k for k in key)
                values = part.to_numpy()
                state, lo, hi = held.get(key, (None, np.inf, -np.inf))
                held[key] = add(state, values), min(lo, values.min()), max(hi, values.max())
            if len(held) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return rows.mapInPandas(run, schema)


def merged(parts: DataFrame, keys: list[str], names: list[str], merge) -> DataFrame:
    """parts (keys, names, mn, mx) with one row a group; merge(lists of arrays, one for each name) gives a state."""
    schema = parts.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = merge(*[pdf[c].to_list() for c in names])
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *state, pdf["mn"].min(), pdf["mx"].max()]], columns=schema.names)

    share = F.spark_partition_id() % SHARES
    first = parts.withColumn("_share", share).groupBy(*keys, "_share").applyInPandas(lambda pdf: run(pdf.drop(columns="_share")), schema)
    return first.groupBy(*keys).applyInPandas(run, schema)


def per_group(states: DataFrame, keys: list[str], field: str, use) -> DataFrame:
    """(keys, field): use(row) of every state's row."""

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(**{field.split()[0]: pd.Series([use(r) for r in pdf.itertuples(index=False)], index=pdf.index, dtype="object" if "array" in field else None)})

    return states.mapInPandas(run, ", ".join([*[f"`{k}` {states.schema[k].dataType.simpleString()}" for k in keys], field]))


def _joined(lists) -> np.ndarray:
    return np.concatenate([np.asarray(x, float) for x in lists])


def streaming_histogram(df: DataFrame, keys: list[str], x: str, size: int, low: float | None = None, high: float | None = None, least: float = 0.0) -> DataFrame:
    """(keys, centers, counts, mn, mx): at most size centers with counts, the nearest merged, and those nearer than least in any case; with limits, of values from low to high only."""
    if low is not None or high is not None:
        within = (F.col(x) >= F.lit(low)) if low is not None else F.lit(True)
        df = df.where(within & (F.col(x) <= F.lit(high)) if high is not None else within)

    def add(state, values):
        distinct, n = np.unique(values, return_counts=True)
        return B.nearest_merged(distinct, n, size, least) if state is None else B.nearest_merged(np.concatenate([state[0], distinct]), np.concatenate([state[1], n]), size, least)

    return merge_streaming_histograms(built(df, keys, x, "centers array<double>, counts array<double>", add), keys, size, least)


def merge_streaming_histograms(hists: DataFrame, keys: list[str], size: int, least: float = 0.0) -> DataFrame:
    return merged(hists.select(*keys, "centers", "counts", "mn", "mx"), keys, ["centers", "counts"], lambda c, n: B.nearest_merged(_joined(c), _joined(n), size, least))


def streaming_histogram_quantiles(hists: DataFrame, keys: list[str], ps) -> DataFrame:
    """(keys, qs) by trapezoids between centers; the ends are exact."""
    ps = [float(p) for p in ps]
    return per_group(hists, keys, "qs array<double>", lambda r: B.trapezoid_quantiles(np.array(r.centers), np.array(r.counts), r.mn, r.mx, ps))


def streaming_histogram_below(hists: DataFrame, keys: list[str], x: float) -> DataFrame:
    """(keys, n_below): how many values are at most x, by the trapezoid that x is in."""
    return per_group(hists, keys, "n_below double", lambda r: B.trapezoid_share(np.array(r.centers), np.array(r.counts), r.mn, r.mx, x) * sum(r.counts))


def tdigest(df: DataFrame, keys: list[str], x: str, compression: float = 100.0) -> DataFrame:
    """(keys, means, weights, mn, mx): a digest per group."""

    def add(state, values):
        means, weights = state or (np.zeros(0), np.zeros(0))
        return S.digest(np.concatenate([means, values]), np.concatenate([weights, np.ones(len(values))]), compression)

    return merge_tdigests(built(df, keys, x, "means array<double>, weights array<double>", add), keys, compression)


def merge_tdigests(digests: DataFrame, keys: list[str], compression: float = 100.0) -> DataFrame:
    return merged(digests.select(*keys, "means", "weights", "mn", "mx"), keys, ["means", "weights"], lambda m, w: S.digest(_joined(m), _joined(w), compression))


def tdigest_quantiles(digests: DataFrame, keys: list[str], ps) -> DataFrame:
    ps = [float(p) for p in ps]
    return per_group(digests, keys, "qs array<double>", lambda r: S.digest_quantile(np.array(r.means), np.array(r.weights), r.mn, r.mx, ps).tolist())


def tdigest_below(digests: DataFrame, keys: list[str], x: float) -> DataFrame:
    """(keys, share): the share of values at most x."""
    return per_group(digests, keys, "share double", lambda r: B.share_below(np.array(r.means), np.array(r.weights), r.mn, r.mx, x))


_BUFFERS = ["held", "weights", "open"]


def random_buffers(df: DataFrame, keys: list[str], x: str, accuracy: int, seed: int = 0) -> DataFrame:
    """(keys, held, weights, open, mn, mx): buffers whose ranks are within 1 / accuracy with high probability.

    Their size follows from the accuracy alone. Once they have been full often enough, only one of
    2, 4, 8 .. values is taken, so that the work on a value falls as a group grows.
    """
    fields = "held array<double>, weights array<double>, open array<double>"
    add = lambda state, values: B.buffers_added(state, values, 1 / accuracy, seed)
    return merge_random_buffers(built(df, keys, x, fields, add), keys, accuracy, seed)


def merge_random_buffers(parts: DataFrame, keys: list[str], accuracy: int, seed: int = 0) -> DataFrame:
    return merged(parts.select(*keys, *_BUFFERS, "mn", "mx"), keys, _BUFFERS, lambda v, w, o: B.buffers_merged(v, w, o, 1 / accuracy, seed))


def random_quantiles(parts: DataFrame, keys: list[str], ps) -> DataFrame:
    ps = [float(p) for p in ps]
    return per_group(parts, keys, "qs array<double>", lambda r: B.weighted_quantile(np.append(r.held, r.open[:1]), np.append(r.weights, r.open[1:]), ps))


def drawn_reservoir(df: DataFrame, keys: list[str], x: str, k: int, seed: int = 0) -> DataFrame:
    """(keys, sample, n, mn, mx): an even sample of k values of each group, and how many it stands for; rows need no id and keep no priority."""
    add = lambda state, values: B.reservoir_added(state, values, k, seed)
    return merge_drawn_reservoirs(built(df, keys, x, "sample array<double>, n long", add), keys, k, seed)


def merge_drawn_reservoirs(parts: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """Samples of parts of any sizes as one: how many values come from each is drawn by the parts' counts."""
    return merged(parts.select(*keys, "sample", "n", "mn", "mx"), keys, ["sample", "n"], lambda s, n: B.reservoirs_joined([np.asarray(v, float) for v in s], n, k, seed))


def drawn_reservoir_quantiles(parts: DataFrame, keys: list[str], ps) -> DataFrame:
    ps = [float(p) for p in ps]
    return per_group(parts, keys, "qs array<double>", lambda r: B.weighted_quantile(np.array(r.sample), np.ones(len(r.sample)), ps))


_TUPLES = ["tops", "gaps", "slacks"]


def gk(df: DataFrame, keys: list[str], x: str, accuracy: int) -> DataFrame:
    """(keys, tops, gaps, slacks, mn, mx): Greenwald-Khanna tuples whose ranks are within 1 / accuracy, as a stored state."""
    error = 1 / (2 * accuracy)  # half for building, since merging adds

    def add(state, values):
        fresh = B.fresh_tuples(values, error)
        both = [fresh] if state is None else [state, fresh]
        return B.tuples_merged(*zip(*both, strict=True), error)

    return merge_gk(built(df, keys, x, "tops array<double>, gaps array<double>, slacks array<double>", add), keys, accuracy)


def merge_gk(parts: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    error = 1 / (2 * accuracy)
    arrays = lambda lists: [np.asarray(x, float) for x in lists]
    return merged(parts.select(*keys, *_TUPLES, "mn", "mx"), keys, _TUPLES, lambda v, g, d: B.tuples_merged(arrays(v), arrays(g), arrays(d), error))


def gk_state_quantiles(parts: DataFrame, keys: list[str], ps) -> DataFrame:
    ps = [float(p) for p in ps]
    return per_group(parts, keys, "qs array<double>", lambda r: B.tuple_quantile(np.array(r.tops), np.array(r.gaps), np.array(r.slacks), ps))


def gk_adaptive(df: DataFrame, keys: list[str], x: str, accuracy: int) -> DataFrame:
    """(keys, tops, gaps, slacks, pending, mn, mx): tuples whose ranks are within 1 / accuracy, and values that wait to become some."""
    fields = "tops array<double>, gaps array<double>, slacks array<double>, pending array<double>"
    return merge_gk_adaptive(built(df, keys, x, fields, lambda state, values: B.adaptive_added(state, values, 1 / accuracy)), keys, accuracy)


def merge_gk_adaptive(parts: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    names = [*_TUPLES, "pending"]
    return merged(parts.select(*keys, *names, "mn", "mx"), keys, names, lambda v, g, d, w: B.adaptive_merged(v, g, d, w, 1 / accuracy))


def gk_adaptive_quantiles(parts: DataFrame, keys: list[str], ps, accuracy: int) -> DataFrame:
    ps = [float(p) for p in ps]
    whole = lambda r: B.adaptive_whole(r.tops, r.gaps, r.slacks, r.pending, 1 / accuracy)
    return per_group(parts, keys, "qs array<double>", lambda r: B.tuple_quantile(*whole(r), ps))


def kll_cdf(sketches: DataFrame, keys: list[str], splits) -> DataFrame:
    """(keys, cdf): the shares of values at most each split."""
    return sketches.select(*keys, F.array(*[F.call_function("kll_sketch_get_rank_double", F.col("sketch"), F.lit(float(x))) for x in splits]).alias("cdf"))


def kll_pmf(sketches: DataFrame, keys: list[str], splits) -> DataFrame:
    """(keys, pmf): the shares of values between splits; the first is of those up to the least split, the last of those above the greatest."""
    cdf = kll_cdf(sketches, keys, splits)
    ends = F.concat(F.array(F.lit(0.0)), F.col("cdf")), F.concat(F.col("cdf"), F.array(F.lit(1.0)))
    return cdf.select(*keys, F.zip_with(*ends, lambda a, b: b - a).alias("pmf"))


def kll_bounds(sketches: DataFrame, keys: list[str], p: float, k: int) -> DataFrame:
    """(keys, lo, q, hi): a quantile and those a rank error lower and higher, between which the true one lies."""
    at = lambda s: F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(min(1.0, max(0.0, s)))))
    error = kll_error(k, pmf=False)
    return sketches.select(*keys, at(p - error).alias("lo"), at(p).alias("q"), at(p + error).alias("hi"))


def even_quantiles(sketches: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, qs): n quantiles of evenly spaced shares from 0 to 1."""
    return kll_quantiles(sketches, keys, [i / (n - 1) for i in range(n)])


def reservoir(df: DataFrame, keys: list[str], row_id: str, x: str, k: int, seed: int = 42) -> DataFrame:
    """(keys, x, priority): the k rows of least hash of each group, the same whatever the partitions; merges by taking them again."""
    rows = df.select(*keys, F.col(x).alias("x"), F.xxhash64(F.lit(seed), F.col(row_id)).alias("priority"))
    return merge_reservoirs(least_of_tasks(rows, keys, k), keys, k)


def least_of_tasks(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, x, priority) without those that more than k of their group precede in their task.

    A task holds k rows of each group and the next GATHERED rows, so that it neither sorts nor shuffles
    a whole table; it hands on what it holds at over HELD groups' worth of rows.
    """

    def least(held: pa.Table) -> pa.Table:
        code = np.zeros(held.num_rows, "int64")
        for c in keys:
            found = pc.dictionary_encode(held[c], null_encoding="encode").combine_chunks()
            code = np.unique(code * max(1, len(found.dictionary)) + found.indices.to_numpy(), return_inverse=True)[1]
        x = pc.cast(held["x"], pa.float64(), safe=False)
        value = pc.fill_null(x, 0.0).to_numpy()
        order = np.lexsort((value, pc.is_valid(x).to_numpy(), held["priority"].to_numpy(), code))  # nulls first, as Spark has them
        first = np.searchsorted(code[order], code[order])
        return held.take(pa.array(np.sort(order[np.arange(len(order)) - first < k]))).combine_chunks()

    def run(batches):
        held, waiting, n = None, [], 0

        def gathered():
            return least(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(waiting)]))

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                held, waiting, n = gathered(), [], 0
                if held.num_rows > HELD * 100:
                    yield from held.to_batches()
                    held = None
        if waiting:
            held = gathered()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def merge_reservoirs(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of least hash of each group: first within shares of a group, then of what these leave."""
    least = lambda df, by: df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("priority", "x"))).where(F.col("_r") <= k).drop("_r")
    shared = least(rows.withColumn("_share", F.pmod("priority", F.lit(SHARES))), [*keys, "_share"]).drop("_share")
    return least(shared, keys or [F.lit(1)])


def subset_sum(sample: DataFrame, keys: list[str], total: DataFrame, condition, miss: float = 0.01) -> DataFrame:
    """(keys, lo, estimate, hi, n): how many of n rows meet the condition, from a sample; exact binomial limits that miss with this probability."""
    hits = sample.groupBy(*keys).agg(F.sum(condition.cast("long")).alias("_hits"), F.count(F.lit(1)).alias("_k"))
    joined = hits.join(total, keys) if keys else hits.crossJoin(total)
    schema = T.StructType([*(joined.schema[k] for k in keys), *[T.StructField(c, T.DoubleType()) for c in ("lo", "estimate", "hi")], joined.schema["n"]])

    def run(batches):
        for pdf in batches:
            lo, hi = limits(pdf["_hits"].to_numpy(), pdf["_k"].to_numpy(), miss)
            yield pdf[[*keys, "n"]].assign(lo=lo * pdf["n"], estimate=pdf["_hits"] / pdf["_k"] * pdf["n"], hi=hi * pdf["n"])[schema.names]

    return joined.mapInPandas(run, schema)


def ks_distance(df: DataFrame, side: str, x: str) -> DataFrame:
    """(distance) between the distributions of x on the two values of a boolean column: the greatest gap of their CDFs.

    Distinct values are counted first; running counts come from ranges of values, then within each.
    """
    counts = df.groupBy(F.col(x).alias("x")).agg(F.sum(F.col(side).cast("long")).alias("a"), F.sum((~F.col(side)).cast("long")).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    upto = running(counts, "x", ["a", "b"])
    gap = F.abs(F.col("upto_a") / F.col("na") - F.col("upto_b") / F.col("nb"))
    return upto.crossJoin(F.broadcast(total)).agg(F.max(gap).alias("distance"))


def ks_threshold(n, m, alpha: float = 0.05):
    """The distance that two samples of n and m values of one distribution exceed with a chance of alpha; numbers or columns."""
    reach = (-0.5 * log(alpha / 2)) ** 0.5
    return reach * (F.sqrt((n + m) / (n * m)) if isinstance(n, Column) else ((n + m) / (n * m)) ** 0.5)


def ks_test(df: DataFrame, side: str, x: str, alpha: float = 0.05) -> DataFrame:
    """(distance, threshold, differ): whether x is told apart on the two values of a boolean column."""
    counts = df.where(F.col(x).isNotNull()).agg(F.sum(F.col(side).cast("long")).alias("_n"), F.sum((~F.col(side)).cast("long")).alias("_m"))
    joined = ks_distance(df, side, x).crossJoin(counts)  # one row each
    found = joined.withColumn("threshold", ks_threshold(F.col("_n").cast("double"), F.col("_m").cast("double"), alpha))
    return found.select("distance", "threshold", (F.col("distance") > F.col("threshold")).alias("differ"))


def kll_ks(one: DataFrame, two: DataFrame, points: int = 200) -> DataFrame:
    """(distance) between two sketches (a row each), at `points` quantiles of both; off by a point's share and the sketches' errors."""
    at = lambda c: F.array(*[F.call_function("kll_sketch_get_quantile_double", F.col(c), F.lit(i / points)) for i in range(1, points)])
    both = one.select(F.col("sketch").alias("_a")).crossJoin(two.select(F.col("sketch").alias("_b"))).select(at("_a").alias("_a"), at("_b").alias("_b"))
    rank = lambda c: F.size(F.filter(c, lambda q: q <= F.col("_x"))) / points
    return both.select("_a", "_b", F.explode(F.concat("_a", "_b")).alias("_x")).agg(F.max(F.abs(rank("_a") - rank("_b"))).alias("distance"))


def running(df: DataFrame, order: str, values: list[str], ranges: int = 64) -> DataFrame:
    """df with upto_<v>: sums of v up to each row in the order of a distinct column, without one task that sees all rows."""
    edges = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(order))) if edges else F.lit(0)
    rows = df.withColumn("_part", part)
    before = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    before = before.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_sum_{v}").over(ahead), F.lit(0)).alias(f"_before_{v}") for v in values])
    within = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, *[(F.col(f"_before_{v}") + F.sum(v).over(within)).alias(f"upto_{v}") for v in values])


def kll_error(k: int, pmf: bool = True) -> float:
    return 2.296 / k**0.9723 if not pmf else 2.446 / k**0.9433


def k_for_error(error: float, pmf: bool = True) -> int:
    return next(k for k in range(8, 65_536) if kll_error(k, pmf) <= error)


@dataclass(frozen=True)
class Summary:
    """One summary behind the common contract: quantiles(df, keys, x, ps) gives (keys, qs)."""

    name: str
    size: float

    def quantiles(self, df: DataFrame, keys: list[str], x: str, ps) -> DataFrame:
        return REGISTRY[self.name](df, keys, x, ps, self.size)

    def error(self) -> float | None:
        return {"gk": lambda s: 1 / s, "gk_adaptive": lambda s: 1 / s, "kll": lambda s: kll_error(int(s)), "random": lambda s: 1 / s, "reservoir": lambda s: 2.5 * (0.25 / s) ** 0.5, "drawn_reservoir": lambda s: 2.5 * (0.25 / s) ** 0.5}.get(canonical(self.name), lambda s: None)(self.size)


def _from_states(df, keys, x, ps, size, logs, method):
    return Q.quantiles(states.build(df, keys, F.col(x), int(size) - 1, logs), ps, method).select(*keys, "qs")


def _reservoir_quantiles(df, keys, x, ps, size):
    with_id = df.withColumn("_id", F.xxhash64(*df.columns)) if "_id" not in df.columns else df
    sample = reservoir(with_id, keys, "_id", x, int(size))
    return sample.groupBy(*keys).agg(F.array(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)") for p in ps]).alias("qs"))


def _grid_quantiles(df, keys, x, ps, size):
    hist, out = grid_histogram(df, keys, x, int(size)), None
    for i, p in enumerate(ps):
        one = histogram_quantile(hist, keys, p).withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "q"))), lambda s: s["q"]).alias("qs"))


REGISTRY = {
    "moments": lambda df, keys, x, ps, size: _from_states(df, keys, x, ps, size, False, "maxent_plain"),
    "log_moments": lambda df, keys, x, ps, size: _from_states(df, keys, x, ps, size, True, "maxent"),
    "hybrid_moments": lambda df, keys, x, ps, size: _from_states(df, keys, x, ps, size, True, "hybrid"),
    "grid_histogram": _grid_quantiles,
    "streaming_histogram": lambda df, keys, x, ps, size: streaming_histogram_quantiles(streaming_histogram(df, keys, x, int(size)), keys, ps),
    "gk": lambda df, keys, x, ps, size: gk_quantiles(df, keys, x, ps, int(size)),
    "gk_adaptive": lambda df, keys, x, ps, size: gk_adaptive_quantiles(gk_adaptive(df, keys, x, int(size)), keys, ps, int(size)),
    "random": lambda df, keys, x, ps, size: random_quantiles(random_buffers(df, keys, x, int(size)), keys, ps),
    "kll": lambda df, keys, x, ps, size: kll_quantiles(kll(df, keys, x, int(size)), keys, ps),
    "tdigest": lambda df, keys, x, ps, size: tdigest_quantiles(tdigest(df, keys, x, size), keys, ps),
    "reservoir": _reservoir_quantiles,
    "drawn_reservoir": lambda df, keys, x, ps, size: drawn_reservoir_quantiles(drawn_reservoir(df, keys, x, int(size)), keys, ps),
    "exact": lambda df, keys, x, ps, size: df.groupBy(*keys).agg(F.array(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})") for p in ps]).alias("qs")),
}
#: Names that configurations use for the same summaries.
ALIASES = {"cmoments": "log_moments", "hybrid": "hybrid_moments", "histogram": "grid_histogram", "approx_histogram": "streaming_histogram", "spark_gk": "gk", "yahoo": "kll", "sampling": "reservoir", "reservoir_sampling": "drawn_reservoir"}


def canonical(name: str) -> str:
    found = ALIASES.get(name, name)
    if found not in REGISTRY:
        raise ValueError(f"unknown summary: {name}")
    return found


def load(name: str, size: float) -> Summary:
    return Summary(canonical(name), size)
