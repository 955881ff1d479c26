"""Exact quantiles by selection in rounds; no task ever holds a group.

A rank of a group is looked for in an open interval of values, at first all. While an interval holds
more than FIT rows, a mergeable sketch of the rows in it gives two values that are likely to lie on
either side of the rank, and a pass counts the rows below, at, between and above them. If the rank
falls on one of the two it is found; else the part that holds it is the next interval, whichever part
it is, so a sketch that errs costs a round and never a wrong result. Intervals of few rows are finished
by running counts of their distinct values. Sketches and counts combine on the map side.

Null and NaN values do not count. A group without others has no row. Ties are one value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

#: Rows of an interval that one task may hold; the size of a round's sketch, and the steps of rank that it is asked for: over twice its error.
FIT, SKETCH, STEPS = 50_000, 2048, 256


def disc_rank(p: float) -> Callable[[Column], Column]:
    """The rank of the least value that a share p of all does not exceed."""
    return lambda n: F.greatest(F.lit(1), n - F.floor(n - F.lit(float(p)) * n)).cast("long")


def median_ranks() -> list[Callable[[Column], Column]]:
    """The two middle ranks, the same for an odd count."""
    return [lambda n: F.floor((n + 1) / 2).cast("long"), lambda n: (F.floor(n / 2) + 1).cast("long")]


def _same(keys: list[str], tag: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{tag}{k}")) for k in keys]


def _tagged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{tag}{k}" for k in keys})


def _join(rows: DataFrame, few: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows with few's row of their group; without keys few is one row. Spark decides by few's size whether to broadcast it, and splits a group's rows if not."""
    return rows.join(_tagged(few, keys, tag), _same(keys, tag)) if keys else rows.crossJoin(F.broadcast(few))


def _inside(rows: DataFrame, searched: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, _x, _s): each row once for every search (struct of fields) of its group whose interval it is in."""
    per_group = searched.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_all"))  # as many as ranks are asked for
    met = _join(rows, per_group, keys, "_g_")
    x = F.col("_x")
    within = lambda s: (s["lo"].isNull() | (x > s["lo"])) & (s["hi"].isNull() | (x < s["hi"]))
    return met.select(*keys, "_x", F.explode(F.filter("_all", within)).alias("_s"))


def _narrowed(rows: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """The searches after one round: (keys, i, rank, lo, hi, below, inside, q)."""
    sketch = F.call_function("kll_sketch_agg_double", F.col("_x"), F.lit(SKETCH)).alias("_sketch")
    sketched = _inside(rows, open_, keys, ["i", "lo", "hi"]).groupBy(*keys, F.col("_s.i").alias("i")).agg(sketch)
    joined = open_.join(_tagged(sketched.withColumnRenamed("i", "_i"), keys, "_k_"), [*_same(keys, "_k_"), F.col("i") == F.col("_i")])
    at = (F.col("rank") - F.col("below")) / F.col("inside")
    grid = F.call_function("kll_sketch_get_quantile_double", F.col("_sketch"), F.array(*[F.lit(j / STEPS) for j in range(STEPS + 1)]))
    step = lambda j: F.least(F.lit(STEPS), F.greatest(F.lit(0), j)).cast("int")
    named = joined.select(*keys, "i", "rank", "lo", "hi", "below", "inside", grid.alias("_grid"), step(F.floor(at * STEPS) - 1).alias("_a"), step(F.ceil(at * STEPS) + 1).alias("_b"))
    cut = checkpointed(named.select(*keys, "i", "rank", "lo", "hi", "below", "inside", F.col("_grid")[F.col("_a")].alias("a"), F.col("_grid")[F.col("_b")].alias("b")))
    x, s = F.col("_x"), lambda c: F.col(f"_s.{c}")
    count = lambda condition, name: F.sum(condition.cast("long")).alias(name)
    counted = _inside(rows, cut, keys, ["i", "lo", "hi", "a", "b"]).groupBy(*keys, F.col("_s.i").alias("i")).agg(count(x < s("a"), "_less"), count(x == s("a"), "_at_a"), count((x > s("a")) & (x < s("b")), "_mid"), count((x == s("b")) & (x > s("a")), "_at_b"), count(x > s("b"), "_more"))
    both = cut.join(_tagged(counted.withColumnRenamed("i", "_i"), keys, "_k_"), [*_same(keys, "_k_"), F.col("i") == F.col("_i")])
    rank = F.col("rank") - F.col("below")
    ends = [F.col("_less")]
    for c in ("_at_a", "_mid", "_at_b"):
        ends.append(ends[-1] + F.col(c))
    pick = lambda less, mid, more: F.when(rank <= ends[0], less).when(rank <= ends[2], mid).otherwise(more)
    found = F.when((rank > ends[0]) & (rank <= ends[1]), F.col("a")).when((rank > ends[2]) & (rank <= ends[3]), F.col("b"))
    return both.select(*keys, "i", "rank", pick(F.col("lo"), F.col("a"), F.col("b")).alias("lo"), pick(F.col("a"), F.col("b"), F.col("hi")).alias("hi"), (F.col("below") + pick(F.lit(0), ends[1], ends[3])).alias("below"), pick(F.col("_less"), F.col("_mid"), F.col("_more")).alias("inside"), found.alias("q"))


def _finished(rows: DataFrame, searched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, q) of searches whose intervals are small: running counts of their distinct values."""
    each = _inside(rows, searched, keys, ["i", "lo", "hi", "rank", "below"])
    counts = each.groupBy(*keys, F.col("_s.i").alias("i"), (F.col("_s.rank") - F.col("_s.below")).alias("_rank"), "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "i").orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow))
    return counts.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank")).groupBy(*keys, "i").agg(F.min("_x").alias("q"))


def select_ranks(df: DataFrame, keys: list[str], x: str, ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, q_0, q_1, ...): of every group the values of the given ranks, which are functions of its count n."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    counts = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0"))
    none = F.lit(None).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r(F.col("n")).alias("rank")) for i, r in enumerate(ranks)]))
    searched = counts.select(*keys, "n", each.alias("_e")).select(*keys, F.col("_e.i").alias("i"), F.col("_e.rank").alias("rank"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("q"))
    done, open_ = [searched.where(F.col("inside") <= FIT)], checkpointed(searched.where(F.col("inside") > FIT))
    while open_.limit(1).count():
        narrowed = checkpointed(_narrowed(rows, open_, keys))
        still = (F.col("inside") > FIT) & F.col("q").isNull()
        done.append(narrowed.where(~still))
        open_ = checkpointed(narrowed.where(still))
    ended = reduce(lambda a, b: a.unionByName(b), done)
    found = ended.where("q IS NOT NULL").select(*keys, "i", "q").unionByName(_finished(rows, ended.where("q IS NULL"), keys))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q_{i}") for i in range(len(ranks))])
    if not keys:
        return counts.crossJoin(F.broadcast(wide)).select("n", *[f"q_{i}" for i in range(len(ranks))])
    return counts.join(_tagged(wide, keys, "_k_"), _same(keys, "_k_")).select(*keys, "n", *[f"q_{i}" for i in range(len(ranks))])


def quantiles(df: DataFrame, keys: list[str], x: str, ps) -> DataFrame:
    """Exact quantiles of type R-1, (keys, q_<i> ...)."""
    return select_ranks(df, keys, x, [disc_rank(p) for p in ps]).drop("n")


def median(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, median): the middle value, or the mean of the two."""
    return select_ranks(df, keys, x, median_ranks()).select(*keys, ((F.col("q_0") + F.col("q_1")) / 2).alias("median"))
