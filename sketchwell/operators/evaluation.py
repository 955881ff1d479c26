"""Relational work around summaries: filters, cells, curves, and reports over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import moments as M
from .summaries import running


def finite_rows(df: DataFrame, x: str, dims: list[str]) -> DataFrame:
    return df.where(M.finite(F.col(x).cast("double"))).dropna(subset=dims)


def collected(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, data): values of a cell, sorted. For cells of bounded size; states need no lists."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("data"))


def cell_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """(x, n, share): the share of values at or below each distinct value."""
    counts = df.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return running(counts, "x", ["n"]).crossJoin(F.broadcast(total)).select("x", "n", (F.col("upto_n") / F.col("_all")).alias("share"))


def every(df: DataFrame, row_id: str, step: int) -> DataFrame:
    """Rows 0, step, 2 step, .. of a dense id, and the last one: a sample by design."""
    last = df.agg(F.max(row_id).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where((F.col(row_id) % step == 0) | (F.col(row_id) == F.col("_last"))).drop("_last")


def mean_by(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of values over trials; trial 0 warms up and does not count."""
    return results.where(F.col("trial") > 0).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def mean_over_then(results: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """The mean over outer groups of inner groups' means."""
    return results.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias(value))


def derived(results: DataFrame) -> DataFrame:
    """relative_error, throughput (values a millisecond of merging), end_to_end and per_merge."""
    return results.withColumns({
        "relative_error": F.col("rank_error") / F.least("q", 1 - F.col("q")),
        "throughput": F.col("n") * 1e6 / F.col("merge_time"),
        "end_to_end": (F.col("merge_time") + F.col("query_time")).cast("double"),
        "per_merge": F.col("merge_time") / F.col("cells"),
    })


def ideal_scaling(results: DataFrame) -> DataFrame:
    """results with ideal: the single-thread throughput of each sketch times the threads."""
    one = results.where("threads = 1").groupBy("sketch").agg(F.avg("throughput").alias("_one"))
    return results.join(F.broadcast(one), "sketch").withColumn("ideal", F.col("_one") * F.col("threads")).drop("_one")
