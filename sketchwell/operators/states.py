"""Build, merge, roll up and slide moment states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import moments as M


def build(df: DataFrame, keys: list[str], x: Column | str, order: int = 10, logs: bool = False) -> DataFrame:
    """One state a group of keys over the finite values of x; groups without one do not appear."""
    x = F.col(x) if isinstance(x, str) else x
    rows = df.select(*keys, x.cast("double").alias("_x")).where(M.finite(F.col("_x")))
    return rows.groupBy(*keys).agg(*M.building(F.col("_x"), order, logs))


def build_arrays(df: DataFrame, keys: list[str], values: str, order: int = 10, logs: bool = False) -> DataFrame:
    """One state a group from rows that hold arrays of values."""
    return build(df.select(*keys, F.explode(values).alias("_v")), keys, F.col("_v"), order, logs)


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(*M.merging(states.columns))


def cube(states: DataFrame, dims: list[str]) -> DataFrame:
    """Merged states of every subset of dims, with `level`, the bits of the dims rolled up."""
    return states.cube(*dims).agg(F.grouping_id().alias("level"), *M.merging(states.columns))


def rollup(states: DataFrame, dims: list[str]) -> DataFrame:
    return states.rollup(*dims).agg(F.grouping_id().alias("level"), *M.merging(states.columns))


def cells(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """df with cell_id: chunks of `size` rows of a dense id, the last one short."""
    return df.withColumn("cell_id", F.floor(F.col(row_id) / size).cast("long"))


def first_cells(df: DataFrame, share: float) -> DataFrame:
    """The cells of the first share of all cells."""
    n = df.agg((F.max("cell_id") + 1).alias("_cells"))
    return df.join(F.broadcast(n), F.col("cell_id") < F.floor(F.lit(share) * F.col("_cells"))).drop("_cells")


def panes(df: DataFrame, ts: str, width: str, keys: list[str], x: Column, order: int, logs: bool = False) -> DataFrame:
    """A state per tumbling pane and keys, with pane, the pane's start."""
    timed = df.withColumn("pane", F.window(ts, width)["start"])
    return build(timed, ["pane", *keys], x, order, logs)


def slide(paned: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each pane's state merged with those of the n - 1 panes before it (panes without rows do not count)."""
    frame = W.partitionBy(*keys).orderBy("pane").rowsBetween(-(n - 1), 0)
    out = []
    for c in M.state_columns(paned.columns):
        how = F.min if c in ("mn", "ln_mn") else F.max if c in ("mx", "ln_mx") else F.sum
        out.append(how(c).over(frame).alias(c))
    return paned.select("pane", *keys, *out)


def reduced_precision(states: DataFrame, bits: int = 24) -> DataFrame:
    """States whose sums keep so many significant bits."""
    sums = [c for c in states.columns if c[0] in "pl" and c[1:].isdigit()]

    def cut(c):
        step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) + 1 - bits)
        return F.when(c == 0, c).otherwise(F.rint(c / step) * step)

    return states.withColumns({c: cut(F.col(c).cast("double")) for c in sums})
