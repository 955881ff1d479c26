"""A table of states by pane and dimensions that is refreshed as rows arrive, and queried by partition.

The table is Parquet, partitioned by `day`, with one row per pane and dimensions. States merge, so rows
that come late are built into states of their own, and only the days that they touch are read, merged
and written again; all other partitions' files stay. A query names days, which prune partitions, and
rolls the panes up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from . import states as A


def paned(df: DataFrame, ts: str, width: str, dims: list[str], x: Column, order: int, logs: bool = False) -> DataFrame:
    """States of df's rows with day, the partition of a pane."""
    return A.panes(df, ts, width, dims, x, order, logs).withColumn("day", F.to_date("pane"))


def _write(states: DataFrame, path: str, mode: str) -> None:
    dealt = states.repartition("day")  # a file a day; many panes and dimensions of a day are split by Spark's file size limit
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def create(states: DataFrame, path: str) -> None:
    """Write the first states (of paned); the path must be new."""
    _write(states, path, "errorifexists")


def refresh(spark: SparkSession, path: str, fresh: DataFrame, dims: list[str]) -> list:
    """Merge fresh states (of paned) into the table at path; the days that were written again are returned.

    The number of days with fresh rows is what goes to the driver. What is read is cut from its files
    before they are replaced; a partition is replaced as a whole when all tasks have written.
    """
    fresh = checkpointed(fresh)
    days = sorted(r["day"] for r in fresh.select("day").distinct().collect())
    if not days:
        return []
    kept = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").isin(days))
    merged = A.merge(kept.unionByName(fresh), ["day", "pane", *dims])
    _write(checkpointed(merged), path, "overwrite")
    return days


def rolled_up(spark: SparkSession, path: str, first, last, dims: list[str]) -> DataFrame:
    """States by dims of all panes of the days from first to last, each as a date or its text; only their partitions are read."""
    day = F.col("day")
    found = spark.read.parquet(path).where((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")))
    return A.merge(found, dims)
