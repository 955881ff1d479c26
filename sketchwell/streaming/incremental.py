"""Moment states of a stream: tumbling panes under a watermark, and running group states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moments as M


def pane_states(stream: DataFrame, ts: str, width: str, keys: list[str], x: Column, order: int = 10, late: str = "10 minutes", logs: bool = False) -> DataFrame:
    """A state per pane and keys; in append mode each is final once the watermark has passed it."""
    rows = stream.withWatermark(ts, late).where(M.finite(x.cast("double")))
    found = rows.groupBy(F.window(ts, width).alias("window"), *keys).agg(*M.building(x, order, logs))
    return found.withColumn("pane", F.col("window.start")).drop("window")


def running_states(stream: DataFrame, keys: list[str], x: Column, order: int = 10, logs: bool = False) -> DataFrame:
    """A state per keys over all rows so far, for the update or complete mode."""
    return stream.where(M.finite(x.cast("double"))).groupBy(*keys).agg(*M.building(x, order, logs))
