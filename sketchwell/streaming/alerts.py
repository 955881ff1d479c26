"""Alerts of a stream: when the share of large values in a sliding window of panes crosses a bound.

One stream closes panes by the watermark, as built-in aggregates that combine on the map side, and
appends their states, a few numbers for a pane and key, to a table. Spark lets no arbitrary state follow
an aggregation in one query, so a second stream reads that table in a stateful step. It keeps the last panes' states of a
key, merges them, and decides each window by its ends, then by moment bounds; where these leave it open
the panes' own counts decide, so a verdict is exact. A row is emitted where the verdict differs from
that of the window before (the first counts as not above). State and progress are in the stream's
checkpoint, so a stream that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import moments as M
from ..functions import solver as S
from ..operators.thresholds import MOMENT_SLACK

ORDER = 6
_SUMS = ["n", *[f"p{i}" for i in range(1, ORDER + 1)]]
_KEPT = ["mn", "mx", "over", *_SUMS]


def decide(panes: list[tuple], t: float, share: float) -> tuple[bool, str]:
    """Whether over a share of the panes' values exceed t, and what said so; panes are rows of _KEPT."""
    lo, hi = min(p[0] for p in panes), max(p[1] for p in panes)
    if t < lo or t >= hi:
        return t < lo and share < 1, "range"
    sums = tuple(float(sum(p[i] for p in panes)) for i in range(3, len(_KEPT)))
    low, high = S.above_bounds(S.State(lo, hi, sums), t)
    if low > share + MOMENT_SLACK or high < share - MOMENT_SLACK:
        return low > share, "moments"
    return sum(p[2] for p in panes) / sums[0] > share, "count"


def pane_rows(stream: DataFrame, ts: str, width: str, key: str, x: Column, t: float, late: str) -> DataFrame:
    """(key, pane, _KEPT) of every pane that the watermark has closed."""
    x = x.cast("double")
    rows = stream.withWatermark(ts, late).where(M.finite(x))
    over = F.sum((x > t).cast("long")).cast("double").alias("over")
    found = rows.groupBy(F.window(ts, width).alias("window"), key).agg(*M.building(x, ORDER), over)
    return found.select(F.col(key).alias("key"), F.col("window.start").alias("pane"), *[F.col(c).cast("double").alias(c) for c in _KEPT])


def crossings(rows: DataFrame, t: float, share: float, panes: int) -> DataFrame:
    """A stream of (key, pane, n, above, stage) where a key's window of its last panes with rows crosses the share, from one of pane_rows; append mode."""
    wide = panes - 1

    def follow(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, before = ([], False) if not state.exists else (list(state.get[0]), state.get[1])
        kept = [tuple(p) for p in kept]
        out = []
        for r in pd.concat(list(frames)).sort_values("pane").itertuples(index=False):  # panes that one trigger closes, of one key
            window = [*kept, tuple(getattr(r, c) for c in _KEPT)]
            above, stage = decide(window, t, share)
            if above != before:
                out.append((of[0], r.pane, int(sum(p[3] for p in window)), above, stage))
            kept, before = window[-wide:] if wide else [], above
        state.update(([list(p) for p in kept], before))
        yield pd.DataFrame(out, columns=["key", "pane", "n", "above", "stage"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("pane", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("above", T.BooleanType()), T.StructField("stage", T.StringType())])
    held = "panes array<array<double>>, before boolean"
    return rows.groupBy("key").applyInPandasWithState(follow, schema, held, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over the files that are there, append to Parquet at path, and end; a stream of what is written there is returned."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.readStream.schema(stream.schema).parquet(path)


def alert_once(stream: DataFrame, folder: str, ts: str, width: str, key: str, x: Column, t: float, share: float, panes: int, late: str = "10 minutes") -> DataFrame:
    """All alerts so far, (key, pane, n, above, stage), once the files that are there have been read; called again with the same folder it goes on."""
    closed = run_available(pane_rows(stream, ts, width, key, x, t, late), f"{folder}/panes", f"{folder}/panes-progress")
    alerts = crossings(closed, t, share, panes)
    run_available(alerts, f"{folder}/alerts", f"{folder}/alerts-progress")
    return stream.sparkSession.read.schema(alerts.schema).parquet(f"{folder}/alerts")


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files at path, a folder or one file, as like, a batch read of the same, has them after reading."""
    raw = spark.read.parquet(path).schema
    found = spark.readStream.schema(raw).parquet(f"{path[:-1]}[{path[-1]}]")  # only as a pattern may it be a file
    return found.select(*[F.col(c).cast(like.schema[c].dataType) for c in like.columns])
