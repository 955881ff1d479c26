"""Benchmark runs over the given tables: files in and out, result rows and their reports, generated metrics of a table's rows.

They are registered beside the catalog's. Metrics are whole numbers of cents, so that sums are exact.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions.lineage import checkpointed, new_folder, remove
from ..operators import evaluation as E
from ..operators import quantiles as Q
from ..operators import states as A
from ..sources import readers, synthetic
from ..sources.readers import table
from .catalog import _MERGE_SQL, _PS, CENTS_SQL, _events, _lineitem, _state_sql, query


def _through_files(spark: SparkSession, name: str, make) -> DataFrame:
    """make(folder), a small result of files that it writes below folder; the files are removed, the result stays."""
    folder = new_folder(spark, name)
    found = checkpointed(make(folder))
    remove(spark, folder)
    return found


@query(f"SELECT header, {_state_sql('l_quantity', 4)} FROM lineitem, (VALUES (false), (true)) AS h(header) GROUP BY header")
def csv_column_state(spark, sf):
    """The state of one column of CSV files, which a JSON configuration names by place, with and without a header; the fields before it are quoted."""
    lines = _lineitem(spark, sf).select("l_orderkey", F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("flags"), "l_quantity")

    def make(folder):
        found = []
        for header in (False, True):
            config = readers.RunConfig.parse(json.dumps({"path": f"{folder}/{header}", "column": 2, "header": header, "order": 4}))
            lines.write.option("header", header).csv(config.get("path"))
            column = readers.csv_column(spark, config.get("path"), config.get("column"), config.get("header", True))
            found.append(A.build(column, [], "x", config.get("order")).select(F.lit(header).alias("header"), "*"))
        return reduce(DataFrame.unionByName, found)

    return _through_files(spark, "csv", make)


@query(f"SELECT count(*) AS cells, {_MERGE_SQL(3)} FROM (SELECT {_state_sql('x', 3)} FROM (SELECT user_id, event_type, {CENTS_SQL} AS x FROM events) GROUP BY user_id, event_type)")
def grouped_csv_state(spark, sf):
    """States of cells that stand in files as a list of numbers a line, merged."""
    lists = E.collected(_events(spark, sf), ["user_id", "event_type"], "cents")

    def make(folder):
        lists.select(F.concat(F.lit('"'), F.to_json("data"), F.lit('"')).alias("line")).write.text(folder)
        read = readers.grouped_csv(spark, folder, header=False).withColumn("cell_id", F.monotonically_increasing_id())
        states = A.build_arrays(checkpointed(read), ["cell_id"], "data", 3)
        return states.agg(F.count(F.lit(1)).alias("cells"), *M.merging(states.columns))

    return _through_files(spark, "grouped", make)


#: Ranks that the runs ask for, with the normal distribution's values there (fixed values).
_RANKS = {0.1: -1.2815515655446004, 0.5: 0.0, 0.9: 1.2815515655446004}

_RUNS_SQL = f"""WITH e AS (SELECT event_type, event_id % 3 AS trial, {CENTS_SQL} AS x, event_id // 200 AS cell, epoch_us(ts) AS us FROM events WHERE isfinite(value)),
s AS (SELECT event_type, trial, count(*) AS n, sum(x) / count(*) AS mean, sqrt(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*))) AS sd, min(x) AS mn, max(x) AS mx FROM e GROUP BY ALL),
m AS (SELECT *, CASE sketch WHEN 'gaussian' THEN mean + z * sd ELSE mn + q * (mx - mn) END AS est FROM s, (VALUES ('gaussian'), ('uniform')) AS k(sketch), (SELECT q::DOUBLE AS q, z::DOUBLE AS z FROM (VALUES {', '.join(str(r) for r in _RANKS.items())}) AS v(q, z))),
r AS (SELECT event_type, trial::INT AS trial, sketch, q, max(n) AS n, greatest(0, floor(q * max(n)) - count(*) FILTER (x <= est), count(*) FILTER (x < est) - floor(q * max(n))) / max(n) AS rank_error FROM e JOIN m USING (event_type, trial) GROUP BY event_type, trial, sketch, q)"""


def _runs(spark, sf) -> DataFrame:
    """(event_type, trial, sketch, q, n, rank_error): two estimates from mean, spread and ends, run on three parts of each type's events.

    Each sketch's rows are written to a result file of their own, and both are read again.
    """
    events = _events(spark, sf).where(M.finite(F.col("value"))).select("event_type", (F.col("event_id") % 3).cast("int").alias("trial"), "cents")
    keys = ["event_type", "trial"]
    states = A.build(events, keys, F.col("cents"), 2)
    mean = F.col("p1") / F.col("n")
    spread = F.sqrt(F.col("p2") / F.col("n") - mean * mean)
    qs = {
        "gaussian": [mean + z * spread for z in _RANKS.values()],
        "uniform": [F.col("mn") + q * (F.col("mx") - F.col("mn")) for q in _RANKS],
    }

    def make(folder):
        paths = []
        for sketch, estimates in qs.items():
            solved = Q.exploded(states.withColumn("qs", F.array(*estimates)), keys, tuple(_RANKS))
            errors = Q.rank_errors(events, keys, "cents", solved, tuple(_RANKS))
            rows = errors.select("event_type", "trial", F.lit(sketch).alias("sketch"), F.col("p").alias("q"), "n", "rank_error")
            paths.append(readers.write_results(rows, f"{folder}/{sketch}"))
        return readers.results(spark, paths).withColumn("n", F.col("n").cast("long"))

    return _through_files(spark, "results", make)


@query(f"{_RUNS_SQL} SELECT event_type, trial, sketch, q, n, round(rank_error, 9) AS rank_error FROM r")
def run_results(spark, sf):
    return _runs(spark, sf).withColumn("rank_error", F.round("rank_error", 9))


@query(f"{_RUNS_SQL} SELECT event_type, sketch, q, round(avg(rank_error), 9) AS rank_error FROM r WHERE trial > 0 GROUP BY ALL")
def run_trial_means(spark, sf):
    return E.mean_by(_runs(spark, sf), ["event_type", "sketch", "q"], ["rank_error"]).withColumn("rank_error", F.round("rank_error", 9))


@query(f"{_RUNS_SQL} SELECT sketch, trial, round(max(rank_error), 9) AS worst FROM r GROUP BY ALL")
def run_trial_worst(spark, sf):
    return _runs(spark, sf).groupBy("sketch", "trial").agg(F.round(F.max("rank_error"), 9).alias("worst"))


@query(f"{_RUNS_SQL} SELECT sketch, round(avg(m), 9) AS rank_error FROM (SELECT sketch, trial, avg(rank_error) AS m FROM r GROUP BY ALL) GROUP BY ALL")
def run_two_level_mean(spark, sf):
    return E.mean_over_then(_runs(spark, sf), ["sketch"], ["trial"], "rank_error").withColumn("rank_error", F.round("rank_error", 9))


@query(f"""{_RUNS_SQL}, c AS (SELECT event_type, trial::INT AS trial, count(DISTINCT cell) AS cells, max(us) - min(us) AS merge_time, (SELECT max(us) FROM e) - max(us) AS query_time FROM e GROUP BY ALL)
SELECT event_type, trial, sketch, q, round(rank_error / least(q, 1 - q), 9) AS relative_error, round(n * 1e6 / merge_time, 9) AS throughput, (merge_time + query_time)::DOUBLE AS end_to_end, round(merge_time / cells, 6) AS per_merge FROM r JOIN c USING (event_type, trial)""")
def run_derived(spark, sf):
    """Result rows with a report's derived columns; a run's times are those its events span, and from their last one to the table's."""
    events = A.cells(table(spark, sf, "events").where(M.finite(F.col("value"))), "event_id", 200)
    us = F.unix_micros("ts")
    last = events.agg(F.max(us).alias("_last"))
    spans = events.groupBy(F.col("event_type").alias("_type"), (F.col("event_id") % 3).alias("_trial")).agg(F.count_distinct("cell_id").alias("cells"), (F.max(us) - F.min(us)).alias("merge_time"), F.max(us).alias("_end"))
    times = spans.crossJoin(F.broadcast(last)).withColumn("query_time", F.col("_last") - F.col("_end"))
    found = E.derived(_runs(spark, sf).join(times, (F.col("event_type") == F.col("_type")) & (F.col("trial") == F.col("_trial"))))
    return found.select("event_type", "trial", "sketch", "q", F.round("relative_error", 9).alias("relative_error"), F.round("throughput", 9).alias("throughput"), "end_to_end", F.round("per_merge", 6).alias("per_merge"))


@query("""WITH e AS (SELECT event_type, user_id % 4 AS part, ts FROM events), t AS (SELECT event_type AS sketch, threads, count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))) AS throughput FROM e, (SELECT unnest([1, 2, 4])::INT AS threads) WHERE part < threads GROUP BY ALL)
SELECT sketch, t.threads, round(t.throughput, 9) AS throughput, round(o.throughput * t.threads, 9) AS ideal FROM t JOIN (SELECT sketch, throughput FROM t WHERE threads = 1) o USING (sketch)""")
def run_ideal_scaling(spark, sf):
    """The rate of one, two and four quarters of the users' events, beside one quarter's times as much."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("sketch"), F.pmod("user_id", F.lit(4)).alias("part"), F.unix_micros("ts").alias("us"))
    shares = events.withColumn("threads", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("part < threads")
    rates = shares.groupBy("sketch", "threads").agg((F.count(F.lit(1)) * 1e6 / (F.max("us") - F.min("us"))).alias("throughput"))
    return E.ideal_scaling(rates).select("sketch", "threads", F.round("throughput", 9).alias("throughput"), F.round("ideal", 9).alias("ideal"))


_SHARES = (1, 2, 4, 8)


@query(f"""WITH c AS (SELECT event_id // 200 AS cell_id, {_state_sql(CENTS_SQL, 3)} FROM events WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT shares, cell_id % shares AS share, count(*) AS cells, {_MERGE_SQL(3)} FROM c, (SELECT unnest({list(_SHARES)})::INT AS shares) GROUP BY ALL)
SELECT shares, max(cells) AS largest, {_MERGE_SQL(3)} FROM p GROUP BY shares""")
def scaling_merge(spark, sf):
    """Cells merged in one, two, four and eight shares and then once: the same state each time, and the cells of the largest share."""
    cells = A.build(A.cells(_events(spark, sf), "event_id", 200), ["cell_id"], F.col("cents"), 3)
    dealt = cells.withColumn("shares", F.explode(F.array(*[F.lit(k) for k in _SHARES]))).withColumn("share", F.col("cell_id") % F.col("shares"))
    parts = dealt.groupBy("shares", "share").agg(F.count(F.lit(1)).alias("cells"), *M.merging(cells.columns))
    return parts.groupBy("shares").agg(F.max("cells").alias("largest"), *M.merging(cells.columns))


@query("SELECT event_id, (event_id % 30) / 29.0 AS few, 2 + event_id * 3.0 / (SELECT greatest(1, max(event_id)) FROM events) AS even FROM events")
def row_numbers_source(spark, sf):
    """A value of 30 and a value evenly spaced from 2 to 5, both ends included, for every event by its dense id."""
    events = table(spark, sf, "events").select("event_id")
    last = events.agg(F.greatest(F.lit(1), F.max("event_id")).alias("_last"))
    even = F.lit(2) + F.col("event_id") * 3.0 / F.col("_last")
    return events.crossJoin(F.broadcast(last)).select("event_id", synthetic.discrete_number(F.col("event_id"), 30).alias("few"), even.alias("even"))


#: A point of each distribution and its share at or below it (fixed values).
_SHARE_BELOW = {"gaussian": (1.0, 0.8413447), "pareto": (1.0, 1 - 2**-0.1), "gamma": (0.1, 0.8275518), "exponential": (1.0, 0.6321206)}


@query(f"SELECT event_type, source, count(*) AS n, true AS ok FROM events, (SELECT unnest({list(_SHARE_BELOW)}) AS source) GROUP BY ALL")
def row_sources_ok(spark, sf):
    """Whether numbers generated for every event have their distribution's share below a point, within four standard errors of each type's count."""
    row = F.col("event_id")
    numbers = {"gaussian": synthetic.normal_number(row, 1), "pareto": synthetic.pareto_number(row, 0.1, 2), "gamma": synthetic.gamma_number(row, 0.1, 3), "exponential": synthetic.exponential_number(row, 1.0, 4)}
    each = [F.struct(F.lit(k).alias("source"), (numbers[k] <= at).cast("double").alias("below"), F.lit(share).alias("share")) for k, (at, share) in _SHARE_BELOW.items()]
    rows = table(spark, sf, "events").select("event_type", F.explode(F.array(*each)).alias("x")).select("event_type", "x.*")
    counts = rows.groupBy("event_type", "source", "share").agg(F.count(F.lit(1)).alias("n"), F.avg("below").alias("seen"))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n"))
    return counts.select("event_type", "source", "n", (F.abs(F.col("seen") - F.col("share")) <= 4 * error).alias("ok"))


_CARDINALITIES = (6, 10, 30, 100, 300, 1000)


@query(f"SELECT c::INT AS cardinality, count(*) AS n, true AS ok FROM lineitem, (SELECT unnest({list(_CARDINALITIES)}) AS c) GROUP BY c")
def discrete_rows_ok(spark, sf):
    """Maximum entropy on part keys folded to few values: rank errors of the order of a value's share; all cardinalities in one pass."""
    rows = _lineitem(spark, sf).select("l_partkey", F.explode(F.array(*[F.lit(c) for c in _CARDINALITIES])).alias("cardinality"))
    df = rows.select("cardinality", (F.pmod("l_partkey", "cardinality") / (F.col("cardinality") - 1)).alias("x"))
    solved = Q.exploded(Q.quantiles(A.build(df, ["cardinality"], F.col("x"), 10), _PS), ["cardinality"], _PS)
    errors = Q.rank_errors(df, ["cardinality"], "x", solved, _PS)
    return errors.groupBy("cardinality").agg(F.max("n").alias("n"), F.bool_and(F.col("rank_error") <= F.greatest(F.lit(0.04), 1 / F.col("cardinality"))).alias("ok"))


@query(f"""WITH s AS (SELECT user_id, event_type, count(*) FILTER (value > 0) AS k FROM events WHERE isfinite(value) GROUP BY ALL)
SELECT event_type, count(*) AS states, sum(CASE WHEN k > 0 THEN {M.state_bytes(6, True)} ELSE {M.state_bytes(6, False)} END)::BIGINT AS bytes FROM s GROUP BY 1""")
def stored_state_bytes(spark, sf):
    """Bytes of each type's stored states, one a user; states without a positive value hold no sums of logarithms."""
    states = A.build(table(spark, sf, "events"), ["user_id", "event_type"], F.col("value"), 6, logs=True)
    size = F.when(F.col("ln_n") > 0, M.state_bytes(6, True)).otherwise(M.state_bytes(6, False))
    return states.groupBy("event_type").agg(F.count(F.lit(1)).alias("states"), F.sum(size).alias("bytes"))
