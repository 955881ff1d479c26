"""The registered queries and their SQL.

Names that end in _ok give a group's count and whether an estimate met its bound: their SQL states
the count and the expected verdict, it does not repeat the estimate. Metrics are whole numbers
(quantities, cents), so that power sums are exact and the same in any order.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions.lineage import checkpointed, new_folder, remove
from ..operators import evaluation as E
from ..operators import quantiles as Q
from ..operators import selection as L
from ..operators import states as A
from ..operators import store as R
from ..operators import summaries as Y
from ..operators import thresholds as H
from ..sources import synthetic
from ..sources.readers import table
from ..streaming import alerts as N

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


CENTS_SQL = "round(value * 100)"
QTY = "l_quantity"


def _power_sql(x: str, i: int) -> str:
    return "sum(" + "*".join([f"({x})"] * i) + ")"


def _state_sql(x: str, order: int) -> str:
    return ", ".join([f"count({x}) AS n", f"min({x}) AS mn", f"max({x}) AS mx", *[f"{_power_sql(x, i)} AS p{i}" for i in range(1, order + 1)]])


_MERGE_SQL = lambda order: ", ".join(["sum(n)::BIGINT AS n", "min(mn) AS mn", "max(mx) AS mx", *[f"sum(p{i}) AS p{i}" for i in range(1, order + 1)]])


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100))


@query(f"SELECT l_returnflag, {_state_sql('l_quantity', 5)} FROM lineitem GROUP BY l_returnflag")
def moment_state_by_flag(spark, sf):
    return A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5)


@query(f"SELECT event_type, {_state_sql(CENTS_SQL, 3)}, count(*) FILTER ({CENTS_SQL} > 0) AS ln_n, round(sum(ln({CENTS_SQL})) FILTER ({CENTS_SQL} > 0) / count(*), 6) AS l1_mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def log_moment_state_by_event(spark, sf):
    found = A.build(_events(spark, sf), ["event_type"], F.col("cents"), 3, logs=True)
    return found.select("event_type", "n", "mn", "mx", "p1", "p2", "p3", "ln_n", F.round(F.col("l1") / F.col("n"), 6).alias("l1_mean"))


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS ln_n, min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer GROUP BY c_mktsegment""")
def signed_log_state(spark, sf):
    return A.build(table(spark, sf, "customer"), ["c_mktsegment"], F.col("c_acctbal"), 2, logs=True).select("c_mktsegment", "n", "ln_n", "mn", "mx")


_CELLS_SQL = f"SELECT event_id // 200 AS cell_id, {_state_sql(CENTS_SQL, 3)} FROM events WHERE value IS NOT NULL GROUP BY event_id // 200"


@query(f"SELECT count(*) AS cells, {_MERGE_SQL(3)} FROM ({_CELLS_SQL})")
def cell_state_merge(spark, sf):
    cells = A.build(A.cells(_events(spark, sf), "event_id", 200), ["cell_id"], F.col("cents"), 3)
    return cells.agg(F.count(F.lit(1)).alias("cells"), *M.merging(cells.columns))


@query(f"SELECT {_MERGE_SQL(3)} FROM ({_CELLS_SQL}) WHERE cell_id < (SELECT floor(0.1 * (max(event_id // 200) + 1)) FROM events)")
def cell_fraction_merge(spark, sf):
    rows = A.first_cells(A.cells(_events(spark, sf), "event_id", 200), 0.1)
    return A.merge(A.build(rows, ["cell_id"], F.col("cents"), 3), [])


@query(f"""WITH x AS (SELECT event_type, event_id // 200 AS cell, round(value * 100) AS c FROM events WHERE isfinite(value))
SELECT event_type, count(*) FILTER (c > 0) AS ln_n, round(min(ln(c)) FILTER (c > 0), 6) AS ln_mn, round(max(ln(c)) FILTER (c > 0), 6) AS ln_mx, round(sum(ln(c)) FILTER (c > 0) / count(*), 6) AS l1_mean, round(sum(ln(c) * ln(c)) FILTER (c > 0) / count(*), 6) AS l2_mean FROM x GROUP BY event_type""")
def log_state_merge(spark, sf):
    """Sums of logarithms of cells, merged."""
    cells = A.build(A.cells(_events(spark, sf), "event_id", 200), ["event_type", "cell_id"], F.col("cents"), 2, logs=True)
    mean = lambda c: F.round(F.col(c) / F.col("n"), 6).alias(f"{c}_mean")
    return A.merge(cells, ["event_type"]).select("event_type", "ln_n", F.round("ln_mn", 6).alias("ln_mn"), F.round("ln_mx", 6).alias("ln_mx"), mean("l1"), mean("l2"))


_FLAGS = ["l_returnflag", "l_linestatus"]


@query(f"SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, {_state_sql('l_quantity', 4)} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_state(spark, sf):
    return A.cube(A.build(_lineitem(spark, sf), _FLAGS, QTY, 4), _FLAGS)


@query(f"SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, {_state_sql('l_quantity', 4)} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_state(spark, sf):
    return A.rollup(A.build(_lineitem(spark, sf), _FLAGS, QTY, 4), _FLAGS)


_PANES_SQL = f"SELECT time_bucket(INTERVAL '1 hour', ts) AS pane, event_type, {_state_sql(CENTS_SQL, 3)} FROM events WHERE value IS NOT NULL GROUP BY ALL"


@query(f"SELECT epoch_us(pane) AS pane, event_type, n, mn, mx, p1, p2, p3 FROM ({_PANES_SQL})")
def tumbling_state(spark, sf):
    return A.panes(_events(spark, sf), "ts", "1 hour", ["event_type"], F.col("cents"), 3).withColumn("pane", F.unix_micros("pane"))


_FRAME = "OVER (PARTITION BY event_type ORDER BY pane ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(f"SELECT epoch_us(pane) AS pane, event_type, CAST(sum(n) {_FRAME} AS BIGINT) AS n, min(mn) {_FRAME} AS mn, max(mx) {_FRAME} AS mx, sum(p1) {_FRAME} AS p1, sum(p2) {_FRAME} AS p2, sum(p3) {_FRAME} AS p3 FROM ({_PANES_SQL})")
def sliding_state(spark, sf):
    paned = A.panes(_events(spark, sf), "ts", "1 hour", ["event_type"], F.col("cents"), 3)
    return A.slide(paned, ["event_type"], 6).withColumn("pane", F.unix_micros("pane"))


def _shift_sql(m: int, center: str, half: str) -> str:
    sums = ["n", *[f"p{i}" for i in range(1, 9)]]
    terms = " + ".join(f"{comb(m, j)} * " + ("*".join([f"(-({center}))"] * (m - j)) + " * " if m - j else "") + sums[j] for j in range(m + 1))
    return f"({terms}) / n" + (" / (" + "*".join([f"({half})"] * m) + ")" if m and half else "")


_C, _R = "(mx + mn) / 2", "(mx - mn) / 2"
_STATE5 = f"(SELECT l_returnflag, {_state_sql('l_quantity', 5)} FROM lineitem GROUP BY l_returnflag)"


@query("SELECT l_returnflag, " + ", ".join(f"round({_shift_sql(m, _C, _R)}, 6) AS m{m}" for m in range(6)) + f" FROM {_STATE5}")
def scaled_moments(spark, sf):
    found = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5)
    return found.select("l_returnflag", *[F.round(c, 6).alias(f"m{i}") for i, c in enumerate(M.scaled_moments(5))])


@query("SELECT l_returnflag, " + ", ".join("round(" + " + ".join(f"{c} * ({_shift_sql(j, _C, _R)})" for j, c in enumerate(row) if c) + f", 6) AS t{i}" for i, row in enumerate(M.chebyshev_coefficients(5))) + f" FROM {_STATE5}")
def cheby_moments(spark, sf):
    found = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5)
    return found.select("l_returnflag", *[F.round(c, 6).alias(f"t{i}") for i, c in enumerate(M.chebyshev_moments(5))])


def _inversion_sql(p: float, order: int) -> str:
    u = [_shift_sql(m, "mn", "mx - mn") for m in range(order + 1)]
    mass = ["(" + " + ".join(f"{(-1) ** (j - k) * comb(order, j) * comb(j, k)} * ({u[j]})" for j in range(k, order + 1)) + ")" for k in range(order + 1)]
    cases = " ".join(f"WHEN {' + '.join(mass[: k + 1])} >= {p} THEN {k}" for k in range(order + 1))
    return f"round((CASE {cases} ELSE {order} END) / {float(order)} * (mx - mn) + mn, 6)"


@query("SELECT l_returnflag, " + ", ".join(f"{_inversion_sql(p, 5)} AS q{round(100 * p)}" for p in (0.12, 0.48, 0.87)) + f" FROM {_STATE5}")
def mnat_quantiles(spark, sf):
    found = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5)
    return found.select("l_returnflag", *[F.round(M.inversion_quantile(p, 5), 6).alias(f"q{round(100 * p)}") for p in (0.12, 0.48, 0.87)])


def _markov_sql(t: float, order: int) -> str:
    upper = [f"(({_shift_sql(i, 'mn', '')}) / (" + "*".join([f"({t} - mn)"] * i) + "))" for i in range(1, order + 1)]
    lower = [f"(1 - {(-1) ** i} * ({_shift_sql(i, 'mx', '')}) / (" + "*".join([f"(mx - {t})"] * i) + "))" for i in range(1, order + 1)]
    return f"round(greatest(0.0, {', '.join(lower)}), 6) AS lo, round(least(1.0, {', '.join(upper)}), 6) AS hi"


@query(f"SELECT l_returnflag, {_markov_sql(40.0, 5)} FROM {_STATE5}")
def markov_bounds(spark, sf):
    lo, hi = M.markov_bounds(F.lit(40.0), 5)
    return A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5).select("l_returnflag", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN 300000 < min(o_totalprice) THEN true WHEN 300000 >= max(o_totalprice) THEN false END AS above FROM orders GROUP BY o_custkey")
def range_threshold(spark, sf):
    found = A.build(table(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice"), 1)
    return found.select("o_custkey", "n", H.by_range(F.lit(300000.0), F.lit(0.5)).alias("above"))


@query("SELECT l_returnflag, floor((53 * log10(2) - 2.58) / (log10(6) + log10(abs((max(l_quantity) + min(l_quantity)) / (max(l_quantity) - min(l_quantity))) + 1)))::BIGINT AS k FROM lineitem GROUP BY l_returnflag")
def order_guard(spark, sf):
    found = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 1)
    return found.select("l_returnflag", M.usable_order((F.col("mx") + F.col("mn")) / (F.col("mx") - F.col("mn"))).alias("k"))


@query("SELECT o_orderstatus, quantile_disc(o_totalprice, 0.01) AS q_0, quantile_disc(o_totalprice, 0.5) AS q_1, quantile_disc(o_totalprice, 0.99) AS q_2 FROM orders GROUP BY o_orderstatus")
def exact_quantiles(spark, sf):
    return L.quantiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", (0.01, 0.5, 0.99))


@query("SELECT o_orderstatus, round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderstatus")
def median_select(spark, sf):
    return L.median(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", F.round("median", 4).alias("median"))


@query("SELECT count(l_extendedprice) AS n, quantile_disc(l_extendedprice, 0.001) AS q_0, quantile_disc(l_extendedprice, 0.25) AS q_1, quantile_disc(l_extendedprice, 0.75) AS q_2, quantile_disc(l_extendedprice, 0.999) AS q_3 FROM lineitem")
def selected_quantiles(spark, sf):
    """Exact quantiles of one group that no task holds, by rounds of brackets."""
    return L.select_ranks(_lineitem(spark, sf), [], "l_extendedprice", [L.disc_rank(p) for p in (0.001, 0.25, 0.75, 0.999)])


_STORE_DAYS = "2024-01-05", "2024-01-20"


@query(f"SELECT event_type, {_state_sql(CENTS_SQL, 3)} FROM events WHERE isfinite(value) AND ts::DATE BETWEEN '{_STORE_DAYS[0]}' AND '{_STORE_DAYS[1]}' GROUP BY event_type")
def store_refresh(spark, sf):
    """States of half of all rows stored by day and hour, the rest merged in as late rows, and some days rolled up from their partitions."""
    events, path = _events(spark, sf), new_folder(spark, "states")
    states = lambda rows: R.paned(rows, "ts", "1 hour", ["event_type"], F.col("cents"), 3)
    R.create(states(events.where(F.col("event_id") % 2 == 0)), path)
    R.refresh(spark, path, states(events.where(F.col("event_id") % 2 != 0)), ["event_type"])
    found = checkpointed(R.rolled_up(spark, path, *_STORE_DAYS, ["event_type"]))
    remove(spark, path)
    return found

@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity, l_orderkey, l_linenumber")
def full_sort(spark, sf):
    return _lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_quantity", "l_orderkey", "l_linenumber")


def _verdict(df, keys, x, estimates, bound):
    """(keys, n, ok): whether every quantile's rank error is within the bound."""
    errors = Q.rank_errors(df, keys, x, estimates, _PS)
    return errors.groupBy(*keys).agg(F.max("n").alias("n"), (F.max("rank_error") <= bound).alias("ok"))


def _ok_sql(keys: str, relation: str) -> str:
    return f"SELECT {keys}, count(*) AS n, true AS ok FROM {relation} GROUP BY {keys}"


_PS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query()
def maxent_quantiles(spark, sf):
    solved = Q.error_bounds(Q.quantiles(A.build(_lineitem(spark, sf), ["l_returnflag"], F.col("l_extendedprice"), 10, logs=True), _PS), _PS)
    return solved.select("l_returnflag", "n", "qs", "errors", "converged")


@query(_ok_sql("l_returnflag", "lineitem"))
def maxent_quantiles_ok(spark, sf):
    df = _lineitem(spark, sf)
    solved = Q.quantiles(A.build(df, ["l_returnflag"], F.col("l_extendedprice"), 10), _PS, "maxent_plain")
    return _verdict(df, ["l_returnflag"], "l_extendedprice", Q.exploded(solved, ["l_returnflag"], _PS), 0.02)


@query(_ok_sql("event_type", "events"))
def maxent_log_quantiles_ok(spark, sf):
    df = table(spark, sf, "events")
    solved = Q.quantiles(A.build(df, ["event_type"], F.col("value"), 10, logs=True), _PS)
    return _verdict(df, ["event_type"], "value", Q.exploded(solved, ["event_type"], _PS), 0.02)


@query(_ok_sql("l_returnflag", "lineitem"))
def error_bounds_hold(spark, sf):
    """Whether every estimate's true rank error is within its own worst-case bound."""
    df = _lineitem(spark, sf)
    solved = Q.error_bounds(Q.quantiles(A.build(df, ["l_returnflag"], F.col("l_extendedprice"), 8), _PS), _PS)
    bounds = solved.select("l_returnflag", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in _PS]).alias("p"), F.col("errors").alias("e"))).alias("x")).select(F.col("l_returnflag").alias("_k"), F.col("x.p").alias("_p"), F.col("x.e").alias("bound"))
    errors = Q.rank_errors(df, ["l_returnflag"], "l_extendedprice", Q.exploded(solved, ["l_returnflag"], _PS), _PS)
    joined = errors.join(bounds, (F.col("l_returnflag") == F.col("_k")) & (F.col("p") == F.col("_p")))
    return joined.groupBy("l_returnflag").agg(F.max("n").alias("n"), F.bool_and(F.col("rank_error") <= F.col("bound") + 1e-6).alias("ok"))


@query("SELECT l_returnflag, count(*) AS n, true AS contained FROM lineitem GROUP BY l_returnflag")
def bound_containment(spark, sf):
    """Whether the true share above a price is inside its moment bounds."""
    df, t = _lineitem(spark, sf), 50_000.0
    bounds = H.tail_bounds(A.build(df, ["l_returnflag"], F.col("l_extendedprice"), 8, logs=True), t).select("l_returnflag", "lo", "hi")
    true = df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_extendedprice") > t).cast("double")).alias("share"))
    return true.join(bounds, "l_returnflag").select("l_returnflag", "n", ((F.col("lo") <= F.col("share") + 1e-9) & (F.col("share") <= F.col("hi") + 1e-9)).alias("contained"))


def _cascade(spark, sf):
    states = A.build(_lineitem(spark, sf), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), 8, logs=True)
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in (500, 20_000, 60_000, 100_000, 200_000)]))
    return H.cascade(states.withColumn("t", cuts), "t", 0.3)


@query("""SELECT l_returnflag, l_linestatus, t, avg(CAST(l_extendedprice > t AS INT)) > 0.3 AS above
FROM lineitem, (SELECT unnest([500.0, 20000.0, 60000.0, 100000.0, 200000.0])::DOUBLE AS t) GROUP BY ALL""")
def cascade_groups(spark, sf):
    return _cascade(spark, sf).select("l_returnflag", "l_linestatus", "t", "above")


@query()
def cascade_stages(spark, sf):
    return H.stage_counts(_cascade(spark, sf))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, avg(CAST(l_quantity > 45 AS INT)) AS share FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, level, n FROM g WHERE n >= 0.02 * (SELECT count(*) FROM lineitem) AND share > 0.05""")
def cube_search(spark, sf):
    """Groups of the cube with enough support whose share of large quantities exceeds a rate."""
    states = A.cube(A.build(_lineitem(spark, sf), _FLAGS, QTY, 8, logs=True), _FLAGS)
    total = states.where(F.col("level") == 3).select(F.col("n").alias("_all"))
    large = states.crossJoin(F.broadcast(total)).where(F.col("n") >= 0.02 * F.col("_all")).drop("_all")
    return H.cascade(large.withColumn("t", F.lit(45.0)), "t", 0.05).where("above").select(*_FLAGS, "level", "n")


_CUTS = (20, 60, 120, 200)


def _many(spark, sf):
    events = table(spark, sf, "events")
    states = A.build(events, ["user_id", "event_type"], F.col("value"), 6, logs=True)
    decided = H.cascade(states.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in _CUTS]))), "t", 0.1, fit=False)
    return H.counted_where_open(decided, ["user_id", "event_type"], events, "value", 0.1)


@query(f"""SELECT user_id, event_type, t, count(*) AS n, avg(CAST(value > t AS INT)) > 0.1 AS above
FROM events, (SELECT unnest({[float(t) for t in _CUTS]})::DOUBLE AS t) WHERE isfinite(value) GROUP BY ALL""")
def cascade_many(spark, sf):
    """Thousands of groups: of which users and types do over a tenth of the values exceed each cut; exact, open groups are counted."""
    return _many(spark, sf).select("user_id", "event_type", "t", "n", "above")


@query()
def cascade_many_stages(spark, sf):
    return H.stage_counts(_many(spark, sf))


def sliding(spark, sf):
    """Panes' sliding windows in which over a tenth of the values exceed a bound, with the deciding stage.

    Where the bounds leave a window open, its values are counted (stage count): panes'
    counts slide as their states do.
    """
    events = table(spark, sf, "events").where(M.finite(F.col("value").cast("double")))  # as build has it
    paned = A.panes(events, "ts", "1 hour", ["event_type"], F.col("value"), 6, logs=True)
    decided = H.cascade(A.slide(paned, ["event_type"], 6).withColumn("t", F.lit(60.0)), "t", 0.1, fit=False)
    over = events.groupBy(F.window("ts", "1 hour")["start"].alias("pane"), "event_type").agg(F.sum((F.col("value") > 60).cast("long")).alias("over"))
    frame = W.partitionBy("event_type").orderBy("pane").rowsBetween(-5, 0)  # as slide has it
    counted = over.select(F.col("pane").alias("_pane"), F.col("event_type").alias("_type"), F.sum("over").over(frame).alias("over"))
    joined = decided.join(counted, F.col("pane").eqNullSafe(F.col("_pane")) & F.col("event_type").eqNullSafe(F.col("_type")))
    open_ = F.col("stage") == "open"
    above = F.when(open_, F.col("over") / F.col("n") > 0.1).otherwise(F.col("above"))
    return joined.select("pane", "event_type", "n", above.alias("above"), F.when(open_, "count").otherwise(F.col("stage")).alias("stage"))


_OVER_SQL = "SELECT time_bucket(INTERVAL '1 hour', ts) AS pane, event_type, count(*) AS n, count(*) FILTER (value > 60) AS c FROM events WHERE isfinite(value) GROUP BY ALL"


@query(f"SELECT epoch_us(pane) AS pane, event_type, CAST(sum(n) {_FRAME} AS BIGINT) AS n, sum(c) {_FRAME} / sum(n) {_FRAME} > 0.1 AS above FROM ({_OVER_SQL})")
def sliding_threshold(spark, sf):
    return sliding(spark, sf).select(F.unix_micros("pane").alias("pane"), "event_type", "n", "above")


@query(f"""WITH p AS ({_OVER_SQL}), w AS (SELECT pane, event_type, CAST(sum(n) {_FRAME} AS BIGINT) AS n, sum(c) {_FRAME} / sum(n) {_FRAME} > 0.055 AS above FROM p),
v AS (SELECT *, lag(above, 1, false) OVER (PARTITION BY event_type ORDER BY pane) AS before FROM w)
SELECT event_type, epoch_us(pane) AS pane, n, above FROM v WHERE above <> before AND pane + INTERVAL 70 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stream_alerts(spark, sf):
    """Where a stream's sliding windows cross a share of large values, of the panes that its watermark has closed."""
    events = table(spark, sf, "events")
    stream = N.stream_of(spark, f"{sf}/events.parquet", events.select("ts", "event_type", "value"))
    found = N.alert_once(stream, new_folder(spark, "alerts"), "ts", "1 hour", "event_type", F.col("value"), 60.0, 0.055, 6)
    return found.select(F.col("key").alias("event_type"), F.unix_micros("pane").alias("pane"), "n", "above")


@query()
def sliding_stages(spark, sf):
    return H.stage_counts(sliding(spark, sf))


@query("SELECT l_returnflag, " + ", ".join(f"round(greatest({p}, least(1.0, CASE WHEN {q} > mn THEN (p1 / n - mn) / ({q} - mn) ELSE 1.0 END) - (1 - {p})), 6) AS e{round(100 * p)}" for p, q in ((0.5, 26.0), (0.9, 46.0))) + f" FROM {_STATE5}")
def markov_quantile_error(spark, sf):
    """What the mean alone says of two quantile estimates."""
    found = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 5)
    return found.select("l_returnflag", *[F.round(M.markov_quantile_error(F.lit(q), p), 6).alias(f"e{round(100 * p)}") for p, q in ((0.5, 26.0), (0.9, 46.0))])


_HIST_SQL = """WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
g AS (SELECT power(2.0, ceil(log2((hi - lo) / 31))) AS width, lo FROM e), o AS (SELECT width, floor(lo / width) * width AS origin FROM g),
h AS (SELECT width, origin, least(31, floor((p_retailprice - origin) / width))::INT AS bin, count(*) AS n FROM part, o GROUP BY ALL)"""


@query(f"{_HIST_SQL} SELECT width, origin, bin, n FROM h")
def pow2_histogram(spark, sf):
    return Y.grid_histogram(table(spark, sf, "part"), [], "p_retailprice", 32)


@query(f"{_HIST_SQL}, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT round(min_by((bin + (0.5 * total - (upto - n)) / n) * width + origin, bin), 6) AS q FROM c WHERE upto >= 0.5 * total")
def pow2_hist_quantile(spark, sf):
    return Y.histogram_quantile(Y.grid_histogram(table(spark, sf, "part"), [], "p_retailprice", 32), [], 0.5).select(F.round("q", 6).alias("q"))


@query(f"{_HIST_SQL} SELECT width, bin, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def pow2_histogram_merge(spark, sf):
    """Histograms of order sizes' halves, merged; the same as one of all."""
    whole = Y.grid_histogram(table(spark, sf, "part"), [], "p_retailprice", 32)
    halves = whole.withColumn("half", F.col("bin") % 2)
    merged = Y.merge_histograms(halves, [])
    first = whole.agg(F.max("origin").alias("_o"))
    moved = merged.crossJoin(F.broadcast(first))
    return moved.select("width", (F.col("bin") + F.round((F.col("origin") - F.col("_o")) / F.col("width")).cast("int")).alias("bin"), "n")


def _summary_ok(name: str, size: float, bound: float):
    def run(spark, sf):
        df = _lineitem(spark, sf).withColumn("_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
        solved = Y.load(name, size).quantiles(df, ["l_returnflag"], "l_extendedprice", _PS)
        return _verdict(df, ["l_returnflag"], "l_extendedprice", Q.exploded(solved, ["l_returnflag"], _PS), bound)

    _QUERIES[f"{name}_ok"], _SQL[f"{name}_ok"] = run, _ok_sql("l_returnflag", "lineitem")


for _name, _size, _bound in [("gk", 200, 0.01), ("gk_adaptive", 100, 0.01), ("kll", 400, 0.02), ("random", 50, 0.02), ("tdigest", 200, 0.01), ("reservoir", 1500, 0.06), ("drawn_reservoir", 1500, 0.06), ("streaming_histogram", 100, 0.02), ("grid_histogram", 100, 0.03), ("moments", 11, 0.02), ("log_moments", 11, 0.02), ("hybrid_moments", 11, 0.02)]:
    _summary_ok(_name, _size, _bound)


@query("SELECT count(*) AS n, true AS ok FROM orders")
def rank_error_of_builtin(spark, sf):
    df = table(spark, sf, "orders")
    solved = Y.gk_quantiles(df, [], "o_totalprice", _PS, 1000)
    errors = Q.rank_errors(df, [], "o_totalprice", Q.exploded(solved, [], _PS), _PS)
    return errors.agg(F.max("n").alias("n"), (F.max("rank_error") <= 0.002).alias("ok"))


@query("SELECT count(*) AS n, true AS ok FROM events")
def kll_merge_rank_ok(spark, sf):
    """Whether the rank of 10 in merged cell sketches is within 0.02 of the true one."""
    df = table(spark, sf, "events")
    merged = Y.merge_kll(Y.kll(df, ["event_type"], "value", 400), [])
    rank = Y.kll_rank(merged, [], 10.0)
    true = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") <= 10).cast("double")).alias("share"))
    return true.crossJoin(F.broadcast(rank)).select("n", (F.abs(F.col("share") - F.col("rank")) <= 0.02).alias("ok"))


def _merged_ok(name: str, build, merge, quantiles, bound: float):
    """Registers a query that builds cells' states, merges them, and holds the merged ones against all rows."""

    def run(spark, sf):
        df = table(spark, sf, "events")
        cells = build(A.cells(df, "event_id", 2_000), ["event_type", "cell_id"])
        solved = quantiles(merge(cells.drop("cell_id"), ["event_type"]), ["event_type"])
        return _verdict(df, ["event_type"], "value", Q.exploded(solved, ["event_type"], _PS), bound)

    _QUERIES[f"{name}_merge_ok"], _SQL[f"{name}_merge_ok"] = run, _ok_sql("event_type", "events")


_merged_ok("streaming_histogram", lambda df, keys: Y.streaming_histogram(df, keys, "value", 100), lambda s, keys: Y.merge_streaming_histograms(s, keys, 100), lambda s, keys: Y.streaming_histogram_quantiles(s, keys, _PS), 0.03)
_merged_ok("tdigest", lambda df, keys: Y.tdigest(df, keys, "value", 200), lambda s, keys: Y.merge_tdigests(s, keys, 200), lambda s, keys: Y.tdigest_quantiles(s, keys, _PS), 0.02)
_merged_ok("gk", lambda df, keys: Y.gk(df, keys, "value", 100), lambda s, keys: Y.merge_gk(s, keys, 100), lambda s, keys: Y.gk_state_quantiles(s, keys, _PS), 0.01)
_merged_ok("gk_adaptive", lambda df, keys: Y.gk_adaptive(df, keys, "value", 100), lambda s, keys: Y.merge_gk_adaptive(s, keys, 100), lambda s, keys: Y.gk_adaptive_quantiles(s, keys, _PS, 100), 0.01)
_merged_ok("random", lambda df, keys: Y.random_buffers(df, keys, "value", 50), lambda s, keys: Y.merge_random_buffers(s, keys, 50), lambda s, keys: Y.random_quantiles(s, keys, _PS), 0.02)
_merged_ok("reservoir", lambda df, keys: Y.drawn_reservoir(df, keys, "value", 1500), lambda s, keys: Y.merge_drawn_reservoirs(s, keys, 1500), lambda s, keys: Y.drawn_reservoir_quantiles(s, keys, _PS), 0.06)
_merged_ok("spaced_histogram", lambda df, keys: Y.streaming_histogram(df, keys, "value", 200, least=0.25), lambda s, keys: Y.merge_streaming_histograms(s, keys, 200, 0.25), lambda s, keys: Y.streaming_histogram_quantiles(s, keys, _PS), 0.03)


def _share_ok(df, found, bound: float):
    """(event_type, n, ok): whether found (event_type, share) is within bound of the share of values up to 10."""
    true = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") <= 10).cast("double")).alias("_true"))
    return true.join(found, "event_type").select("event_type", "n", (F.abs(F.col("share") - F.col("_true")) <= bound).alias("ok"))


@query(_ok_sql("event_type", "events"))
def tdigest_below_ok(spark, sf):
    df = table(spark, sf, "events")
    return _share_ok(df, Y.tdigest_below(Y.tdigest(df, ["event_type"], "value", 200), ["event_type"], 10.0), 0.01)


@query(_ok_sql("event_type", "events"))
def streaming_histogram_below_ok(spark, sf):
    df = table(spark, sf, "events")
    hists = Y.streaming_histogram(df, ["event_type"], "value", 100)
    n = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("_n"))
    found = Y.streaming_histogram_below(hists, ["event_type"], 10.0).join(n, "event_type")
    return _share_ok(df, found.select("event_type", (F.col("n_below") / F.col("_n")).alias("share")), 0.02)


_SPLITS = (5.0, 10.0, 40.0)


@query(_ok_sql("event_type", "events"))
def kll_pmf_ok(spark, sf):
    """Whether the shares of values between splits are within the sketch's error of the true ones."""
    df = table(spark, sf, "events")
    found = Y.kll_pmf(Y.kll(df, ["event_type"], "value", 400), ["event_type"], _SPLITS)
    bucket = sum(((F.col("value") > s).cast("int") for s in _SPLITS), F.lit(0))
    true = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg((bucket == i).cast("double")) for i in range(len(_SPLITS) + 1)]).alias("_true"))
    return true.join(found, "event_type").select("event_type", "n", F.forall(F.zip_with("pmf", "_true", lambda a, b: F.abs(a - b)), lambda d: d <= 0.02).alias("ok"))


@query(_ok_sql("event_type", "events"))
def kll_downsample_ok(spark, sf):
    """Whether sketches of sizes 400 and 100 merge to the smaller and hold its error: ranks of quantiles within twice the bound of one rank."""
    df = table(spark, sf, "events")
    part = lambda even, k: Y.kll(df.where((F.col("event_id") % 2 == 0) == even), ["event_type"], "value", k)
    merged = Y.merge_kll(part(True, 400).unionByName(part(False, 100)), ["event_type"])
    solved = Y.kll_quantiles(merged, ["event_type"], _PS)
    return _verdict(df, ["event_type"], "value", Q.exploded(solved, ["event_type"], _PS), 2 * Y.kll_error(100, pmf=False))


@query(_ok_sql("l_returnflag", "lineitem"))
def kll_bounds_ok(spark, sf):
    """Whether the true median lies between the sketch's bounds, and evenly spaced quantiles rise from end to end."""
    df, keys = _lineitem(spark, sf), ["l_returnflag"]
    sketches = Y.kll(df, keys, "l_extendedprice", 400)
    even = Y.even_quantiles(sketches, keys, 11).select("l_returnflag", "qs")
    found = Y.kll_bounds(sketches, keys, 0.5, 400).join(even, "l_returnflag")
    true = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("_true"))
    within = (F.col("lo") <= F.col("_true")) & (F.col("_true") <= F.col("hi")) & (F.array_sort("qs") == F.col("qs"))
    return true.join(found, "l_returnflag").select("l_returnflag", "n", within.alias("ok"))


@query("SELECT count(*) FILTER (event_type = 'click') AS n, true AS ok FROM events")
def kll_ks_ok(spark, sf):
    """Whether the distance of two sketches is within their errors of the exact one."""
    df = table(spark, sf, "events").withColumn("side", F.col("event_type") == "click")
    sketch = lambda side: Y.kll(df.where(F.col("side") == side), [], "value", 400)
    n = df.agg(F.sum(F.col("side").cast("long")).alias("n"))
    both = Y.kll_ks(sketch(True), sketch(False)).crossJoin(Y.ks_distance(df, "side", "value").withColumnRenamed("distance", "_true")).crossJoin(n)  # one row each
    return both.select("n", (F.abs(F.col("distance") - F.col("_true")) <= 0.02).alias("ok"))


@query("""WITH v AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM v) AS fa, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM v) AS fb FROM v) SELECT round(max(abs(fa - fb)), 9) AS distance FROM c""")
def ks_distance(spark, sf):
    rows = _lineitem(spark, sf).where(F.col("l_returnflag").isin("R", "A")).withColumn("side", F.col("l_returnflag") == "R")
    return Y.ks_distance(rows, "side", "l_quantity").select(F.round("distance", 9).alias("distance"))


@query("""WITH v AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1),
t AS (SELECT sum(a) AS n, sum(b) AS m FROM v), c AS (SELECT sum(a) OVER (ORDER BY x) / n AS fa, sum(b) OVER (ORDER BY x) / m AS fb, n, m FROM v, t)
SELECT round(max(abs(fa - fb)), 9) AS distance, round(sqrt(-0.5 * ln(0.025)) * sqrt((n + m)::DOUBLE / (n::DOUBLE * m)), 9) AS threshold, max(abs(fa - fb)) > sqrt(-0.5 * ln(0.025)) * sqrt((n + m)::DOUBLE / (n::DOUBLE * m)) AS differ FROM c GROUP BY n, m""")
def ks_test(spark, sf):
    rows = _lineitem(spark, sf).where(F.col("l_returnflag").isin("R", "A")).withColumn("side", F.col("l_returnflag") == "R")
    return Y.ks_test(rows, "side", "l_quantity").select(F.round("distance", 9).alias("distance"), F.round("threshold", 9).alias("threshold"), "differ")


@query("SELECT l_returnflag, count(*) AS n, true AS ok FROM lineitem GROUP BY l_returnflag")
def subset_sum_ok(spark, sf):
    """Whether the number of lines above a quantity is inside its sample's exact binomial limits."""
    df = _lineitem(spark, sf).withColumn("_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    sample = Y.reservoir(df, ["l_returnflag"], "_id", "l_quantity", 1000)
    total = df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    found = Y.subset_sum(sample, ["l_returnflag"], total, F.col("x") > 25)
    true = df.groupBy("l_returnflag").agg(F.sum((F.col(QTY) > 25).cast("long")).alias("true"))
    return found.join(true, "l_returnflag").select("l_returnflag", "n", ((F.col("lo") <= F.col("true")) & (F.col("true") <= F.col("hi"))).alias("ok"))


@query("SELECT width_bucket_ AS bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS width_bucket_ FROM lineitem) GROUP BY 1")
def exact_pmf(spark, sf):
    df = _lineitem(spark, sf)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.when(F.col(QTY) < 10, 0).when(F.col(QTY) < 25, 1).when(F.col(QTY) < 40, 2).otherwise(3)
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") / F.col("_n"), 9).alias("share"))


@query("SELECT id, (id % 30) / 29.0 AS x FROM (SELECT unnest(range(0, 5000)) AS id)")
def discrete_source(spark, sf):
    return synthetic.discrete(spark, 5000, 30)


@query("SELECT i AS id, i / 100.0 AS x FROM (SELECT unnest(range(0, 101)) AS i)")
def uniform_source(spark, sf):
    return synthetic.integers(spark, 101).select("id", (F.col("x") / 100).alias("x"))


@query(f"""WITH e AS (SELECT event_id, {CENTS_SQL} AS x FROM events), n AS (SELECT max(event_id) + 1 AS n FROM e)
SELECT event_id, x FROM e UNION ALL SELECT event_id, x * 0.5 + 1000 FROM e, n WHERE event_id < floor(0.01 * n)""")
def outlier_source(spark, sf):
    return synthetic.with_outliers(_events(spark, sf).select("event_id", F.col("cents").alias("x")), "event_id", "x", 0.01, 0.5, 1000.0)


@query()
def gaussian_source(spark, sf):
    return synthetic.gaussian(spark, 10_000)


@query("SELECT source, 20000::BIGINT AS n, true AS ok FROM (SELECT unnest(['gaussian', 'pareto', 'gamma', 'exponential', 'shuffled']) AS source)")
def generated_sources_ok(spark, sf):
    """Whether generated numbers have the share of their distribution below a point, within 0.02; ten values of it hold it in the shuffled source."""
    n, made = 20_000, synthetic
    sources = {
        "gaussian": (made.gaussian(spark, n), 1.0, 0.8413),
        "pareto": (made.pareto(spark, n, 0.1), 1.0, 1 - 2**-0.1),
        "gamma": (made.gamma(spark, n, 0.1), 0.1, 0.8275),
        "exponential": (made.exponential(spark, n), 1.0, 0.6321),
        "shuffled": (made.shuffled(made.integers(spark, n)).select("id", "x"), 4999.5, 0.25),
    }
    below = [df.agg(F.lit(k).alias("source"), F.count("x").alias("n"), (F.abs(F.avg((F.col("x") <= at).cast("double")) - share) <= 0.02).alias("ok")) for k, (df, at, share) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), below)


@query("SELECT l_returnflag, count(*) AS n, true AS ok FROM lineitem GROUP BY l_returnflag")
def canonical_points_ok(spark, sf):
    """Whether the canonical distribution at a quantity has all mass, the state's mean and mean square, and an entropy of at most its points' logarithm."""
    states = A.build(_lineitem(spark, sf), ["l_returnflag"], QTY, 6)
    found = Q.canonical_entropy(Q.canonical_points(states, 20.5))
    mean = lambda i: F.aggregate("points", F.lit(0.0), lambda a, p: a + p["weight"] * F.pow(p["pos"], i))
    near = [F.abs(mean(i) / (F.col(f"p{i}") / F.col("n")) - 1) < 1e-6 for i in (1, 2)]
    return found.select("l_returnflag", "n", ((F.abs(mean(0) - 1) < 1e-6) & near[0] & near[1] & (F.col("entropy") <= F.log(F.size("points")) + 1e-9) & (F.col("entropy") > 0)).alias("ok"))


_CARDINALITIES = (6, 10, 30, 100, 300, 1000)


@query(f"SELECT c::INT AS cardinality, 20000::BIGINT AS n, true AS ok FROM (SELECT unnest({list(_CARDINALITIES)}) AS c)")
def discrete_bench_ok(spark, sf):
    """Maximum entropy on few distinct values: rank errors of the order of a value's share; all cardinalities in one pass."""
    rows = spark.range(20_000).withColumn("cardinality", F.explode(F.array(*[F.lit(c) for c in _CARDINALITIES])))
    df = rows.select("cardinality", ((F.col("id") % F.col("cardinality")) / (F.col("cardinality") - 1)).alias("x"))
    solved = Q.exploded(Q.quantiles(A.build(df, ["cardinality"], F.col("x"), 10), _PS), ["cardinality"], _PS)
    errors = Q.rank_errors(df, ["cardinality"], "x", solved, _PS)
    return errors.groupBy("cardinality").agg(F.max("n").alias("n"), F.bool_and(F.col("rank_error") <= F.greatest(F.lit(0.04), 1 / F.col("cardinality"))).alias("ok"))


@query(_ok_sql("event_type", "events"))
def outlier_bench_ok(spark, sf):
    df = synthetic.with_outliers(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id", "value", 0.01, 0.1, 300.0)
    solved = Q.quantiles(A.build(df, ["event_type"], F.col("value"), 10, logs=True), _PS)
    found = _verdict(df, ["event_type"], "value", Q.exploded(solved, ["event_type"], _PS), 0.03)
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.drop("n").join(n, "event_type").select("event_type", "n", "ok")


def _worst(df, x: str, estimates, key: str, keys: list):
    """(key, rank_error): the greatest of each key's estimates (key, p, q), in one pass over df."""
    rows = df.select(x, F.explode(F.array(*[F.lit(k) for k in keys])).alias(key))
    return Q.rank_errors(rows, [key], x, estimates, _PS).groupBy(key).agg(F.max("rank_error").alias("rank_error"))


@query()
def solver_comparison(spark, sf):
    """Greatest rank error of each estimator on the same states."""
    df = table(spark, sf, "events")
    states = A.build(df, [], F.col("value"), 8, logs=True)
    closed = states.select(M.inversion_quantiles(_PS, 8).alias("qs"))
    solved = [Q.quantiles(states, _PS, m).select("qs").withColumn("method", F.lit(m)) for m in Q.SOLVERS] + [closed.withColumn("method", F.lit("inversion"))]
    estimates = Q.exploded(reduce(lambda a, b: a.unionByName(b), solved), ["method"], _PS)
    return _worst(df, "value", estimates, "method", [*Q.SOLVERS, "inversion"])


@query("SELECT l_returnflag, method, count(*) AS n, true AS ok FROM lineitem, (VALUES ('cell_entropy'), ('least_squares'), ('smallest_density')) AS m(method) GROUP BY ALL")
def cell_estimators_ok(spark, sf):
    """Whether estimates on a grid of cells, from the same states, are within 0.03 of each rank."""
    df, key = _lineitem(spark, sf), "l_returnflag"
    states = A.build(df, [key], F.col("l_extendedprice"), 8)
    methods = ["cell_entropy", "least_squares", "smallest_density"]
    solved = reduce(lambda a, b: a.unionByName(b), [Q.quantiles(states, _PS, m).select(key, F.lit(m).alias("method"), "qs") for m in methods])
    rows = df.select(key, "l_extendedprice", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return _verdict(rows, [key, "method"], "l_extendedprice", Q.exploded(solved, [key, "method"], _PS), 0.03)


#: Significant bits that stored sums keep.
_BITS = (53, 40, 32, 24, 16, 12, 8)


@query()
def precision_study(spark, sf):
    """Greatest rank error of quantiles from states whose sums keep fewer and fewer bits."""
    df = table(spark, sf, "events")
    states = A.build(df, [], F.col("value"), 8, logs=True)
    kept = reduce(lambda a, b: a.unionByName(b), [A.reduced_precision(states, b).withColumn("bits", F.lit(b)) for b in _BITS])
    return _worst(df, "value", Q.exploded(Q.quantiles(kept, _PS), ["bits"], _PS), "bits", list(_BITS))


@query("SELECT event_id, value, event_type FROM events WHERE isfinite(value) AND event_type IS NOT NULL")
def finite_filter(spark, sf):
    return E.finite_rows(table(spark, sf, "events"), "value", ["event_type"]).select("event_id", "value", "event_type")


_MARK_SQL = "CAST(round_even(epoch_us(ts) / 600000000, 0) AS BIGINT) * 600000000"


@query(f"SELECT {_MARK_SQL} AS mark, event_type, count(*) AS n FROM events GROUP BY ALL")
def cell_sizes(spark, sf):
    marked = table(spark, sf, "events").withColumn("mark", F.unix_micros(synthetic.nearest_ten_minutes(F.col("ts"))))
    return E.cell_sizes(marked, ["mark", "event_type"])


@query("SELECT user_id, event_type, list_sort(list(value)) AS data FROM events GROUP BY ALL")
def collect_cells(spark, sf):
    return E.collected(table(spark, sf, "events"), ["user_id", "event_type"], "value")


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, count(v) AS n, min(v) AS mn, max(v) AS mx FROM x GROUP BY label""")
def array_state(spark, sf):
    return A.build_arrays(table(spark, sf, "embeddings"), ["label"], "embedding", 2).select("label", "n", "mn", "mx")


@query("SELECT l_quantity AS x, count(*) AS n, round(sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def ecdf(spark, sf):
    return E.ecdf(_lineitem(spark, sf), "l_quantity").select("x", "n", F.round("share", 9).alias("share"))


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def systematic_sample(spark, sf):
    return E.every(table(spark, sf, "events"), "event_id", 100).select("event_id", "value")


#: Result rows as a benchmark gives them: a few small literals.
_RESULT_COLUMNS = "sketch, size_param, trial, q, threads, n, cells, merge_time, query_time, rank_error"
_RESULTS = [(s, k, t, q, th, 1000 * k, 10, 1000 * k + 100 * t + th, 50 * k + t, round(0.001 * k * (1 + t) * q, 6)) for s, k in (("moments", 10), ("kll", 32)) for t in (0, 1, 2) for q in (0.1, 0.5, 0.9) for th in (1, 2, 4)]
_RESULTS_SQL = f"(SELECT * REPLACE (q::DOUBLE AS q, rank_error::DOUBLE AS rank_error) FROM (VALUES {', '.join(str(r) for r in _RESULTS)}) AS r({_RESULT_COLUMNS}))"


def _results(spark):
    return spark.createDataFrame(_RESULTS, "sketch string, size_param int, trial int, q double, threads int, n long, cells int, merge_time long, query_time long, rank_error double")


@query(f"SELECT sketch, size_param, q, round(avg(merge_time), 6) AS merge_time, round(avg(rank_error), 6) AS rank_error FROM {_RESULTS_SQL} WHERE trial > 0 GROUP BY ALL")
def trial_means(spark, sf):
    found = E.mean_by(_results(spark), ["sketch", "size_param", "q"], ["merge_time", "rank_error"])
    return found.withColumn("merge_time", F.round("merge_time", 6)).withColumn("rank_error", F.round("rank_error", 6))


@query(f"SELECT sketch, trial, max(rank_error)::DOUBLE AS worst FROM {_RESULTS_SQL} GROUP BY ALL")
def trial_worst(spark, sf):
    return _results(spark).groupBy("sketch", "trial").agg(F.max("rank_error").alias("worst"))


@query(f"SELECT sketch, size_param, round(avg(m), 6) AS rank_error FROM (SELECT sketch, size_param, trial, avg(rank_error) AS m FROM {_RESULTS_SQL} GROUP BY ALL) GROUP BY ALL")
def two_level_mean(spark, sf):
    return E.mean_over_then(_results(spark), ["sketch", "size_param"], ["trial"], "rank_error").withColumn("rank_error", F.round("rank_error", 6))


@query(f"SELECT sketch, trial, q, threads, round(rank_error / least(q, 1 - q), 6) AS relative_error, round(n * 1e6 / merge_time, 3) AS throughput, (merge_time + query_time)::DOUBLE AS end_to_end, round(merge_time / cells, 6) AS per_merge FROM {_RESULTS_SQL}")
def derived_columns(spark, sf):
    found = E.derived(_results(spark))
    return found.select("sketch", "trial", "q", "threads", F.round("relative_error", 6).alias("relative_error"), F.round("throughput", 3).alias("throughput"), "end_to_end", F.round("per_merge", 6).alias("per_merge"))


@query(f"WITH t AS (SELECT *, n * 1e6 / merge_time AS throughput FROM {_RESULTS_SQL}), o AS (SELECT sketch, avg(throughput) AS one FROM t WHERE threads = 1 GROUP BY sketch) SELECT DISTINCT sketch, threads, round(one * threads, 3) AS ideal FROM t JOIN o USING (sketch)")
def ideal_scaling(spark, sf):
    found = E.ideal_scaling(E.derived(_results(spark)))
    return found.select("sketch", "threads", F.round("ideal", 3).alias("ideal")).distinct()


@query("SELECT event_id, event_type, value FROM events WHERE (event_type = 'click' AND value > 100) OR event_id % 997 = 0")
def modulo_or_filter(spark, sf):
    return table(spark, sf, "events").where(((F.col("event_type") == "click") & (F.col("value") > 100)) | (F.col("event_id") % 997 == 0)).select("event_id", "event_type", "value")


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > (SELECT mean FROM m WHERE l_returnflag = 'R') GROUP BY 1")
def point_lookup(spark, sf):
    """Lines above the mean of one group of an aggregate, looked up by its key."""
    df = _lineitem(spark, sf)
    mean = df.groupBy("l_returnflag").agg(F.avg(QTY).alias("mean")).where("l_returnflag = 'R'").select("mean")  # one row
    return df.join(F.broadcast(mean), F.col(QTY) > F.col("mean")).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 1 THEN ln(value) END AS stat FROM events) WHERE stat IS NOT NULL GROUP BY 1")
def drop_missing(spark, sf):
    """Groups of rows whose statistic is there."""
    stats = table(spark, sf, "events").select("event_type", F.when(F.col("value") > 1, F.log("value")).alias("stat"))
    return stats.dropna(subset=["stat"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def summary_sizes(spark, sf):
    """Bytes of stored states over one column, by summary."""
    df = table(spark, sf, "events")
    arrays = lambda *names: sum((8 * F.size(c) for c in names), F.lit(16))
    found = [
        Y.kll(df, [], "value", 400).select(F.lit("kll").alias("summary"), F.length("sketch").alias("bytes")),
        Y.tdigest(df, [], "value", 200).select(F.lit("tdigest"), arrays("means", "weights")),
        Y.streaming_histogram(df, [], "value", 100).select(F.lit("streaming_histogram"), arrays("centers", "counts")),
        Y.gk(df, [], "value", 100).select(F.lit("gk"), arrays("tops", "gaps", "slacks")),
        Y.gk_adaptive(df, [], "value", 100).select(F.lit("gk_adaptive"), arrays("tops", "gaps", "slacks", "pending")),
        Y.random_buffers(df, [], "value", 50).select(F.lit("random"), arrays("held", "weights", "open")),
        Y.drawn_reservoir(df, [], "value", 1500).select(F.lit("drawn_reservoir"), arrays("sample")),
        spark.range(1).select(F.lit("log_moments"), F.lit(M.state_bytes(10, True))),
    ]
    return reduce(lambda a, b: a.union(b), found).select("summary", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_dims(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct()


@query("SELECT lang, source, count(*) AS n, min(n_chars)::DOUBLE AS mn, max(n_chars)::DOUBLE AS mx, sum(n_chars)::DOUBLE AS p1, sum(n_chars * n_chars)::DOUBLE AS p2 FROM documents GROUP BY ALL")
def wide_range_state(spark, sf):
    return A.build(table(spark, sf, "documents"), ["lang", "source"], F.col("n_chars"), 2)


@query(f"SELECT 'moments' AS summary, {M.state_bytes(10, False)} AS bytes UNION ALL SELECT 'log_moments', {M.state_bytes(10, True)}")
def state_sizes(spark, sf):
    return spark.createDataFrame([("moments", M.state_bytes(10, False)), ("log_moments", M.state_bytes(10, True))], "summary string, bytes int")
