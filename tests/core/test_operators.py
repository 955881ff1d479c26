import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchwell.plans import catalog
from sketchwell.functions import buffers as B
from sketchwell.functions import moments as M
from sketchwell.operators import evaluation as E
from sketchwell.operators import quantiles as Q
from sketchwell.operators import states as A
from sketchwell.operators import summaries as Y
from sketchwell.operators import thresholds as H
from sketchwell.sources import readers, synthetic
from sketchwell.streaming import incremental


def test_merged_states_equal_direct_ones(spark):
    df = synthetic.integers(spark, 1000).withColumn("g", F.col("id") % 3)
    direct = sorted(A.build(df, ["g"], F.col("x"), 4).collect())
    merged = sorted(A.merge(A.build(A.cells(df, "id", 60), ["g", "cell_id"], F.col("x"), 4), ["g"]).collect())
    assert direct == merged


def test_states_of_odd_values(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("a", -2.0), ("b", None), (None, 3.0), (None, 3.0)]
    got = {r["k"]: r for r in A.build(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), 2, logs=True).collect()}
    assert set(got) == {"a", None} and (got["a"]["n"], got["a"]["ln_n"], got["a"]["p2"], got["a"]["mx"]) == (2, 1, 5.0, 1.0)
    solved = {r["k"]: r["qs"] for r in Q.quantiles(A.build(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), 2, logs=True), [0.5]).collect()}
    assert solved[None] == [3.0] and -2 <= solved["a"][0] <= 1
    empty = spark.createDataFrame([], "k string, v double")
    assert Q.quantiles(A.build(empty, ["k"], F.col("v"), 3), [0.5]).count() == 0


def test_markov_holds_with_values_of_at_most_zero(spark):
    rows = [(0.0,)] * 50 + [(1.0,)] * 25 + [(math.e,)] * 25
    lo, hi = M.markov_bounds(F.lit(math.exp(0.01)), 3, logs=True)
    r = A.build(spark.createDataFrame(rows, "v double"), [], F.col("v"), 3, logs=True).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r["lo"] <= 0.25 <= r["hi"]


def test_moment_bounds_are_inside_markov(spark):
    states = A.build(synthetic.exponential(spark, 20_000, seed=3), [], F.col("x"), 8)
    lo, hi = M.markov_bounds(F.lit(5.0), 8)
    m = states.select(lo.alias("lo"), hi.alias("hi")).first()
    r = H.tail_bounds(states, 5.0).first()
    assert m["lo"] <= r["lo"] <= math.exp(-5) + 0.002 and r["hi"] <= m["hi"] and r["lo"] <= r["share"] <= r["hi"]


def test_cascade_ends_and_ties(spark):
    df = spark.createDataFrame([("same", 5.0)] * 10 + [("mix", float(i)) for i in range(100)], "k string, v double")
    states = A.build(df, ["k"], F.col("v"), 6, logs=True)
    verdict = lambda t: {r["k"]: (r["above"], r["stage"]) for r in H.cascade(states.withColumn("t", F.lit(t)), "t", 0.5).collect()}
    assert verdict(4.9)["same"] == (True, "range") and verdict(5.0)["same"] == (False, "range")
    assert verdict(20.0)["mix"][0] is True and verdict(80.0)["mix"][0] is False and verdict(-1.0)["mix"] == (True, "range")


def test_canonical_points_and_reduced_precision(spark):
    states = A.build(synthetic.uniform(spark, 500), [], F.col("x"), 6)
    points = Q.canonical_points(states, 0.5).first()["points"]
    assert abs(sum(p["weight"] for p in points) - 1) < 1e-6 and any(abs(p["pos"] - 0.5) < 1e-9 for p in points)
    cut = A.reduced_precision(states, 8).first()
    assert A.reduced_precision(states).columns == states.columns and all(abs(cut[f"p{i}"] / states.first()[f"p{i}"] - 1) <= 2**-8 for i in range(1, 7))


def test_registry_names(spark):
    assert Y.canonical("yahoo") == "kll" and Y.load("spark_gk", 100).error() == 0.01
    with pytest.raises(ValueError):
        Y.canonical("nothing")
    assert Y.kll_error(Y.k_for_error(0.01)) <= 0.01


def test_histograms_merge_exactly(spark):
    df = synthetic.integers(spark, 1000)
    whole = {(r["origin"] + r["bin"] * r["width"]): r["n"] for r in Y.grid_histogram(df, [], "x", 32).collect()}  # the width that the larger part has with 16
    parts = Y.grid_histogram(df.withColumn("part", (F.col("id") < 900).cast("int")), ["part"], "x", 16).drop("part")
    merged = {(r["origin"] + r["bin"] * r["width"]): r["n"] for r in Y.merge_histograms(parts, []).collect()}
    assert merged == whole


def test_reservoirs_merge_to_the_same_rows(spark):
    df = synthetic.integers(spark, 2000).withColumn("g", F.col("id") % 2)
    whole = sorted(Y.reservoir(df, ["g"], "id", "x", 50).collect())
    halves = Y.reservoir(df.where("id < 700"), ["g"], "id", "x", 50).unionByName(Y.reservoir(df.where("id >= 700"), ["g"], "id", "x", 50))
    assert sorted(Y.merge_reservoirs(halves, ["g"], 50).collect()) == whole and len(whole) == 100


def test_stored_summaries_merge_within_their_error(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.exponential(1, 6000), rng.integers(0, 3, 2000)])
    df = spark.createDataFrame([(None if i % 3 else "k", int(i % 7), float(v)) for i, v in enumerate(values)], "k string, part int, x double").repartition(5)
    ps = [0.01, 0.25, 0.5, 0.9, 1.0]
    for build, merge, quantiles, error in [
        (lambda d, k: Y.streaming_histogram(d, k, "x", 60), lambda s, k: Y.merge_streaming_histograms(s, k, 60), Y.streaming_histogram_quantiles, 0.1),
        (lambda d, k: Y.tdigest(d, k, "x", 200), lambda s, k: Y.merge_tdigests(s, k, 200), Y.tdigest_quantiles, 0.02),
        (lambda d, k: Y.random_buffers(d, k, "x", 50), lambda s, k: Y.merge_random_buffers(s, k, 50), Y.random_quantiles, 0.02),
        (lambda d, k: Y.gk_adaptive(d, k, "x", 100), lambda s, k: Y.merge_gk_adaptive(s, k, 100), lambda s, k, ps: Y.gk_adaptive_quantiles(s, k, ps, 100), 0.01),
        (lambda d, k: Y.drawn_reservoir(d, k, "x", 1500), lambda s, k: Y.merge_drawn_reservoirs(s, k, 1500), Y.drawn_reservoir_quantiles, 0.05),
        (lambda d, k: Y.gk(d, k, "x", 100), lambda s, k: Y.merge_gk(s, k, 100), Y.gk_state_quantiles, 0.01),
    ]:
        state = merge(build(df, ["k", "part"]).drop("part"), ["k"])
        for r in quantiles(state, ["k"], ps).collect():
            own = np.sort([v for i, v in enumerate(values) if (None if i % 3 else "k") == r["k"]])
            for p, q in zip(ps, r["qs"], strict=True):
                low, high = np.searchsorted(own, q, "left") / len(own), np.searchsorted(own, q, "right") / len(own)
                assert low - error <= p <= high + error, (r["k"], p, q, low, high)
    assert Y.tdigest(df.limit(0), ["k"], "x").count() == 0
    limited = Y.streaming_histogram(df, [], "x", 60, low=0.5, high=2.0).first()
    assert 0.5 <= limited["mn"] and limited["mx"] <= 2.0 and abs(sum(limited["counts"]) - ((values >= 0.5) & (values <= 2.0)).sum()) < 1e-6


def test_tuples_keep_ranks(spark):
    rng = np.random.default_rng(2)
    state = (np.zeros(0), np.zeros(0), np.zeros(0))
    every = np.zeros(0)
    for _ in range(40):
        fresh = np.sort(rng.normal(size=rng.integers(1, 400)))
        every = np.sort(np.concatenate([every, fresh]))
        state = B.tuples_merged(*zip(state, (fresh, np.ones(len(fresh)), np.zeros(len(fresh))), strict=True), 0.01)
        least = np.cumsum(state[1])
        for v, low, slack in zip(state[0], least, state[2], strict=True):
            true = np.searchsorted(every, v, "right")
            assert low <= true <= low + slack, (v, low, true, slack)
    assert len(state[0]) < 300 < len(every)


def test_ks_threshold_and_test(spark):
    same = spark.range(4000).select((F.col("id") % 2 == 0).alias("side"), F.xxhash64("id").cast("double").alias("x"))
    other = same.withColumn("x", F.when(F.col("side"), F.col("x")).otherwise(F.col("x") + 2e18))
    assert Y.ks_test(same, "side", "x").first()["differ"] is False and Y.ks_test(other, "side", "x").first()["differ"] is True
    assert abs(Y.ks_threshold(2000.0, 2000.0) - 1.3581 * (1 / 1000) ** 0.5) < 1e-4


def test_markov_error_holds(spark):
    states = A.build(synthetic.exponential(spark, 5000, seed=1), [], F.col("x"), 2)
    for p, q in ((0.5, 0.69), (0.9, 2.3), (0.5, 3.0)):
        worst = states.select(M.markov_quantile_error(F.lit(q), p).alias("e")).first()["e"]
        assert abs(1 - math.exp(-q) - p) <= worst + 0.02 and worst <= 1


def test_inversions_agree(spark):
    states = A.build(synthetic.exponential(spark, 3000, seed=2), [], F.col("x"), 6)
    ps = (0.1, 0.5, 0.9, 1.0)
    got = states.select(M.inversion_quantiles(ps, 6).alias("all"), *[M.inversion_quantile(p, 6).alias(f"q{i}") for i, p in enumerate(ps)]).first()
    assert np.allclose(got["all"], [got[f"q{i}"] for i in range(4)])


def test_running_sums_and_samples(spark):
    df = synthetic.integers(spark, 500).withColumn("v", F.lit(1))
    assert all(r["upto_v"] == r["id"] + 1 for r in Y.running(df, "id", ["v"], 7).collect())
    assert sorted(r["id"] for r in E.every(df, "id", 100).collect()) == [0, 100, 200, 300, 400, 499]
    assert synthetic.repeated(df, 3).count() == 1500
    assert synthetic.with_outliers(df.select("id", "x"), "id", "x", 0.01, 0.1, 50.0).where("x >= 50 and id < 5").count() == 5


def test_rounding_to_ten_minutes_goes_to_even_marks(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:05:00' AS a, timestamp'2024-01-01 00:15:00' AS b, timestamp'2024-01-01 00:14:59' AS c")
    r = df.select(*[F.date_format(synthetic.nearest_ten_minutes(F.col(c)), "HH:mm") for c in "abc"]).first()
    assert tuple(r) == ("00:00", "00:20", "00:10")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('x,y,z\n1,"a,b",3\n4,c,6\n')
    (tmp_path / "g.csv").write_text('data\n"[1,2.5]"\n[3]\n')
    assert [r["x"] for r in readers.csv_column(spark, f"{tmp_path}/t.csv", 2).collect()] == [3.0, 6.0]
    assert readers.csv_column(spark, f"{tmp_path}/t.csv", 2, limit=1).count() == 1
    (tmp_path / "bare.csv").write_text("1,2\n4,5\n")
    assert [r["x"] for r in readers.csv_column(spark, f"{tmp_path}/bare.csv", 1, header=False).collect()] == [2.0, 5.0]
    assert [r["data"] for r in readers.grouped_csv(spark, f"{tmp_path}/g.csv").collect()] == [[1.0, 2.5], [3.0]]
    path = readers.write_results(spark.createDataFrame([("kll", 1)], "sketch string, n int"), f"{tmp_path}/out")
    assert readers.results(spark, [path, path]).count() == 2
    config = readers.RunConfig.parse('{"flag": true, "vals": [1.0, 2.0]}')
    assert config.get("flag") is True and config.get("none", 3) == 3
    with pytest.raises(KeyError):
        config.get("none")


def test_stream_states_equal_batch_states(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-01 {i % 24:02d}:00:00", float(i), "ab"[i % 2]) for i in range(200)], "id long, t string, x double, k string").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.running_states(stream, ["k"], F.col("x"), 3).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("running").collect()) == sorted(A.build(df, ["k"], F.col("x"), 3).collect())
    q = incremental.pane_states(stream, "ts", "1 hour", ["k"], F.col("x"), 2).writeStream.outputMode("append").format("memory").queryName("panes").start()
    q.processAllAvailable()
    q.stop()
    final = {(str(r["pane"]), r["k"], r["n"], r["p1"]) for r in spark.table("panes").collect()}
    assert final and final <= {(str(r["pane"]), r["k"], r["n"], r["p1"]) for r in A.panes(df, "ts", "1 hour", ["k"], F.col("x"), 2).collect()}


def test_sliding_threshold_reports_sparse_windows(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, f"2024-01-{1 + int(rng.integers(3)):02d} {int(rng.integers(24)):02d}:10:00", "rare" if i % 10 == 0 else "often" if i % 10 > 4 else "some", float(rng.exponential(30))) for i in range(160)]
    rows += [(900, "2024-02-01 00:00:00", "once", 99.0), (901, "2024-02-01 00:00:00", "low", 1.0), (902, "2024-02-01 00:00:00", "pair", 50.0), (903, "2024-02-01 00:00:00", "pair", 70.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {(str(r["pane"]), r["event_type"]): r for r in catalog.sliding(spark, str(tmp_path)).collect()}
    panes = {}
    for _, t, kind, value in rows:
        panes.setdefault(kind, {}).setdefault(t[:14] + "00:00", []).append(value)
    want = {}
    for kind, held in panes.items():
        order = sorted(held)
        for i, pane in enumerate(order):
            want[pane, kind] = [v for p in order[max(0, i - 5) : i + 1] for v in held[p]]
    assert set(got) == set(want) and all(got[k]["n"] == len(v) for k, v in want.items()) and min(map(len, want.values())) == 1
    for k, values in want.items():
        assert got[k]["above"] == (sum(v > 60 for v in values) / len(values) > 0.1), (k, values, got[k])
    assert {"count", "range"} <= {r["stage"] for r in got.values()}
    assert got["2024-02-01 00:00:00", "once"]["above"] and not got["2024-02-01 00:00:00", "low"]["above"]


@pytest.mark.parametrize("sent", [10, 0])
def test_rank_errors_send_no_rows_of_the_data(spark, tmp_path, monkeypatch, sent):
    """Rows that a small file hides, exploded, met by estimates of few groups and of more than are sent."""
    monkeypatch.setattr(Q, "SENT", sent)
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select((F.col("id") % 1000 / 10).alias("x"), F.explode(F.array(F.lit(1), F.lit(None).cast("int"))).alias("g"))
    estimates = spark.createDataFrame([(1, 0.5, 50.0), (None, 0.5, 40.0)], "g int, p double, q double")
    errors = Q.rank_errors(df, ["g"], "x", estimates, [0.5])
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == bool(sent)
    assert sorted((r.g or 0, r.n, round(r.rank_error, 6)) for r in errors.collect()) == [(0, 1000, 0.099), (1, 1000, 0.0)]


@pytest.mark.parametrize(("gathered", "held"), [(7, 10_000), (7, 0), (200_000, 10_000)])
def test_reservoirs_shuffle_what_tasks_leave(spark, monkeypatch, gathered, held):
    """Null keys and values, repeated rows, equal ids; the k least rows come out, and few go to the shuffle."""
    monkeypatch.setattr(Y, "GATHERED", gathered)
    monkeypatch.setattr(Y, "HELD", held)
    rows = [(i % 3 or None, "ab"[i % 2], 2**60 + i // 2, None if i % 7 == 0 else float(i % 11)) for i in range(3000)] + [(1, "a", 5, 1.0)] * 50
    df = spark.createDataFrame(rows, "g long, h string, id long, x double").repartition(3)
    want = {}
    for r in df.select("g", "h", "x", F.xxhash64(F.lit(42), "id").alias("priority")).collect():
        want.setdefault((r.g, r.h), []).append((r.priority, r.x is not None, r.x or 0.0))
    got = {}
    for r in Y.reservoir(df, ["g", "h"], "id", "x", 20).collect():
        got.setdefault((r.g, r.h), []).append((r.priority, r.x is not None, r.x or 0.0))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:20] for k, v in want.items()}
    left = Y.least_of_tasks(df.select("g", "h", "x", F.xxhash64(F.lit(42), "id").alias("priority")), ["g", "h"], 20).count()
    assert left <= 3 * 6 * 20 if held else left <= 3050
    assert Y.reservoir(df, [], "id", "x", 20).count() == 20
    assert Y.reservoir(df.where("id < 0"), ["g"], "id", "x", 20).count() == 0
