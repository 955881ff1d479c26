import os

from pyspark.sql import functions as F

from sketchwell.operators import states as A
from sketchwell.operators import store as R


def rows(spark, days, hours=24, step=1):
    df = spark.range(days * hours * 4).withColumn("ts", F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") * 900))
    return df.withColumn("k", F.concat(F.lit("k"), F.col("id") % 3)).withColumn("x", (F.col("id") * 7 % 50).cast("double"))


def files(path):
    return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("day=")}


def test_late_rows_rewrite_only_their_days(spark, tmp_path):
    path = str(tmp_path / "states")
    df = rows(spark, 6)
    late = (F.to_date("ts") == F.lit("2023-11-17").cast("date")) & (F.col("id") % 5 == 0)
    states = lambda d: R.paned(d, "ts", "1 hour", ["k"], F.col("x"), 3)
    R.create(states(df.where(~late)), path)
    before = files(path)
    assert len(before) == 6
    touched = R.refresh(spark, path, states(df.where(late)), ["k"])
    after = files(path)
    assert [str(d) for d in touched] == ["2023-11-17"]
    assert {d for d in before if before[d] != after[d]} == {"day=2023-11-17"}
    want = sorted(A.build(df.where(F.to_date("ts").between(F.lit("2023-11-16"), F.lit("2023-11-18"))), ["k"], F.col("x"), 3).collect())
    rolled = R.rolled_up(spark, path, "2023-11-16", "2023-11-18", ["k"])
    assert sorted(rolled.collect()) == want
    plan = rolled._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2023-11-16" in plan
    assert sorted(R.rolled_up(spark, path, "2000-01-01", "2100-01-01", []).collect()) == sorted(A.build(df, [], F.col("x"), 3).collect())


def test_new_days_and_nothing_new(spark, tmp_path):
    path = str(tmp_path / "states")
    df = rows(spark, 3)
    states = lambda d: R.paned(d, "ts", "1 hour", ["k"], F.col("x"), 2)
    R.create(states(df.where("id < 96")), path)
    assert R.refresh(spark, path, states(df.where("id < 0")), ["k"]) == []
    assert len(R.refresh(spark, path, states(df.where("id >= 96")), ["k"])) == 2
    assert sorted(R.rolled_up(spark, path, "2000-01-01", "2100-01-01", ["k"]).collect()) == sorted(A.build(df, ["k"], F.col("x"), 2).collect())
