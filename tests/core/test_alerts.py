import random

from pyspark.sql import functions as F

from sketchwell.streaming import alerts as N


def brute(rows, t, share, width, panes, until):
    """Crossings of (key, second, value) rows whose panes end by `until`."""
    by = {}
    for k, s, v in rows:
        if v is not None:
            by.setdefault(k, {}).setdefault(s // width * width, []).append(v)
    out = []
    for k, found in by.items():
        before, starts = False, sorted(found)
        for i, p in enumerate(starts):
            window = [v for q in starts[max(0, i - panes + 1) : i + 1] for v in found[q]]
            above = sum(v > t for v in window) / len(window) > share
            if p + width <= until:
                if above != before:
                    out.append((k, p, len(window), above))
                before = above
    return sorted(out, key=str)


def test_stream_started_again_goes_on_where_it_was(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for s in range(0, 6000, 7):
        k = rng.choice(["a", "a", "b", None])
        hot = (s // 700) % 2
        rows.append((k, s, rng.choice([None, 1.0, 2.0, 90.0, 95.0] if hot else [1.0, 2.0, 3.0, 4.0, 70.0, 2.0])))
    data, folder = str(tmp_path / "data"), str(tmp_path / "alerts")
    schema = "key string, s long, value double"

    def arrive(part):
        df = spark.createDataFrame(part, schema)
        df.select("key", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(data)

    def run():
        like = spark.read.parquet(data)
        found = N.alert_once(N.stream_of(spark, data, like), folder, "ts", "60 seconds", "key", F.col("value"), 60.0, 0.3, 4, late="30 seconds")
        return sorted(((r["key"], int(r["pane"].timestamp()), r["n"], r["above"]) for r in found.collect()), key=str)

    cut = len(rows) // 2
    arrive(rows[:cut])
    first = run()
    assert first == brute(rows[:cut], 60.0, 0.3, 60, 4, rows[cut - 1][1] - 30)
    assert run() == first
    arrive(rows[cut:])
    second = run()
    assert second == brute(rows, 60.0, 0.3, 60, 4, rows[-1][1] - 30) and len(second) > len(first) > 3


def test_windows_are_decided_by_the_cheapest_step():
    pane = lambda values: (min(values), max(values), sum(v > 5 for v in values), *[float(sum(v**i for v in values)) for i in range(N.ORDER + 1)])
    low, mixed = pane([1.0, 2.0, 3.0]), pane([1.0] * 95 + [9.0] * 5)
    assert N.decide([low], 5.0, 0.1) == (False, "range") and N.decide([low], 0.5, 0.1) == (True, "range")
    assert N.decide([mixed], 5.0, 0.5)[0] is False
    assert N.decide([mixed], 5.0, 0.04)[0] is True and N.decide([mixed], 5.0, 0.06)[0] is False
