import hashlib
import random

from pyspark.sql import functions as F

from sketchwell.llm import fingerprints


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(8)
    rows = []
    for n in [0, 0, 1, 1, 2, 3, 5, 8, 20, 60, 400]:
        shared = [rng.getrandbits(63) for _ in range(n)]
        a = shared + [rng.getrandbits(63) for _ in range(rng.randint(0, n + 2))]
        b = shared + [-rng.getrandbits(63) for _ in range(rng.randint(0, n + 2))]
        rows.append((a, b))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<long>, b array<long>")
    e = F.explode(fingerprints.dealt(1, F.col("a"), F.col("b"))).alias("e")
    found = fingerprints.recovered(df.select("i", e, F.lit(None).cast("int").alias("kept")), ["i"])
    got = {}
    for r in found.collect():
        got.setdefault(r["i"], []).extend((x["c"], x["k"]) for x in r["found"])
    for i, (a, b) in enumerate(rows):
        d = got.get(i, [])
        assert set(d) == {(1, k) for k in set(a) - set(b)} | {(-1, k) for k in set(b) - set(a)} and len(d) == len(set(a) ^ set(b))
    assert found.where("i = 10").count() > 20


def test_a_section_that_fails_is_compared_by_its_digests(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "WIDTHS", (1,))
    df = spark.createDataFrame([([1, 2, 3, 9], [3, 4])], "a array<long>, b array<long>")
    found = df.select(fingerprints.difference(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert sorted((x["c"], x["k"]) for x in found) == [(-1, 4), (1, 1), (1, 2), (1, 9)]


def test_written_fingerprints_subtract(spark):
    rng = random.Random(4)
    a = [rng.getrandbits(64) - 2**63 for _ in range(50)]
    b = a[3:] + [5, -6]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    table = lambda c: fingerprints.text_of(fingerprints.of_digests(F.col(c), fingerprints.FINGERPRINT))
    written = df.select(table("a").alias("a"), table("b").alias("b"))
    left = fingerprints.subtract(fingerprints.cells_of(F.col("a")), fingerprints.cells_of(F.col("b")))
    found = written.select(fingerprints.peel(left, F.lit(fingerprints.FINGERPRINT - 1)).alias("d")).first()["d"]
    assert {(x["c"], x["k"]) for x in found} == {(1, k) for k in a[:3]} | {(-1, 5), (-1, -6)}


def test_small_tables_fail_and_larger_ones_succeed(spark):
    rng = random.Random(9)
    keys = [rng.getrandbits(62) for _ in range(60)]
    df = spark.createDataFrame([(keys,)], "a array<long>")
    none = F.expr("cast(array() as array<bigint>)")
    placed = lambda c, m: fingerprints.of_digests(c, m + 1)
    tried = lambda m: fingerprints.peel(fingerprints.subtract(placed(F.col("a"), m), placed(none, m)), m)
    sizes = [df.select(tried(F.lit(w - 1)).alias("d")).first()["d"] for w in (8, 64)]
    assert sizes[0] is None and {x["k"] for x in sizes[1]} == set(keys)


def brute(rows):
    """doc_id -> n_chars, sha of the edited text, likenesses."""
    import re

    rows = sorted(rows)
    parts = lambda t: {p for p in re.split(r"\n|(?<=\.) ", t) if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(parts(text), parts(edited)), like(parts(text), parts(after)))
    return out


def test_query_equals_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = brute([(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    for size in (1_000, 10):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
        rows = fingerprints.op2_fingerprints(spark, sf).collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == {k: v[:2] for k, v in want.items()}
        for r in rows:
            assert abs(r["near_edited"] - want[r["doc_id"]][2]) < 1e-9 and abs(r["near_next"] - want[r["doc_id"]][3]) < 1e-9
        assert len({r["fingerprint"] for r in rows}) > 100


def test_next_over_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rng = random.Random(3)
    ids = sorted({rng.choice([rng.randint(-50, 50), rng.randint(-(2**62), 2**62)]) for _ in range(120)})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_ids_that_many_rows_have_are_cut_by_the_hash(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rng = random.Random(5)
    ids = [None] * 150 + [7] * 200 + [9] + [rng.randint(-100, 100) for _ in range(40)]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    rows = df.collect()
    order = sorted(rows, key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["_tie"]))
    got = fingerprints.with_next(df, "doc_id", ["text"])
    assert {r["text"]: r["next_text"] for r in got.collect()} == {r["text"]: order[(k + 1) % len(order)]["text"] for k, r in enumerate(order)}
    assert got.groupBy("_range").count().agg(F.max("count")).first()[0] < 40


def test_very_long_text(spark):
    a = "\n".join(f"line {i}" for i in range(30_000))
    b = a.replace("line 777\n", "other\n")
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.compare(fingerprints.versions(df)).collect()}
    want = brute([(1, a), (2, b)])
    for k in (1, 2):
        assert (rows[k]["n_chars"], rows[k]["edited_sha256"]) == want[k][:2]
        assert abs(rows[k]["near_edited"] - want[k][2]) < 1e-9 and abs(rows[k]["near_next"] - want[k][3]) < 1e-9


def test_no_filter_makes_the_tables_once_more(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id long, text string")
    plan = fingerprints.compare(fingerprints.versions(df))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not [line for line in filters if "size(" in line or "xxhash64" in line]


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, digests string, next_text int"
    data = [(1, None, "x", 1), (None, "Null id.", None, 2), (3, "One. Two.\nThree.", "x", 1), (3, "One. Two.\nThree.", "x", 1), (9, "", "x", 1)]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame(data[2:3], schema).write.parquet(f"{tmp_path}/one/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = fingerprints.op2_fingerprints(spark, f"{tmp_path}/full").collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == [("1", 0), ("3", 16), ("3", 16), ("9", 0), ("None", 8)]
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[9]["fingerprint"] and by[1]["near_edited"] == 1.0
    assert by[9]["near_next"] == 0.0 and {round(r["near_next"], 3) for r in rows if r["doc_id"] == 3} == {0.0, 1.0}
    one = fingerprints.op2_fingerprints(spark, f"{tmp_path}/one").first()
    assert one["near_next"] == 1.0
    assert fingerprints.op2_fingerprints(spark, f"{tmp_path}/none").count() == 0
