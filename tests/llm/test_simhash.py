import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sketchwell.llm import simhash


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(["A", "b", "É", " ", "\n", "cd", " "]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(text) & (2**64 - 1) == slow(text), repr(text)
    assert simhash.fingerprint(None) == 0


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], zip(fps, grouped([r["doc_id"] for r in rows], fps), strict=True), strict=True))
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op9_simhash(spark, sf).collect()}
    assert got == want and any(d != c for d, (_, c) in got.items())


def test_crowded_fingerprints_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.integers(-(2**63), 2**63 - 1, 4)
    fps = sorted({int(np.int64(c) ^ np.int64(sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 6), replace=False)))) for c in centers for _ in range(90)})
    ids = [int(i) for i in rng.permutation(len(fps))]
    df = spark.createDataFrame(list(zip(ids, fps, strict=True)), "doc_id long, fp long")
    want = dict(zip(ids, grouped(ids, fps), strict=True))
    for paired, of in ((3, 4), (24, 4), (3, 6), (24, 6), (3, 8)):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        monkeypatch.setattr(simhash, "blocks_for", lambda n, of=of: of)
        got = {r["doc_id"]: r["component_id"] for r in simhash.group(df).collect()}
        assert got == want, (paired, of)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**9, 2**32, 2**32 + 1, 2**42, 2**42 + 1, 2**60)] == [4, 4, 4, 6, 6, 8, 8]
    for of in simhash.BLOCKS:
        assert [i for b in range(of) for i in simhash._bits(b, of)] == list(range(64))
    assert [len(simhash.choices(of)) for of in simhash.BLOCKS] == [6, 15, 28]


def test_many_copies_of_one_row(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).unionByName(spark.createDataFrame([(4, "a text of its own that no other row has"), (4, "")], "doc_id long, text string"))
    assert sorted(map(tuple, simhash.keep_one(rows.repartition(8)).collect())) == [(4, ""), (4, "a text of its own that no other row has")]


def test_pivot_distances_keep_every_link(spark):
    rng = np.random.default_rng(9)
    pairs = []
    for _ in range(300):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        b = a
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b = int(np.int64(b) ^ np.int64(np.uint64(1) << np.uint64(bit)))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("s", simhash.distances(F.col("a"))).withColumn("t", simhash.distances(F.col("b")))
    count = lambda x: bin(x & (2**64 - 1)).count("1")
    far = 0
    for r in df.withColumn("may", simhash.may_link(F.col("s"), F.col("t"))).collect():
        block = lambda x, i: (x >> 16 * i) & 0xFFFF
        assert [list(x) for x in r["s"]] == [[count(block(r["a"] ^ p, i)) for p in simhash.PIVOTS] for i in range(4)]
        want = max(abs(count(r["a"] ^ p) - count(r["b"] ^ p)) for p in simhash.PIVOTS) <= 2
        assert r["may"] == want and (want or count(r["a"] ^ r["b"]) > 2)
        far += not want
    assert far > 100


def test_pivot_distances_tell_blocks_apart():
    table = np.array([[bin(x ^ (p & 0xFFFF)).count("1") for p in simhash.PIVOTS] for x in range(1 << 16)], "i1")
    assert len(np.unique(table, axis=0)) > 0.7 * 2**16


def test_crowded_keys_are_looked_up_all_the_same(spark, monkeypatch):
    left = spark.createDataFrame([(i, 7 if i % 3 else i if i % 2 else None) for i in range(200)], "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 200, 7)], "k long, v string")
    one = sorted(map(tuple, simhash.looked_up(left, F.col("k"), right, "k", "v").collect()), key=str)
    monkeypatch.setattr(simhash, "LEAST_HEAVY", 5)
    two = sorted(map(tuple, simhash.looked_up(left, F.col("k"), right, "k", "v").collect()), key=str)
    assert one == two and len(one) == 200 and sum(r[2] == "v7" for r in one) == 133


def test_very_long_text():
    words = [f"w{i * 7919 % 50_000}" for i in range(40_000)]
    assert simhash.fingerprint(" ".join(words)) & (2**64 - 1) == slow(" ".join(words)) != slow(" ".join(words[:20_000]))


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, fp string, component_id int"
    long = "a long text of some words that stays the same here "
    rows = [(5, None, "x", 1), (2, "", None, 2), (None, " ", "x", 3), (None, "one of a kind", "x", 3), (7, long, "", 4), (3, long, "", 4), (3, long, "", 4), (9, long.upper(), "", 4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in simhash.op9_simhash(spark, f"{tmp_path}/full").collect()), key=str)
    assert got == sorted([("5", 2), ("2", 2), ("None", 2), ("None", None), ("7", 3), ("3", 3), ("3", 3), ("9", 3)], key=str)
    assert simhash.op9_simhash(spark, f"{tmp_path}/none").count() == 0
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/full/documents.parquet"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert kept.columns == ["doc_id", "text", "fp", "component_id"] and kept.where(F.col("text").isNull()).count() == 0


def test_one_document_of_each_group_stays(spark, monkeypatch):
    monkeypatch.setattr(simhash, "with_fingerprint", lambda df: df.withColumn("fp", F.col("text").cast("long")))
    # texts are their fingerprints: id 1 names two groups, and three without ids are linked
    rows = [(1, "0"), (4, "1"), (1, "65280"), (6, "65281"), (None, "280375465082880"), (None, "280375465082881"), (None, "280375465082883"), (8, "-1"), (8, "-1")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "0"), (1, "65280"), (None, "280375465082880"), (8, "-1")], key=str)
