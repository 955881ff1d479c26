import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchwell.llm import minhash

from .oracle import same


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """(id, size, component) of docs (id, text), from all pairs of full sets."""
    sets = [slow_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in at[x]:
                met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if j < i and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sets_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["A", "b", "É", " ", "\n", "cd", " "]) for _ in range(rng.randint(0, 60)))
        assert len(minhash.shingles(text)) == len(slow_set(text)), repr(text)
    assert len(minhash.shingles(None)) == 0
    assert list(minhash.shingles("A b C")) == list(minhash.shingles("a\nB  c")) != list(minhash.shingles("a b"))


def test_signature_is_two_permutations_one_shifted():
    spread, slices = minhash._permutations()
    values = slices[: minhash.UNIVERSE, 0]
    assert sorted(spread[:0]) == [] and len(np.unique(spread)) == len(np.unique(values)) == minhash.UNIVERSE
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype("u8"))
    hashes[0] = np.uint64(int(np.where(spread == minhash.UNIVERSE - 1)[0][0]))  # the last place, whose slice wraps round
    got = minhash.signature(hashes)
    places = spread[(hashes % minhash.UNIVERSE).astype("i8")].astype("i8")
    for k in (0, 1, 7, minhash.COORDINATES - 1):
        assert got[k] == np.roll(values, -k)[places].min()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 400).astype("u8")
        a, b = np.unique(pool[:300]), np.unique(pool[100:])
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.op11_minhash(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got.drop("kept")) == brute(docs)
    assert same(spark, minhash.op11_minhash, minhash.ORACLE_SQL, sf) == 200
    assert got.where("kept != (doc_id = component_id)").count() == 0 and got.where("not kept").count() > 5


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("paired", "nodes", "columns"), [(2, 20, 64), (16, 400, 4096)])
def test_crowded_keys_lose_no_link(spark, monkeypatch, paired, nodes, columns):
    """Groups around centres whose members often link only with some others, chains, and near misses."""
    for name, value in (("PAIRED", paired), ("BLOCK_NODES", nodes), ("COLUMNS", columns)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(paired)
    texts = []
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(120)]
        texts += [edited(rng, words, rng.choice([0, 1, 1, 2, 2, 3, 4])) for _ in range(60)]
    chain = [f"k{i}" for i in range(200)]
    for i in range(0, 60, 2):
        texts.append(" ".join(chain[i : i + 120]))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = found(minhash.group(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute(docs)
    assert got == want and len({c for _, _, c in want}) > 8


def test_links_are_fewer_than_components():
    """Six like sets under two pivots take one link; without pivots five."""
    like = [np.append(np.arange(100), 1000 + i) for i in range(6)] + [np.arange(5000, 5100)]
    names = [bytes([i]) for i in range(7)]
    assert len(minhash.joining_links(names, [names[0]] * 3 + [names[3]] * 3 + [names[6]], like)) == 1
    assert len(minhash.joining_links(names, names, like)) == 5


def test_each_link_is_followed_once(spark, monkeypatch):
    """Near copies that share many keys, none of which is small."""
    monkeypatch.setattr(minhash, "PAIRED", 2)
    seen = []
    components = minhash.components
    monkeypatch.setattr(minhash, "components", lambda ranks, edges: seen.append(edges) or components(ranks, edges))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    docs = list(enumerate(edited(rng, words, rng.choice([0, 1, 2, 3, 4])) for _ in range(80)))
    assert found(minhash.group(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    links = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in seen[0].collect()]
    assert len(links) == len(set(links)) > 20


def test_threshold_is_exact(spark):
    """Sets of 90 and 100 - k, on both sides of 85 per cent."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    docs = [(0, " ".join(base))] + [(n, " ".join(base[:n + 4])) for n in (84, 85, 86)]
    got = {d: c for d, _, c in found(minhash.group(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[85] == 0 and got[86] == 0 and got[84] == 0  # 84 links with 85 and 86
    alone = found(minhash.group(spark.createDataFrame([docs[0], docs[1]], "doc_id long, text string")))
    assert alone == [(0, 100, 0), (84, 84, 84)]
    assert found(minhash.group(spark.createDataFrame([docs[0], docs[2]], "doc_id long, text string"))) == [(0, 100, 0), (85, 85, 0)]


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i * 7919 % 50_000}" for i in range(60_000))
    schema = "doc_id long, text string, fp string, keys int, n_shingles string, component_id int"
    rows = [(5, None), (2, ""), (None, " \n"), (None, "one of a kind"), (7, "a b c d e f g"), (3, "A b c d e f g"), (3, "a b c d e f g"), (None, "a  b c d e f g"), (9, long), (8, long + " end"), (11, "short"), (10, "Short")]
    spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    got = minhash.op11_minhash(spark, f"{tmp_path}/full")
    assert found(got.drop("kept")) == brute(rows)
    kept = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in got.where(F.col("n_shingles") != 3).collect()}
    assert kept[(None, 1)] and kept[(5, 0)] and kept[(8, 50_001)] and not kept[(9, 50_000)]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert minhash.op11_minhash(spark, f"{tmp_path}/none").count() == 0
    only = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert found(minhash.group(only)) == [(1, 0, 1), (1, 0, 1)]
