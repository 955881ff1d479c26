import hashlib
import random
import zlib

import numpy as np
import pytest

from sketchwell.llm import trie

from .oracle import same

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string, shard long"


def brute(rows):
    """The nodes of rows (conv_id, turn, role, text), by plain lists of turns."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        if c is None or c % 5 == 0:
            whole[c] = tuple(own)
        else:
            h = zlib.crc32(str(c).encode()) % 9
            whole[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += own
    out = []
    for k, v in members.items():
        ends = sorted((c is not None, c or 0) for c in v if len(whole[c]) == len(k))
        text = ",".join(str(c) if there else "" for there, c in ends)
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(rng, n_convs, deep, texts):
    """Turns of conversations that share first turns and copies, with null and repeated turns."""
    rows = []
    for c in range(n_convs):
        kind = rng.random()
        base = [("user", "hot start"), ("bot", "É")] if kind < 0.5 else []
        if kind < 0.15:
            turns = [("user", "copy"), ("bot", "same"), ("user", None)]
        else:
            turns = base + [(rng.choice(["user", "bot", None]), rng.choice(texts)) for _ in range(rng.randint(1, deep))]
        c = rng.choice([c, c, c, None]) if rng.random() < 0.05 else c
        rows += [(c, rng.choice([None, 3]) if rng.random() < 0.05 else i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("seed", "shard", "places", "chunk"), [(1, 100_000, 1024, 4096), (2, 12, 4, 3), (3, 40, 7, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shard, places, chunk):
    for name, value in (("SHARD_NODES", shard), ("PLACES", places), ("TURNS", places), ("CHUNK", chunk)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(seed)
    rows = some(rng, 120, 12, ["a", "b", "cc", None])
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA).repartition(5)
    assert found(trie.trie(df)) == brute(rows)


def test_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", 200)
    rows = [(5, i, "user", f"t{i % 7}") for i in range(700)] + [(10, i, "user", f"t{i % 7}") for i in range(650)] + [(6, 0, "user", "only")]
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA)
    assert found(trie.trie(df)) == brute(rows)


def test_louds_of_a_small_forest():
    # two tops, of which the second has two children and one grandchild
    node, parent = [(5, 0), (1, 0), (7, 0), (3, 0), (9, 0)], [(0, 0), (0, 0), (5, 0), (5, 0), (3, 0)]
    louds, order = trie.build(np.array([0, 0, 1, 1, 2]), node, parent)
    assert list(louds.labels) == [1, 5, 3, 7, 9] and list(order) == [1, 0, 3, 2, 4]
    assert "".join(map(str, louds.bits)) == "110" + "0" + "110" + "10" + "0" + "0"
    assert list(louds.parents()) == [-1, -1, 1, 1, 2] and list(louds.degrees()) == [0, 2, 1, 0, 0]
    assert [(s.start, s.stop) for s in louds.levels()] == [(0, 2), (2, 4), (4, 5)]
    assert list(louds.rollup(np.array([1, 10, 100, 1000, 10_000]))) == [1, 11_110, 10_100, 1000, 10_000]


def test_query_equals_sql_and_brute_force(spark, sf):
    assert same(spark, trie.op12_trie, trie.ORACLE_SQL, sf) > 30
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.op12_trie(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    long = "x" * 3_000_000
    rows = [(1, 0, "user", long), (2, 0, "user", "y"), (None, 0, None, long), (None, None, None, None), (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, "a", "a"), (0, 0, "user", long)]
    assert found(trie.trie(spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA))) == brute(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(None, 2, "a", "b")]
    assert found(trie.trie(spark.createDataFrame([(*r, 1, "x", 5) for r in only], SCHEMA))) == brute(only)
    lost = [(next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1), 0, "a", "b")]
    assert found(trie.trie(spark.createDataFrame([(*r, 1, "x", 5) for r in lost], SCHEMA))) == brute(lost) and len(brute(lost)) == 1
