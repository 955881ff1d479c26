import math
import re
import zlib
from collections import Counter

import numpy as np

from sketchwell.llm import gru, lm


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def brute(rows):
    train = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    return n, {d: (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


def test_base_equals_brute_force_and_the_network_beats_it(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    n, want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    monkeypatch.setattr(lm, "LISTED", 3000)
    rows = lm.op7_lm(spark, sf).collect()
    assert len(rows) == len(want) and {r["train_tokens"] for r in rows} == {n}
    for r in rows:
        k, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (k, known) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    held = [r for r in rows if r["held_out"]]
    ours, base = (sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("score", "base_score"))
    print("log10 a token, held out:", ours, "base", base)
    assert ours > base + 0.02


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    flat = gru.initial(rng.integers(1, 50, gru.SYMBOLS)).astype("float64")
    texts = [rng.integers(0, gru.SYMBOLS, n).astype("int16") for n in (5, 3, 9, 1)]
    inputs, targets, starts, _ = gru.lanes(texts, 2, 7)
    h = np.zeros((2, gru.HIDDEN))
    loss = lambda x: gru.window_gradient(gru.views(x), inputs, targets, starts, h)[0]
    g = gru.window_gradient(gru.views(flat), inputs, targets, starts, h)[1]
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-5), 25):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        slope = (loss(flat + e) - loss(flat - e)) / 2e-5
        assert abs(slope - g[i]) < 1e-6 + 1e-4 * abs(slope)


def test_gates_lie_apart_and_states_equal_a_plain_recurrence():
    rng = np.random.default_rng(2)
    p = gru.views(rng.standard_normal(gru.SIZE) * 0.3)
    given, h, H = rng.integers(0, gru.SYMBOLS, (6, 5)), rng.standard_normal((5, gru.HIDDEN)), gru.HIDDEN
    starts = rng.random((6, 5)) < 0.3
    kept = {}
    states = gru._run(p, given, starts, h, kept)
    assert kept["zr"].shape == (6, 2, 5, H)
    for t in range(6):
        h = np.where(starts[t][:, None], 0, h)
        x, y = p["emb"][given[t]] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = (1 / (1 + np.exp(-x[:, k : k + H] - y[:, k : k + H])) for k in (0, H))
        h = z * h + (1 - z) * np.tanh(x[:, 2 * H :] + r * y[:, 2 * H :])
        assert np.allclose(states[t], h) and np.allclose(kept["zr"][t], [z, r])


def test_symbols_of_a_text_sum_to_one_and_lanes_do_not_matter():
    rng = np.random.default_rng(1)
    flat = gru.initial(rng.integers(1, 50, gru.SYMBOLS))
    texts = [rng.integers(0, gru.SYMBOLS, n).astype("int16") for n in (70, 3, 200, 1, 64)]
    whole = gru.score(flat, texts, 7)
    assert np.allclose(whole, [gru.score(flat, [t], 7, window=13)[0] for t in texts], rtol=1e-4)
    next_ = [gru.score(flat, [np.array([5, s], "int16")], 7)[0] for s in range(gru.SYMBOLS)]
    assert abs(np.exp(np.array(next_) - gru.score(flat, [np.array([5], "int16")], 7)[0]).sum() - 1) < 1e-3


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, n_tokens string, score int"
    data = [(1, None, "x", 1), (2, "", None, 2), (None, "A b", "x", 3), (3, "c d " * 300, "x", 4), (3, "c d " * 300, "x", 4)]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = lm.op7_lm(spark, f"{tmp_path}/full").collect()
    n, want = brute([(d, t) for d, t, *_ in data])
    assert len(rows) == 5
    for r in rows:
        k, known, base = want[r["doc_id"]]
        assert (r["train_tokens"], r["n_tokens"], r["n_known"]) == (n, k, known) and abs(r["base_score"] - base) < 1e-6
    assert lm.op7_lm(spark, f"{tmp_path}/none").count() == 0


def test_symbols_counts_and_network_come_from_every_training_text(spark, monkeypatch):
    rows = [(i, f"w{i % 40} w{i % 7} pair{i // 2}") for i in range(1500)]
    rows = [(i, t if i % 5 != 1 else "held " * 50) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, train_network = {}, lm.train_network

    def trained(texts, lists, start):
        seen.update(texts=texts.count(), lists=lists.value, start=start)
        return train_network(texts, lists, start)

    monkeypatch.setattr(lm, "train_network", trained)
    assert lm.score(df, df["doc_id"] % 5 != 1).count() == 1500
    train = [t for i, t in rows if i % 5 != 1]
    counts = Counter(w.encode() for t in train for w in t.split())
    words, symbols = seen["lists"]
    assert seen["texts"] == len(train) and b"held" in words and b"held" not in symbols
    assert symbols == sorted(counts, key=lambda w: (-counts[w], w))[: lm.END]
    share = np.exp(gru.views(seen["start"])["bc"].astype(float))
    want = np.array([counts[w] for w in symbols] + [0] * (lm.END - len(symbols)) + [len(train)] + [sum(n for w, n in counts.items() if w not in symbols and lm.tail_of(w) == t) for t in range(lm.TAILS)]) + 0.5
    assert np.allclose(share, want.reshape(gru.CLASSES, -1).sum(axis=1) / want.sum(), rtol=1e-3)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 97} and" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "w1 and"), (7, "w2 and w3")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score(df, df["doc_id"] != 2).collect()}
    assert rows[1]["n_tokens"] == 120_001 and math.isfinite(rows[1]["score"]) and rows[1]["score"] < 0 and rows[7]["score"] < 0


def test_least_counts_bound_the_lists(spark):
    rng = np.random.default_rng(3)
    counts = [int(c) for c in np.floor(rng.pareto(0.7, 4000) * 3)]
    df = spark.createDataFrame([(c,) for c in counts], "c long")
    for n in (1, 10, 300, 5000):
        least, most = lm._least(df, "c", n, True), lm._least(df, "c", n, False)
        assert sum(c >= least for c in counts) >= min(n, sum(c > 0 for c in counts)) and sum(c >= most for c in counts) <= n
    assert lm._least(df.limit(0), "c", 5, True) == lm._least(df.limit(0), "c", 5, False) == 2**62
