import zlib

import numpy as np

from sketchwell.llm import toxicity


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    y, s = np.array([labels[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows])
    hits = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    print("area under curve", hits, "found", (s[y == 1] >= 0.5).mean(), "false", (s[y == 0] >= 0.5).mean())
    assert hits > 0.9


def test_odd_rows(spark, tmp_path):
    schema, label = "doc_id long, text string, score string", "doc_id long, toxic int, quality int"
    rows = [(1, None, "x"), (2, "", None), (None, "a b", "x"), (3, "c d " * 30, "x"), (3, "c d " * 30, "x")]
    for part, data, marks in (("full", rows, [(1, None, 1), (None, 1, 1), (3, 1, 1), (3, 0, 1)]), ("none", [], [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        spark.createDataFrame(marks, label).write.parquet(f"{tmp_path}/{part}/labels.parquet")
    got = toxicity.op4_toxicity(spark, f"{tmp_path}/full").collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.op4_toxicity(spark, f"{tmp_path}/none").count() == 0


def test_distance_is_of_the_toxic_words():
    distance = toxicity.Distance(b"and the other words in this text " * 20, [b"zanthquip"])
    assert distance.features("and the zanthquip in")[0] > distance.features("and the other words") [0] == 0
    assert distance.features(None) == [0, 0, 0]


def test_query_equals_brute_force(spark):
    import zstandard as Z

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    content, words, weights, _ = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
    assert words
    code = lambda data: b"".join(bytes([c, (c * 37 + 11) % 251, (c * 91 + 7) % 253]) for c in data)
    grams = {w[i : i + 4] for w in words for i in range(len(w) - 3)}
    how = Z.ZstdCompressionParameters(window_log=19, chain_log=18, hash_log=18, search_log=5, min_match=5, target_length=64, strategy=Z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = [Z.ZstdCompressor(dict_data=Z.ZstdCompressionDict(x, dict_type=Z.DICT_TYPE_RAWCONTENT), compression_params=how) for x in (code(content), code(b" " + b" ".join(words) + b" ") + code(content))]
    known = {}

    def distance(w):
        if w not in known:
            ordinary, toxic = (len(h.compress(code(b" " + w + b" "))) for h in held)
            known[w] = max(0, ordinary - toxic) if any(w[i : i + 4] in grams for i in range(len(w) - 3)) else 0
        return known[w]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op4_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted((distance(w) for w in (texts[r["doc_id"]] or "").encode().lower().split()), reverse=True) or [0]
        x = [found[0], sum(found[:3]), 100 * sum(found) / len(found)]
        want = 1 / (1 + np.exp(-(np.dot(weights[:-1], x) + weights[-1])))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.5)


def test_ties_and_very_long_texts():
    distance = toxicity.Distance(b"and the other words in this text " * 20, [b"zanthquip"])
    word = distance.features("zanthquip")[0]
    long = distance.features("and the other words " * 100_000 + "zanthquip " * 3)
    assert word > 0 and long[:2] == [word, 3 * word] and abs(long[2] - 100 * 3 * word / 400_003) < 1e-9
    assert distance.features("zanthquip and") == distance.features("and zanthquip")
