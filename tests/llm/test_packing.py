import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sketchwell.llm import packing


def test_encoder_equals_the_tokenizer():
    encode, rng = packing.Encoder(), random.Random(1)
    parts = ["a", "b", "'s", " ", "\n", " ", "é", "1", ".", "!", "\t", " ", "\x1c", "\x85", "　", "don't", "<|endoftext|>"]
    for _ in range(5000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(x) == np.array(encode.whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_patterns_hold_every_item_and_few_gaps():
    rng = random.Random(2)
    for _ in range(200):
        histogram = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
        held = Counter()
        for count, contents in packing.patterns(histogram):
            assert sum(contents) <= 1024
            assert sum(n > 1024 / 3 for n in contents) <= 2 or min(contents) > 0
            for n in contents:
                held[n] += count
        assert held == Counter(histogram)
    small = {n: 40 for n in range(1, 700)}
    bins = sum(c for c, _ in packing.patterns(small))
    assert bins <= 1.02 * sum(n * c for n, c in small.items()) / 1024


def check(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_query_against_brute_force(spark, sf):
    rows = packing.op10_packing(spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used = check(rows, texts)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, length string, offset int"
    rows = [(1, None, "x", 1), (2, "", None, 2), (None, "a b", "x", 3), (3, "c d " * 3000, "x", 4), (3, "c d " * 3000, "x", 4)] + [(9, "same text", "", 0)] * 300
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    check(packing.op10_packing(spark, f"{tmp_path}/full").collect(), [r[:2] for r in rows])
    assert packing.op10_packing(spark, f"{tmp_path}/none").count() == 0


def test_small_buckets_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rows = [(None, "")] * 150 + [(i, "word " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(packing.pieces(df).drop("ids")).collect(), rows)
