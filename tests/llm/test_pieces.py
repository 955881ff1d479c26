import random
import zlib

import numpy as np
import sentencepiece
import public_tokenizers

from sketchwell.llm import pieces


def whole(v, symbols):
    """Viterbi over the whole text at once."""
    best, back = [0.0] + [None] * len(symbols), [None] * (len(symbols) + 1)
    for end in range(1, len(symbols) + 1):
        for start in range(max(0, end - v.longest), end):
            found = v.pieces.get(symbols[start:end])
            options = [found] if found else ([(-1, v.unknown)] if end - start == 1 else [])
            for i, s in options:
                if best[end] is None or best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, (start, i)
    out, at = [], len(symbols)
    while at:
        start, i = back[at]
        out = ([i] if i >= 0 else [v.byte[b] for b in symbols[start:at].encode()]) + out
        at = start
    return out


class Toy:
    """Overlapping pieces without a natural boundary, so that only back pointers converge."""

    def __init__(self):
        rng = random.Random(2)
        words = ["a", "b"] + ["".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(14)]
        self.pieces = {w: (i, -rng.randint(1, 9) * 1.0) for i, w in enumerate(dict.fromkeys(words))}
        self.byte, self.unknown, self.longest = {i: 1000 + i for i in range(256)}, -30.0, 5
        self.root = pieces.tree_of(self.pieces)


def test_stream_equals_viterbi_over_the_whole_text():
    rng, v = random.Random(1), pieces.Vocabulary()
    for _ in range(400):
        s = "▁" + "".join(rng.choice(["the", "ing", "a", "é", "▁", "\n", "日", "\x00", "😀", "tion", "▁▁"]) for _ in range(rng.randint(0, 25)))
        assert [i for p in pieces.stream(v, s) for i in p] == pieces.window(v, s) == whole(v, s)
    toy, commits = Toy(), 0
    for n in [1, 5, 80, 400, 3000]:
        s = "".join(rng.choice("ab") for _ in range(n))
        parts = list(pieces.stream(toy, s))
        commits = len(parts)
        assert [i for p in parts for i in p] == pieces.window(toy, s) == whole(toy, s)
    assert commits > 20


def test_round_trip_and_agreement_on_decoding():
    rng, codec = random.Random(3), pieces.Codec()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2000):
        t = "".join(rng.choice(["the", "ing", "a", "é", " ", "\n", "日", "😀", "▁", "  ", ",", ".", "**", "!!"]) for _ in range(rng.randint(0, 25)))
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if "▁" not in t:
            assert np.frombuffer(ids, "<u4").tolist() == (whole(codec.vocabulary, "▁" + t.replace(" ", "▁")) if t else [])
            assert model.decode(np.frombuffer(ids, "<u4").tolist()) == t
    assert codec.encode(None) == codec.encode("") == b""


def test_query(spark, sf, tmp_path):
    rows = pieces.op5_sentencepiece(spark, sf).collect()
    assert len(rows) == 200 and all(r["round_trip"] and r["n_ids"] > 0 for r in rows)
    schema = "doc_id long, text string, ids string, decoded int"
    spark.createDataFrame([(1, None, "x", 1), (None, "", "x", 1), (3, "a " * 40_000, None, 1), (3, "a" * 3000, None, 1)], schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = sorted(((str(r["doc_id"]), r["n_ids"], r["round_trip"]) for r in pieces.op5_sentencepiece(spark, f"{tmp_path}/full").collect()), key=str)
    assert [g[0] for g in got] == ["1", "3", "3", "None"] and all(g[2] for g in got) and got[0][1] is None
    codec = pieces.Codec()
    for r in pieces.op5_sentencepiece(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").limit(50).collect():
        ids = codec.encode(r["text"])
        assert np.array(r["ids"], "<u4").tobytes() == ids and r["ids_crc32"] == zlib.crc32(ids) and 4 * r["n_ids"] == len(ids)
    assert pieces.op5_sentencepiece(spark, f"{tmp_path}/none").count() == 0
