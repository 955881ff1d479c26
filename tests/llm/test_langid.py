import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from sketchwell.llm import langid


def test_bundle_equals_the_definition():
    grams, text = langid.Grams(), "Ab é1cb"
    letters = " ab é cb "
    want = np.zeros(langid.DIMENSIONS)
    for i in range(len(letters) - 2):
        a, b, c = (langid.letter_vector(ord(x)).astype(int) for x in letters[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(grams.bundle([text, None, "12"])[0], want)
    assert not grams.bundle([None, "12", ""]).any()


def test_cache_is_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(langid, "CACHED_GRAMS", 10)
    texts = ["the one", "le la les", "und der die das nicht", "el"]
    small = langid.Grams()
    got = small.bundle(texts * 3)
    monkeypatch.undo()
    assert np.array_equal(got, langid.Grams().bundle(texts * 3)) and len(small.known) <= 60


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in langid.op1_langid(spark, sf).collect() if r["held_out"]]
    assert len(rows) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, score string, value int"
    rows = [(1, None, "en", "x", 1), (2, "", "en", None, 2), (None, "the and", None, "x", 3), (3, "12 34", "en", "x", 4), (4, "the and of " * 9, "en", "", 1), (4, "the and of " * 9, "en", "", 1), (5, "der und " * 20, "de", "", 1), (6, "日本 ", "x", "", 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.op1_langid(spark, f"{tmp_path}/full").collect()]
    assert len(got) == 8 and sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, "und"), (2, "und"), (3, "und")]
    assert langid.op1_langid(spark, f"{tmp_path}/none").count() == 0


@cache
def gram_vector(gram):
    a, b, c = (langid.letter_vector(ord(x)).astype("int64") for x in gram)
    return np.roll(a, 2) * np.roll(b, 1) * c


def slow_vector(text):
    letters = " "
    for c in text or "":
        if c.isalpha():
            letters += c.lower()[0]
        elif letters[-1] != " ":
            letters += " "
    letters += " " if letters[-1] != " " else ""
    out = np.zeros(langid.DIMENSIONS)
    if letters.strip():
        for gram, n in Counter(letters[i : i + 3] for i in range(len(letters) - 2)).items():
            out += n * gram_vector(gram)
    norm = np.sqrt((out**2).sum())
    return out / norm if norm else out


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    vectors = {r["doc_id"]: slow_vector(r["text"]) for r in rows}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    sums = {}
    for r in rows:
        if not held(r["doc_id"]) and r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    names = sorted(sums)
    table = np.stack([sums[k] / np.sqrt((sums[k] ** 2).sum()) for k in names])
    for r in langid.op1_langid(spark, sf).collect():
        v = vectors[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"])
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cosines = table @ v
            assert r["lang_pred"] == names[int(cosines.argmax())] and abs(r["score"] - max(0.0, cosines.max())) < 1e-5


def test_ties_long_texts_and_too_many_languages(spark, monkeypatch):
    v = langid.unit(langid.Grams().bundle(["the and of it"]))[0]
    text = "the and of it is " * 40_000
    df = spark.createDataFrame([(1, text), (2, text[:1700])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.predict(df, {"zz": v, "aa": v.copy()}).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == "aa" and abs(rows[1]["score"] - rows[2]["score"]) < 0.01
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="over 2 values"):
        langid.train(spark.createDataFrame([(i, "a b", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))
