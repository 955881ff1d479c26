import random
import re

from sketchwell.llm import licenses

from .oracle import same


def test_query_equals_sql(spark):
    assert same(spark, licenses.op8_licenses, licenses.ORACLE_SQL, "/root/testdata/sf0.01") == 1000


def rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def test_base_places_equal_brute_force(spark):
    texts = ["CC BY cc by CC-BY, General Public License all rights, reserved", "é all rights reserved all rights reserved", "general public", "xall rights reserved", "", " ", None, "cc\x00by", "CC  BY"]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for label, phrase in licenses.TEMPLATES[:3] for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_diagonals_merge_over_inserted_words(spark):
    whole = "redistribution and use in source and binary forms with or without modification are permitted"
    got = rows(spark, [whole, whole.replace("forms", "object forms"), "redistribution and use in source", whole.replace("use in", "use of in")])
    assert [got[i]["labels"] for i in range(4)] == ["bsd", "bsd", "", "bsd"]
    assert got[0]["score"] == 1.0 and got[1]["score"] < 1


def method(text):
    """Labels beside the base ones and the best cover, by counting pairs around every possible diagonal."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, best = set(), 0.0
    for label, phrase in licenses.TEMPLATES[licenses.N_BASE :]:
        p = phrase.split()
        at = {}
        for i in range(len(words) - 1):
            for j in range(len(p) - 1):
                if words[i : i + 2] == p[j : j + 2]:
                    at.setdefault(i - j, set()).add(j)
        for d in at:
            cover = len(set().union(*(at.get(d + o, ()) for o in range(-licenses.GAP, licenses.GAP + 1)))) / (len(p) - 1)
            if cover >= licenses.COVER:
                labels.add(label)
                best = max(best, cover)
    return labels, best


def test_method_labels_equal_brute_force_over_random_edits(spark):
    rng, texts = random.Random(12), []
    for _ in range(400):
        words = []
        for _ in range(rng.randint(1, 3)):
            phrase = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(phrase))
                phrase[i : i + rng.randint(0, 2)] = [rng.choice(["the", "in", "or", "license"])] * rng.randint(0, 2)
                phrase = phrase or ["x"]
            words += phrase * rng.choice([1, 1, 2]) + ["and"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        labels, best = method(t)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(labels | base)), t
        assert abs(got[i]["score"] - (1.0 if base else best)) < 1e-12
    assert sum("mit" in got[i]["labels"] for i in got) > 20


def test_repetition_before_a_template_hides_nothing(spark):
    got = rows(spark, ["released under released under released under released under the mit license", "released under the mit license"])
    assert [(got[i]["labels"], got[i]["score"]) for i in range(2)] == [("mit", 1.0)] * 2


def test_many_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(licenses, "COPIES", 7)
    df = spark.createDataFrame([(None, "")] * 50 + [(1, "cc by")] * 15 + [(2, "a b")], "doc_id long, text string")
    got = licenses.scan(df).groupBy("doc_id", "labels").count().collect()
    assert sorted(map(tuple, got), key=str) == [(1, "cc-by", 15), (2, "", 1), (None, "", 50)]


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, label string, place int"
    data = [(1, None, "x", 1), (None, "All rights reserved", None, 2), (3, "all rights reserved", "x", 1), (3, "all rights reserved", "x", 1), (4, "word " * 50_000, "x", 1)]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = sorted(((str(r["doc_id"]), r["n_base"], r["labels"]) for r in licenses.op8_licenses(spark, f"{tmp_path}/full").collect()))
    assert got == [("1", 0, ""), ("3", 1, "reserved"), ("3", 1, "reserved"), ("4", 0, ""), ("None", 1, "reserved")]
    assert licenses.op8_licenses(spark, f"{tmp_path}/none").count() == 0
