import random

from sketchwell.llm import quality

from .oracle import same


def slow(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality.measure(text)[:5] == slow(text), repr(text)


def test_query_equals_sql(spark):
    assert same(spark, quality.op3_quality, quality.ORACLE_SQL, "/root/testdata/sf0.01") == 1000


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, kept string, n int"
    clean = " ".join(f"word{i} and" for i in range(40)) + "."
    junk = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, f"{i} {clean}", "en" if i % 2 else None, None, "x", 1) for i in range(80)] + [(90, junk, "en", None, "x", None), (91, None, None, "s", None, 1), (92, "", "en", None, "", 2), (None, clean, "en", None, "", 2), (90, junk, "en", None, "x", None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = [(r["doc_id"], r["n_words"], r["kept"]) for r in quality.op3_quality(spark, f"{tmp_path}/full").collect()]
    assert len(got) == 85 and {r[0] for r in got if not r[2]} == {90, 91, 92}
    assert quality.op3_quality(spark, f"{tmp_path}/none").count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    query = lambda: sorted(map(tuple, quality.op3_quality(spark, "/root/testdata/sf0.001").collect()))
    one = query()
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    monkeypatch.setattr(quality, "MIN_GROUP", 1)
    two = query()
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 99)
    assert len(one) == len(two) and two == query()


def corpus(spark, rates, n=100):
    """Documents of sources whose words end in a mark at the given rates."""
    rng, rows = random.Random(7), []
    for source, rate in rates:
        for i in range(n):
            words = [f"w{rng.randint(0, 999)}" + ("!" if rng.random() < rate(i) else "") for _ in range(120)]
            rows.append((len(rows), " ".join(words), "en", source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def limits(spark, df):
    found = quality.thresholds(quality.sketch(quality.with_counts(df)))
    return {r["source"]: r.asDict() for r in found.collect()}


def test_sources_with_other_habits_have_other_limits(spark):
    got = limits(spark, corpus(spark, [("plain", lambda i: 0.02), ("lively", lambda i: 0.05)]))
    assert 0 < got["plain"]["limit_marks"] < got["lively"]["limit_marks"]
    df = corpus(spark, [("plain", lambda i: 0.09 if i < 4 else 0.01), ("lively", lambda i: 0.05)])
    kept = {r["doc_id"] for r in quality.judge(quality.with_counts(df)).where("kept").collect()}
    assert not kept & set(range(4)) and len(kept) > 180  # what the other source would keep goes


def test_a_group_of_junk_cannot_raise_its_own_bar(spark):
    rates = [(f"s{k}", lambda i: 0.02) for k in range(5)] + [("junk", lambda i: 0.9 if i % 2 else 0.02)]
    df = corpus(spark, rates)
    kept = quality.judge(quality.with_counts(df)).where("kept").groupBy("source").count()
    by = {r["source"]: r["count"] for r in kept.collect()}
    assert by["junk"] == 50 and all(by[f"s{k}"] >= 97 for k in range(5))


def test_small_groups_take_the_limits_of_their_language(spark):
    df = corpus(spark, [("large", lambda i: 0.02)]).unionByName(corpus(spark, [("small", lambda i: 0.02)], n=5))
    got = limits(spark, df)
    assert abs(got["small"]["limit_marks"] - got["large"]["limit_marks"]) <= 2 and got["small"]["n_docs"] == 5


def test_very_long_text(spark):
    text = " ".join(f"word{i} and." for i in range(100_000))
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    row = quality.judge(quality.with_counts(df)).first()
    assert (row["n_words"], row["n_repeat_words"], row["kept"]) == (200_000, 0, True)
