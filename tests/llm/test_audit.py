import random
import re
from itertools import permutations

import pytest

from sketchwell.llm import audit

from .oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, n long"


def brute(docs, labels):
    """docs (id, text, lang), labels (id, quality, toxic): the rows of the report, one document at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs):
            f.add("E")
        fails.append((d, lang or "", f))
    rows = []
    for part in {p for _, p, _ in fails}:
        own = [(d, f) for d, p, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        of_part = []
        for order in permutations("ABCDE"):
            left = list(own)
            for k, c in enumerate(order, 1):
                gone = [d for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                shapley[c] += len(gone)
                failing = sum(c in f for _, f in own)
                of_part.append((part, "".join(order), k, len(left), len(gone), failing - len(gone), sum(f == {c} for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone)))
        rows += [(*r, shapley[r[1][r[2] - 1]]) for r in of_part]
    return sorted(rows)


def found(df):
    return sorted(map(tuple, df.collect()))


def texts(rng):
    words = [f"w{i}" for i in range(150)]
    kinds = [lambda: " ".join(rng.sample(words, rng.randint(90, 110))), lambda: " ".join(rng.choices(words[:60], k=110)), lambda: "LOUD WORDS " * rng.randint(1, 60), lambda: rng.choice(["a#b", "", " \n", "x|y", "É É"])]
    return [rng.choice(kinds)() for _ in range(25)]


@pytest.mark.parametrize("seed", range(3))
def test_report_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = texts(rng)
    docs = [(rng.choice([i, i, i, rng.randint(0, 60), None]), rng.choice([*pool, None]), rng.choice(["en", "de", None, ""])) for i in range(120)]
    labels = [(rng.choice([rng.randint(0, 60), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame([(d, t, g, "s", 1, 7, "x", 3) for d, t, g in docs], SCHEMA).repartition(5)
    got = found(audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(docs, labels) and len(got) == 600 * 3


def test_equal_fingerprints_are_told_apart_by_text(spark, monkeypatch):
    chains = audit.Chains()
    assert chains.add(1, b"a", 5, {"en": 1}, 0) == [] and chains.add(1, b"b", 7, {"en": 1}, 1) == []
    assert chains.add(1, b"a", 3, {"de": 2}, 0) == [(5, "en", 16, 1)]
    assert chains.add(1, b"b", 9, {"de": 1}, 1) == [(9, "de", 17, 1)] and chains.add(1, b"a", 3, {"de": 1, "en": 1}, 0) == []
    assert sorted(chains.least()) == [(1, b"a", 3, {"de": 3, "en": 1}, 0), (1, b"b", 7, {"en": 1}, 1)]


def test_query_equals_sql(spark, sf):
    assert same(spark, audit.op13_audit, audit.ORACLE_SQL, sf) == 120 * 5 * 4


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(2, long, "en"), (1, long, "en"), (1, long, "en"), (None, long, None), (3, None, None), (4, "", None), (4, "", None)]
    labels = [(2, 1, 0), (2, 0, 1), (4, None, 1)]
    spark.createDataFrame([(d, t, g, "s", 1, 7, "x", 3) for d, t, g in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = found(audit.op13_audit(spark, str(tmp_path)))
    assert got == brute(docs, labels)
    first = {r[0]: r for r in got if r[1] == "EABCD" and r[2] == 1}
    assert first["en"][3:] == (2, 1, 0, 1, 1, 1, 120) and first[""][4] == 2 and first[""][8] == 2
    same(spark, audit.op13_audit, audit.ORACLE_SQL, str(tmp_path))
    none = audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0
    unlabelled = audit.audit(spark.createDataFrame([(1, "a", "en", "s", 1, 7, "x", 3)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert unlabelled.count() == 600
