import corpus_pipeline
import pytest

from sketchwell.llm import packing, pii, quality, simhash

from . import test_packing
from .test_langid import slow_vector
from .test_simhash import grouped, slow

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet("/root/testdata/sf0.001/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [o.columns for o in out], [[r.asDict() for r in o.collect()] for o in out]


def test_columns_and_order(stages):
    assert all(c == COLUMNS for c in stages[0][:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "personal_data", "packing"]


def test_each_stage_against_brute_force(spark, stages):
    raw, spoken, good, single, masked, packed = stages[1]
    rows = lambda xs: {r["doc_id"]: r for r in xs}
    vectors = {r["doc_id"]: slow_vector(r["text"]) for r in raw}
    sums = {}
    for r in raw:
        if r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    unit = {k: v / (v @ v) ** 0.5 for k, v in sums.items()}
    cosine = {d: max((float(u @ v), k) for k, u in unit.items()) for d, v in vectors.items()}
    want = {r["doc_id"] for r in raw if cosine[r["doc_id"]][0] >= corpus_pipeline.MIN_COSINE and r["lang"] in (None, cosine[r["doc_id"]][1])}
    assert set(rows(spoken)) == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = set(rows(good))
    for r in spoken:
        n, *_, repeats = quality.measure(r["text"])[:5]
        if n < 50 or 2 * repeats > n:
            assert r["doc_id"] not in kept
    judged = [r["doc_id"] for r in spoken if r["doc_id"] in labels]
    assert sum(labels[d] == 0 and d in kept for d in judged) <= 0.2 * sum(labels[d] == 0 for d in judged)
    assert sum(labels[d] == 1 and d in kept for d in judged) >= 0.9 * sum(labels[d] == 1 for d in judged)
    ids = [r["doc_id"] for r in good]
    component = grouped(ids, [slow(r["text"]) for r in good])
    assert sorted(rows(single)) == sorted(set(component)) and all(rows(good)[d] == r for d, r in rows(single).items())
    assert set(rows(masked)) == set(rows(single))
    for d, r in rows(masked).items():
        text = rows(single)[d]["text"]
        assert r["text"] == pii.redact(text, pii.all_spans(text)[1]) and r["n_chars"] == len(r["text"]) and pii.base_spans(r["text"]) == []
    test_packing.check([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) and Row(r) for r in packed], [(r["doc_id"], r["text"]) for r in masked])


class Row(tuple):
    """A packed row that answers to both places and names."""

    def __new__(cls, r):
        self = super().__new__(cls, [r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
        self.r = r
        return self

    def __getitem__(self, key):
        return self.r[key] if isinstance(key, str) else super().__getitem__(key)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, fp string"
    text = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, None, None, None, None, "x", 1, "y"), (None, text, "en", None, 5, "x", 1, "y"), (2, text, "en", "s", None, "x", 1, "y"), (2, text, "en", "s", None, "x", 1, "y"), (3, "12", "en", "s", 2, "x", 1, "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")]
            if name != "packing":
                assert all((r["score"], r["kept"], r["fp"]) == ("x", 1, "y") for r in docs.collect())
        assert docs.count() == (1 if data else 0)


def test_run_gives_the_stages_rows(spark, stages):
    got = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[1][5]}
    assert packing.CAPACITY == 1024 and simhash.MAX_BITS == 2


def test_language_stage_rejects_other_and_unknown_languages(spark):
    rows = [(i, f"the and of it is {'abcdefgh'[i % 8]} that with for on at", "en") for i in range(40)] + [(i, f"der die das und nicht {'abcdefgh'[i % 8]} mit auf", "de") for i in range(40, 80)]
    rows += [(80, "der die das und nicht mit auf", "en"), (81, "the and of it is that", None), (82, "日本語 漢字", None), (83, "12 34", "en"), (84, None, "en"), (85, "the and of it " * 20_000, "en")]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identified(spark, docs, "").collect()}
    assert kept == set(range(80)) | {81, 85}
