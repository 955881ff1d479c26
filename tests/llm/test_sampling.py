"""How labelled rows are sampled: by a limit on hashes that no number of rows turns into none."""

import pytest
from pyspark.sql import functions as F

from sketchwell.llm import langid
from sketchwell.llm.common import place, place_limit


def test_limit_is_never_zero_and_in_proportion():
    assert place_limit(1000, 1000) == place_limit(1000, 3) == 2**63 - 1
    for n in (1001, 10**6, 6 * 10**8, 10**10, 5 * 10**15):
        assert place_limit(1000, n) / 2**63 == pytest.approx(1000 / n, rel=1e-6)
    assert place_limit(1, 2**70) >= 1


def test_rows_of_null_and_repeated_ids_are_drawn_one_by_one(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    taken = df.where(place("doc_id", "text") <= place_limit(2_000, 20_000)).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in taken} == {7, None} and all(850 < r["count"] < 1150 for r in taken)


def test_languages_of_very_many_texts_are_learned(spark, monkeypatch):
    """The limit is what 10 ** 10 texts of a language would give, and a hash of the few here is under it."""
    monkeypatch.setattr(langid, "place", lambda *c: F.lit(5).cast("long"))
    monkeypatch.setattr(langid, "place_limit", lambda wanted, of: place_limit(wanted, 10**10))
    df = spark.createDataFrame([(1, "aa", "one two three"), (2, "bb", "vier funf sechs")], "doc_id long, lang string, text string")
    assert set(langid.train(df)) == {"aa", "bb"}
