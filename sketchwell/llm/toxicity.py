"""Toxicity by compression distance: each window is compressed with two zstandard dictionaries.

A window is one word between spaces, in lower case, each byte written as a code of three (so that a
match outweighs a frame's rounding to whole bytes). The ordinary dictionary is trained by zstandard
on texts labelled 0. The toxic one is the words that set texts labelled 1 apart, found over a
bounded sample of labelled rows, in front of the same ordinary content. A window's distance is its
length under the ordinary dictionary less that under the toxic one; a window that shares no four
bytes with the toxic words has distance 0 without being compressed. A logistic curve, fitted on the
labelled sample, turns a text's largest distances into a score.

Null text counts as empty; its features are zero. Without labels of both kinds every score is the
share of label 1 (0 without labels). Labels of several rows of one document: 1 if any is. A very long
text is scored whole, at the cost of its words. Texts with equal features have equal scores, and
words that tell as much are ordered by their bytes. Repeated rows each give their own result. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, documents, place, place_limit, remainder

#: The classifier is fitted on about so many labelled rows, taken by a hash of the id ...
LABELLED = 20_000
#: ... and the ordinary dictionary on the texts of about so many of those labelled 0.
ORDINARY_TEXTS, ORDINARY_BYTES = 1_500, 32_768
#: A toxic word: texts of label 1 it is in, standard errors above chance, times as frequent, distinct words that it stands behind (fewer: a copied passage).
MIN_TEXTS, MIN_ERRORS, MIN_TIMES, MIN_CONTEXTS = 5, 8.0, 8.0, 5
MAX_WORDS = 400
CACHED_WORDS = 300_000
GRAM = 4

_LEFT = (np.arange(256) * 37 + 11) % 251
_RIGHT = (np.arange(256) * 91 + 7) % 253
_CODES = [bytes([c, _LEFT[c], _RIGHT[c]]) for c in range(256)]


def coded(data: bytes) -> bytes:
    return b"".join([_CODES[c] for c in data])


class Distance:
    """The distances of words, with a cache."""

    def __init__(self, ordinary: bytes, toxic: list[bytes]):
        content = coded(ordinary)
        self.toxic, self.ordinary = self._compressor(coded(b" " + b" ".join(toxic) + b" ") + content), self._compressor(content)
        self.grams = {w[i : i + GRAM] for w in toxic for i in range(len(w) - GRAM + 1)}
        self.cache: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as Z

        how = Z.ZstdCompressionParameters(window_log=19, chain_log=18, hash_log=18, search_log=5, min_match=5, target_length=64, strategy=Z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return Z.ZstdCompressor(dict_data=held, compression_params=how)

    def _of(self, word: bytes) -> int:
        if not any(word[i : i + GRAM] in self.grams for i in range(len(word) - GRAM + 1)):
            return 0
        window = coded(b" " + word + b" ")
        return max(0, len(self.ordinary.compress(window)) - len(self.toxic.compress(window)))

    def features(self, text: str | None) -> list[float]:
        """The largest distance, the sum of the three largest, and the mean over all windows."""
        words = _words(text or "")
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, found = self.cache, []
        for w in words:
            d = cache.get(w)
            if d is None:
                d = cache[w] = self._of(w)
            if d:
                found.append(d)
        found.sort(reverse=True)
        return [float(found[0]), float(sum(found[:3])), 100 * sum(found) / len(words)] if found else [0.0, 0.0, 0.0]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve on x and a constant, by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxic_words(sample: DataFrame) -> list[bytes]:
    """The words that set label 1 apart, the most telling last; sample has doc_id, text and toxic."""
    import pandas as pd

    def counted(batches):
        for pdf in batches:
            found: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                found[int(toxic)].update(set(_words(text)))
            words = list(found[0] | found[1])
            yield pd.DataFrame({"w": words, "a": [found[1][w] for w in words], "b": [found[0][w] for w in words]})

    counts = sample.agg(F.sum(F.col("toxic")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_other = int(counts["a"] or 0), int(counts["n"]) - int(counts["a"] or 0)
    if not n_toxic or not n_other:
        return []
    texts = sample.select("text", "toxic").where(F.col("text").isNotNull())
    by_word = texts.mapInPandas(counted, "w binary, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (n_toxic + n_other)
    errors = (F.col("a") / n_toxic - share) / F.sqrt(share * (1 - share) / n_toxic + 1e-12)
    telling = by_word.where((F.col("a") >= MIN_TEXTS) & (errors > MIN_ERRORS) & (F.col("a") / n_toxic > MIN_TIMES * (F.col("b") + 0.5) / n_other))
    rows = telling.select("w", errors.alias("errors")).orderBy(F.desc("errors"), "w").limit(4 * MAX_WORDS).collect()  # the top words, not rows
    asked = {bytes(r["w"]): r["errors"] for r in rows}
    if not asked:
        return []

    def before(batches):
        for pdf in batches:
            found = set()
            for text in pdf["text"]:
                words = _words(text)
                found.update((w, p) for w, p in zip(words, [b"", *words], strict=False) if w in asked)
            yield pd.DataFrame(list(found), columns=["w", "p"])

    contexts = texts.where("toxic = 1").mapInPandas(before, "w binary, p binary").groupBy("w").agg(F.countDistinct("p").alias("n")).collect()
    kept = sorted((asked[bytes(r["w"])], bytes(r["w"])) for r in contexts if r["n"] >= MIN_CONTEXTS)
    return [w for _, x in kept[-MAX_WORDS:] if len(w := x.strip(b".,;:!?|")) >= GRAM]


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def train(docs: DataFrame, labels: DataFrame) -> tuple[bytes, list[bytes], np.ndarray, float]:
    """(ordinary content, toxic words, weights, share of label 1); rows with remainder 0 are never read."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return b"", [], np.zeros(4), 0.0
    taken = known.withColumn("place", place("doc_id")).where(F.col("place") <= place_limit(LABELLED, n))
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"))  # about LABELLED small rows
    share = sample.agg(F.avg("toxic")).first()[0]
    if share in (None, 0.0, 1.0):
        return b"", [], np.zeros(4), float(share or 0)
    few = F.col("place") <= place_limit(min(ORDINARY_TEXTS, LABELLED), n)
    ordinary = [r["text"].encode().lower() for r in sample.where((F.col("toxic") == 0) & few & F.col("text").isNotNull()).orderBy("doc_id").select("text").collect()]
    words = toxic_words(sample)
    content = dictionary(ordinary)
    rows = with_features(sample, content, words).select("toxic", "features").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    return content, words, fit_curve(x, y), float(share)


def dictionary(texts: list[bytes]) -> bytes:
    """Trained by zstandard; the texts themselves where they are too few to train on."""
    import zstandard as Z

    try:
        return Z.train_dictionary(ORDINARY_BYTES, texts, level=3).as_bytes()
    except Z.ZstdError:
        return b" ".join(texts)[:ORDINARY_BYTES]


def with_features(df: DataFrame, content: bytes, words: list[bytes]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((content, words))

    def make():
        distance = Distance(*shared.value)

        def compute(texts):
            return [[distance.features(t) for t in texts]]

        return compute

    return append_columns(df, ["text"], [T.StructField("features", T.ArrayType(T.DoubleType()))], make)


def score(df: DataFrame, model: tuple[bytes, list[bytes], np.ndarray, float]) -> DataFrame:
    """df with score and predicted."""
    content, words, weights, share = model
    if not words:
        return df.withColumn("score", F.lit(share)).withColumn("predicted", F.lit(int(share >= 0.5)))
    at = sum((F.lit(float(w)) * F.col("features")[i] for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    found = with_features(df, content, words).withColumn("score", 1 / (1 + F.exp(-at))).drop("features")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
