"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram vector binds its
letters' vectors by products, each permuted (rolled) by its place. A text's vector bundles (adds) the
vectors of all its letter n-grams; a language's prototype bundles those of its training texts, each
text to the same length. The language with the largest cosine wins.

Text is lower-cased; runs of other characters count as one separator. Null text, and text without a
letter, gives `und` with score 0. Where nothing was learned every text is `und`. Ties go to the
language that sorts first. A very long text is bundled whole, n-gram by n-gram, at the cost of its
length. Repeated rows each give their own result. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, documents, place, place_limit, remainder

DIMENSIONS, N = 1024, 3
#: Prototypes are fitted on about so many texts of each language, taken by a hash of the id.
TEXTS_PER_LANGUAGE = 1_000
#: Distinct values of the language column up to which it can be one: all named languages are fewer.
MAX_LANGUAGES = 10_000
#: n-grams whose vectors a task keeps.
CACHED_GRAMS = 32_768
UNKNOWN = "und"
SEPARATOR = 32


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([7, code]).choice(np.array([-1, 1], "int8"), DIMENSIONS)


class Grams:
    """Vectors of n-grams, kept by their packed code points."""

    def __init__(self):
        self.known = np.zeros(0, "int64")  # sorted
        self.places = np.zeros(0, "int64")  # of each in vectors
        self.vectors = np.zeros((0, DIMENSIONS), "int8")
        self.letters: dict[int, np.ndarray] = {}
        self.classes = np.full(0x110000, -1, "int32")  # code point of the lower-case letter, or the separator; -1: not asked yet

    def _bind(self, gram: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, "int8")
        for place in range(N):
            code = gram >> 21 * (N - 1 - place) & 0x1FFFFF
            if code not in self.letters:
                self.letters[code] = letter_vector(code)
            out *= np.roll(self.letters[code], N - 1 - place)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's n-grams and how often each occurs; none if it has no letter."""
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("int32")
        found = self.classes[codes]
        if (found < 0).any():
            for c in np.unique(codes[found < 0]):
                low = chr(c).lower()
                self.classes[c] = ord(low[0]) if chr(c).isalpha() else SEPARATOR
            found = self.classes[codes]
        letter = found != SEPARATOR
        if not letter.any():
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        found = found[letter | np.append(True, letter[:-1])].astype("int64")  # one separator for a run
        grams = found[: len(found) - 2] << 42 | found[1 : len(found) - 1] << 21 | found[2:]
        return np.unique(grams, return_counts=True)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The places of sorted, distinct n-grams in vectors; they are bound if they are new."""
        if len(self.known) + len(grams) > max(CACHED_GRAMS, 2 * len(grams)):
            self.known, self.places = self.known[:0], self.places[:0]
        at = np.searchsorted(self.known, grams)
        fresh = np.ones(len(grams), bool)
        if len(self.known):
            fresh = self.known[np.minimum(at, len(self.known) - 1)] != grams
        if fresh.any():
            new, used = grams[fresh], len(self.known)
            if used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors[:used], np.zeros((used + 2 * len(new), DIMENSIONS), "int8")])
            for i, g in enumerate(new):
                self.vectors[used + i] = self._bind(int(g))
            where = np.searchsorted(self.known, new)
            self.known = np.insert(self.known, where, new)
            self.places = np.insert(self.places, where, np.arange(used, used + len(new)))
            at = np.searchsorted(self.known, grams)
        return self.places[at]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The sums of n-gram vectors of each text, one row a text."""
        out = np.zeros((len(texts), DIMENSIONS), "float32")
        for i, t in enumerate(texts):
            if t:
                grams, counts = self.counts(t)
                if len(grams):
                    at = self.rows(grams)
                    out[i] = counts.astype("float32") @ self.vectors[at].astype("float32")
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows.astype("float64") ** 2).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros(rows.shape), where=norm > 0)


def train(df: DataFrame, lang: str = "lang", text: str = "text", per_language: int = TEXTS_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows of df whose lang and text are not null; the caller chooses the rows.

    More values of lang than MAX_LANGUAGES are an error, so that prototypes stay small enough to send.
    """
    known = df.select(F.col("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has over {MAX_LANGUAGES} values: it names no language")
    if not n:
        return {}
    limits = known.sparkSession.createDataFrame([(k, place_limit(per_language, v)) for k, v in n.items()], "lang string, upto long")
    taken = known.join(F.broadcast(limits), "lang").where(place("doc_id", "text") <= F.col("upto"))  # MAX_LANGUAGES rows

    def sums(batches):
        grams, totals = Grams(), {}
        for pdf in batches:
            for language, group in pdf.groupby("lang"):
                totals[language] = totals.get(language, 0) + np.rint(1e6 * unit(grams.bundle(list(group["text"]))).sum(axis=0)).astype("int64")
        import pandas as pd

        for language, total in totals.items():
            yield pd.DataFrame({"lang": language, "place": np.arange(DIMENSIONS), "value": total})

    parts = taken.select("lang", "text").mapInPandas(sums, "lang string, place int, value long")
    found = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()  # languages x DIMENSIONS rows
    out: dict[str, np.ndarray] = {}
    for language, at, value in found:
        out.setdefault(language, np.zeros(DIMENSIONS))[at] = value
    return out


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """df with lang_pred and score, the cosine of the winner (0 where it is negative)."""
    names = sorted(prototypes)
    table = unit(np.stack([prototypes[k] for k in names])).T if names else np.zeros((DIMENSIONS, 0))
    shared = df.sparkSession.sparkContext.broadcast((names, table))

    def make():
        names, table = shared.value
        grams = Grams()

        def compute(texts):
            if not names:
                return [UNKNOWN] * len(texts), [0.0] * len(texts)
            vectors = unit(grams.bundle(texts))
            cosines = vectors @ table
            best = cosines.argmax(axis=1)
            blank = ~vectors.any(axis=1)
            return [UNKNOWN if b else names[i] for i, b in zip(best, blank, strict=True)], [0.0 if b else float(min(1.0, max(0.0, c[i]))) for c, i, b in zip(cosines, best, blank, strict=True)]

        return compute

    return append_columns(df, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prototypes = train(docs.where(remainder(F.col("doc_id")) != 0))
    return predict(docs.select("doc_id", "text"), prototypes).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
