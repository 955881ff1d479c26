"""How five document filters interact: what each removes in every order in which they can be applied.

Every document gets a mask of the filters that it fails, alone and independent of the others. The
fifth filter fails a text that a document with a smaller id has, in the whole table. For it texts are
routed by fingerprint in an RDD: a task keeps, for each fingerprint, a chain of the full texts that
have it, each with the least id so far. Rows that are not the least of their text in their task fail
already there, and go on without the text; only one row for each text and task is routed by its
xxhash, and the task that it meets the others in emits all ids but the least. So a text that a third
of all rows have is one row for each task.

Counts of masks (all documents, those labelled good, those labelled toxic) are vectors that
combineByKey merges for each part; all orders are evaluated on a part's vector.

Null text is empty: it fails the first filter alone, and the last if it is not the first empty text.
Null lang is the part "". A null id compares with no other: it neither fails the last filter nor makes
others fail it. Rows that repeat id and text each count, and none makes the other fail. Labels that
occur twice count where one of them says 1; documents without a label are neither good nor toxic. Very
long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

FILTERS = "ABCDE"
#: Text that a task of the shuffle holds, about; an RDD's partitions are not fitted to what arrives, so it is counted first.
TASK_BYTES = 64 << 20
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_COPY = 1 << FILTERS.index("E")
#: Of each mask, which filters it fails.
_FAILS = (np.arange(2 ** len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)


def text_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    data = text.encode()
    words = data.split()  # on the six ASCII white-space bytes
    without = lambda drop: len(data) - len(data.translate(None, drop))
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * without(_CAPITALS) > CAPITALS_PERCENT * len(text)
    return few | dull << 1 | loud << 2 | (without(_SYMBOLS) > 0) << 3


class Chains:
    """By fingerprint the distinct texts met, each with the least id and how many rows of each lang have it."""

    def __init__(self):
        self.found: dict[int, list] = {}

    def add(self, fp: int, text: bytes, doc_id, langs: dict, mask: int) -> list[tuple]:
        """Rows (id, lang, mask, n) that fail as copies, now that one more is known."""
        chain = self.found.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    for lang, n in langs.items():
                        entry[2][lang] = entry[2].get(lang, 0) + n
                    return []
                if doc_id < entry[1]:  # the former least fails instead
                    doc_id, entry[1], langs, entry[2] = entry[1], doc_id, entry[2], langs
                return [(doc_id, lang, mask | _COPY, n) for lang, n in langs.items()]
        chain.append([text, doc_id, langs, mask])
        return []

    def least(self):
        """(fingerprint, text, id, langs, mask) of every text."""
        for fp, chain in self.found.items():
            for entry in chain:
                yield fp, *entry


def _within_task(rows):
    """Pairs for the shuffle: (fingerprint, (text, id, langs, mask)) of a text's least id, (any number, row) of others."""
    import xxhash

    chains, passed = Chains(), 0
    for doc_id, text, lang in rows:
        text, lang = text or "", lang or ""
        mask, data = text_mask(text), text.encode()
        if doc_id is None:
            decided = [(None, lang, mask, 1)]
        else:
            decided = chains.add(xxhash.xxh64_intdigest(data), data, doc_id, {lang: 1}, mask)
        for row in decided:
            passed += 1
            yield zlib.crc32(b"%d" % passed), row
    for fp, text, doc_id, langs, mask in chains.least():
        yield fp, (text, doc_id, langs, mask)


def _between_tasks(pairs):
    chains = Chains()
    for fp, row in pairs:
        if isinstance(row[0], bytes):
            yield from chains.add(fp, *row)
        else:
            yield row
    for _, _, doc_id, langs, mask in chains.least():
        for lang, n in langs.items():
            yield doc_id, lang, mask, n


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the mask of filters that a document fails; n rows repeat id, text and lang."""
    spark, rdd = docs.sparkSession, docs.select("doc_id", "text", "lang").rdd
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(size // TASK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rdd.mapPartitions(_within_task).partitionBy(n, lambda fp: fp % n).mapPartitions(_between_tasks)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(rows, schema, verifySchema=False)


def _started(value) -> np.ndarray:
    return _counted(np.zeros((len(_FAILS), 3), "int64"), value)


def _counted(vector: np.ndarray, value) -> np.ndarray:
    mask, n, good, toxic = value
    vector[mask] += (n, n * good, n * toxic)
    return vector


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def evaluate(part: str, vector: np.ndarray) -> list[tuple]:
    """(part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps."""
    each = np.arange(len(FILTERS))
    unique = [int(vector[1 << f, 0]) for f in each]
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        alive = np.ones(len(_FAILS), bool)
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            out = alive & _FAILS[:, f]
            before = ~alive & _FAILS[:, f]
            alive = alive & ~_FAILS[:, f]
            removed, good, toxic = (int(x) for x in vector[out].sum(axis=0))
            total[letter] += removed
            rows.append((part, order, step, int(vector[alive, 0].sum()), removed, int(vector[before, 0].sum()), unique[f], good, toxic))
    return [(*r, total[r[1][r[2] - 1]]) for r in rows]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: a row per part, order and step; labels has doc_id, quality and toxic."""
    is_one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    found = masked(docs)
    joined = found.join(marks, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = joined.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(_started, _counted, _merged, n, lambda part: zlib.crc32(part.encode()))
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: evaluate(*x)), SCHEMA, verifySchema=False)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_BITS_SQL = "(CASE {} " + " ".join(f"WHEN '{c}' THEN {1 << i}" for i, c in enumerate(FILTERS)) + " END)"

ORACLE_SQL = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (
    SELECT *, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
    FROM firsts LEFT JOIN marks USING (doc_id)),
counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (
    SELECT filter_order, step, {_BITS_SQL.format("filter_order[step]")} AS bit,
           list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN {_BITS_SQL.format("filter_order[i]")} ELSE 0 END)) AS before
    FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)),
found AS (
    SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before + bit) = 0) AS kept,
           sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
           sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost,
           sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
    FROM counts, (SELECT filter_order, step, bit::INT AS bit, before::INT AS before FROM steps) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM found
"""
