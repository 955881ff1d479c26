"""Quality rules with thresholds that come from the corpus, per language and source.

Each document gives a few whole-number metrics. A quantile sketch of a group is the count of each
of its metric's buckets (values under 64 are their own bucket, larger ones keep six leading bits, so
a bucket is within 1/32 of its values). Sketches merge by adding counts. A group's limit is the
quantile of its sketch that leaves the metric's TAIL above it, plus REACH times the distance of that
quantile from the median: no limit is a fixed number. A group of under MIN_GROUP documents takes the
sketch of its language, and if that is as small, the one merged over all groups. No limit exceeds
PEERS times the median of the groups' limits, each group counted once, so that a group that is
mostly junk cannot raise its own bar, however large it is.

Null text has no words. Null languages and sources are a group of their own. A document without
words has no metrics and fails the base rule. A value whose bucket is the limit's passes. Repeated rows
count as often as they occur. A very long text counts as one document, whole. An empty table gives
no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, checkpointed, documents

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP, REACH, PEERS = 30, 3, 2
#: Per cent of a group's documents that may lie above the quantile a metric's limit starts from: more where junk is told apart by nothing else.
TAIL = {"marks": 10, "capitals": 10, "long_words": 10, "dup_lines": 2, "repeats": 2}
#: Groups up to which the thresholds are broadcast: some 200 bytes each.
BROADCAST_GROUPS = 50_000

_SPACE, _SYMBOLS, _CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
#: ASCII punctuation.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

_LONG = T.LongType()
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_marks", "n_capitals"]


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    words = data.split()  # on the six ASCII white-space bytes
    n = len(words)
    without = lambda drop: len(data) - len(data.translate(None, drop))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, len(text) - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(_MARKS), without(_CAPITALS)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS and base_failed of every whole text."""

    def make():
        def compute(texts):
            rows = [measure(t) for t in texts]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in COUNTS]

        return compute

    counted = append_columns(df, [text], [T.StructField(c, _LONG) for c in COUNTS], make)
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _metrics() -> dict[str, Column]:
    """Whole numbers; null where a text has no word."""
    share = lambda part, whole: F.when(F.col("n_words") > 0, F.floor(1000 * F.col(part) / F.col(whole)))
    return {
        "marks": share("n_marks", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "long_words": F.when(F.col("n_words") > 0, F.floor(100 * F.col("word_chars") / F.col("n_words"))),
    }


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds value."""
    step = F.pow(F.lit(2.0), F.length(F.bin(value)) - 6).cast("long")
    return F.when(value < 64, value).otherwise(value - value % step)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one row per bucket, of the documents that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in _metrics().items()]))
    rows = counted.where(~F.col("base_failed")).select("lang", "source", each.alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketched: DataFrame) -> DataFrame:
    """(lang, source, n_docs, limit_<metric> ...): a row per group of documents that pass the base rule."""
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: sketched.select(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "metric", "bucket", "n")
    rows = level(0, F.col("lang"), F.col("source")).unionByName(level(1, F.col("lang"), none)).unionByName(level(2, none, none))
    rows = rows.groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy("level", "lang", "source", "metric")
    rows = rows.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("n_docs", F.sum("n").over(group))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("n_docs"), F.col("bucket")))
    tail = F.coalesce(*[F.when(F.col("metric") == k, F.lit(100 - t)) for k, t in TAIL.items()])
    found = rows.groupBy("level", "lang", "source", "metric").agg(F.max("n_docs").alias("n_docs"), at(50).alias("mid"), at(tail).alias("high"))
    limits = found.groupBy("level", "lang", "source").agg(F.max("n_docs").alias("n_docs"), *[F.max(F.when(F.col("metric") == k, F.col("high") + REACH * (F.col("high") - F.col("mid")))).alias(k) for k in TAIL])
    limits = checkpointed(limits)
    large = F.when(F.col("n_docs") >= MIN_GROUP, F.struct(*TAIL))
    own = limits.where("level = 0").select("lang", "source", "n_docs", large.alias("_own"))
    spoken = limits.where("level = 1").select(F.col("lang").alias("_lang"), large.alias("_spoken"))
    every = limits.where("level = 2").select(F.struct(*TAIL).alias("_every"))
    peers = limits.where((F.col("level") == 0) & (F.col("n_docs") >= MIN_GROUP)).agg(*[F.expr(f"percentile_disc(0.5) within group (order by {k})").alias(f"_peers_{k}") for k in TAIL])  # one row
    joined = own.join(spoken, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(every), how="left").join(F.broadcast(peers), how="left")
    chosen = joined.select("lang", "source", "n_docs", F.coalesce("_own", "_spoken", "_every").alias("_limit"), *[f"_peers_{k}" for k in TAIL])
    return chosen.select("lang", "source", "n_docs", *[F.least(F.col("_limit")[k], (PEERS * F.col(f"_peers_{k}")).cast("long")).alias(f"limit_{k}") for k in TAIL])


def judge(counted: DataFrame) -> DataFrame:
    """counted with kept; it is cut from its lineage, since thresholds need all of it first."""
    counted = checkpointed(counted)
    found = checkpointed(thresholds(sketch(counted)))
    names = [f"limit_{k}" for k in TAIL]
    groups = found.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in names])
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if groups.count() <= BROADCAST_GROUPS:
        joined = counted.join(F.broadcast(groups), same, "left")
    else:  # salted, since one group may hold a third of all rows
        salts = 64
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = counted.withColumn("_row_salt", F.pmod(F.xxhash64(*[c for c in counted.columns if c in ("doc_id", *COUNTS)]), F.lit(salts)).cast("int"))
        joined = dealt.join(salted, same & (F.col("_row_salt") == F.col("_salt")), "left").drop("_row_salt", "_salt")
    passes = ~F.col("base_failed")
    for k, v in _metrics().items():
        passes = passes & F.coalesce(bucket(v) <= F.col(f"_limit_{k}"), F.lit(False))
    return joined.withColumn("kept", passes).drop("_lang", "_source", *[f"_{c}" for c in names])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(with_counts(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("text"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


_METRICS_SQL = """
    SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           CASE WHEN n_words > 0 THEN [1000 * n_marks // word_chars, 1000 * n_capitals // word_chars,
               1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 100 * word_chars // n_words] END AS m
    FROM counts
"""
#: The tails in the order of the metrics above, and their number.
_TAILS = [TAIL[k] for k in ("marks", "capitals", "dup_lines", "repeats", "long_words")]
_N = len(_TAILS)
_BUCKET_SQL = re.compile(r"bucket_of\(([^()]+)\)")

ORACLE_SQL = rf"""
WITH texts AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
places AS (
    SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM texts WHERE len(ws) > 2),
triples AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS c FROM places),
repeats AS (
    SELECT doc_id, count(DISTINCT p + o) AS n FROM triples, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
counts AS (
    SELECT texts.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
           length(regexp_replace(t, '[^!-/:-@\[-`\{{-~]', '', 'g'))::BIGINT AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
    FROM texts LEFT JOIN repeats USING (doc_id)),
measured AS ({_METRICS_SQL}),
values_ AS (
    SELECT lang, source, unnest(m) AS v, unnest(range(1, {_N + 1})) AS metric FROM measured WHERE NOT base_failed),
buckets AS (
    SELECT lang, source, metric, bucket_of(v) AS bucket FROM values_),
sketch AS (
    SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM buckets GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM buckets GROUP BY lang, metric, bucket
    UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM buckets GROUP BY metric, bucket),
run AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS n_docs FROM sketch),
quantiles AS (
    SELECT level, lang, source, metric, max(n_docs) AS n_docs, min(bucket) FILTER (100 * upto >= 50 * n_docs) AS mid, min(bucket) FILTER (100 * upto >= (100 - {_TAILS}[metric]) * n_docs) AS high
    FROM run GROUP BY level, lang, source, metric),
limits AS (
    SELECT level, lang, source, max(n_docs) AS n_docs, list(high + {REACH} * (high - mid) ORDER BY metric) AS lim FROM quantiles GROUP BY level, lang, source),
peers AS (
    SELECT {", ".join(f"quantile_disc(lim[{i}], 0.5)" for i in range(1, _N + 1)).join(("[", "]"))} AS lim FROM limits WHERE level = 0 AND n_docs >= {MIN_GROUP}),
chosen AS (
    SELECT own.lang, own.source, CASE WHEN own.n_docs >= {MIN_GROUP} THEN own.lim WHEN spoken.n_docs >= {MIN_GROUP} THEN spoken.lim ELSE every.lim END AS lim
    FROM (SELECT * FROM limits WHERE level = 0) own
    LEFT JOIN (SELECT * FROM limits WHERE level = 1) spoken ON own.lang IS NOT DISTINCT FROM spoken.lang
    LEFT JOIN (SELECT * FROM limits WHERE level = 2) every ON true)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(list_bool_and(list_transform(range(1, {_N + 1}), lambda i: bucket_of(m.m[i]) <= least(c.lim[i], {PEERS} * p.lim[i]))), false) AS kept
FROM measured m
LEFT JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
LEFT JOIN peers p ON true
"""
ORACLE_SQL = _BUCKET_SQL.sub(r"(CASE WHEN \1 < 64 THEN \1 ELSE \1 - \1 % (1 << (length(bin(\1)) - 6)) END)", ORACLE_SQL)
