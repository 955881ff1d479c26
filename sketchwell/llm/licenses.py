"""License scans by diagonal voting, with DataFrame operations only.

Every rolling pair of words of a text is joined by its hash (and verified by its words) to the
places of the pair in the templates. A match votes for the diagonal `place in the text - place in
the template`, which is where the template would start. A diagonal with all votes of its template is
an exact place. Neighbouring diagonals merge: to each are added the votes of those up to GAP away on
either side, as inserted or missing words leave them, so that a span is never longer than its
template and 2 * GAP words. It is verified if it covers COVER of the template's pairs.

Text is lower-cased in A-Z; null text counts as empty. Words are runs of 0-9, a-z and characters
above 0x7F. Rows are told apart by id and a hash of their text, so repeated rows each get the same
result; they are counted before they meet in a task, and dealt out again if they are many. Texts of
fewer than two words have no place and score 0. A very long text costs as its words. Spans that tie
each give their own row; labels are distinct and sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, documents

GAP, COVER = 2, 0.8
#: Label and words of each template; the first three are the base phrases (fixed values).
TEMPLATES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("public-domain", "released into the public domain"),
]
N_BASE = 3
#: Repeated rows that one task writes.
COPIES = 1000
#: What separates words (fixed value), but for capitals, which are lower-cased in the words.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The mark of a text's last word, which has no pair: one comes from every text and tells its length.
LAST = -1


def words_of(text):
    """The text's words in their own case, as an array column."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAKS, -1)
    head = (F.get(parts, F.lit(0)) == "").cast("int")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, head + 1, F.size(parts) - head - tail)


def template_pairs(spark: SparkSession) -> DataFrame:
    """(template, label, pairs, at, first, second, h): some hundred rows, as many as TEMPLATES has words, and LAST."""
    rows = []
    for i, (label, phrase) in enumerate(TEMPLATES):
        words = phrase.split()
        rows += [(i, label, len(words) - 1, at, a, b) for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    schema = "template int, label string, pairs int, at int, first string, second string"
    pairs = spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("first", "second"))
    return pairs.unionByName(spark.createDataFrame([(LAST, None, 1, 0, None, None)], schema).withColumn("h", F.lit(0).cast("long")))


def hits(df: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, pairs, at, place, rows): each pair of every whole text at each of its template places.

    rows is the number of repeated rows that have it. The template LAST has a row of every text, whose place is that of the last word (-1: no word).
    """
    words = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    rolled = words.select("doc_id", "text_hash", F.posexplode_outer(zipped).alias("place", "x"))
    rolled = rolled.select("doc_id", "text_hash", F.coalesce("place", F.lit(-1)).alias("place"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    key = F.when(F.col("b").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lower("a"), F.lower("b")))
    alike = F.when(F.col("b").isNull(), F.col("template") == LAST).otherwise((ascii_lower(F.col("a")) == F.col("first")) & (ascii_lower(F.col("b")) == F.col("second")))
    found = rolled.join(F.broadcast(template_pairs(df.sparkSession)), (key == F.col("h")) & alike)
    return found.groupBy("doc_id", "text_hash", "template", "label", "pairs", "at", "place").agg(F.count(F.lit(1)).alias("rows"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, pairs, start, end, cover, exact, rows): each diagonal of hits with its neighbours.

    cover is the share of the template's pairs that they hold; exact is the start if this diagonal
    alone has them all, and else null.
    """
    keys = ["doc_id", "text_hash", "template", "label", "pairs"]
    voted = found.repartition("doc_id", "text_hash").groupBy(*keys, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"), F.max("rows").alias("rows"))
    near = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal").rangeBetween(-GAP, GAP)
    merged = voted.withColumn("_n", F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near))))).withColumn("start", F.min("low").over(near)).withColumn("end", F.max("high").over(near) + 2)
    exact = F.when(F.size("ats") == F.col("pairs"), F.col("diagonal").cast("long"))
    return merged.select(*keys, "start", "end", (F.col("_n") / F.col("pairs")).alias("cover"), exact.alias("exact"), "rows")


def scan(df: DataFrame) -> DataFrame:
    """One row per row of df: doc_id, n_words, base places and labels, all labels, and a score."""
    last, base = F.col("template") == LAST, (F.col("template") >= 0) & (F.col("template") < N_BASE) & F.col("exact").isNotNull()
    verified = (F.col("template") >= N_BASE) & (F.col("cover") >= COVER)
    joined = lambda wanted: F.array_join(F.sort_array(F.collect_set(F.when(wanted, F.col("label")))), ",")
    by_text = spans(hits(df)).groupBy("doc_id", "text_hash").agg(
        F.max(F.when(last, F.col("end") - 1)).cast("long").alias("n_words"),
        F.count(F.when(base, F.lit(1))).alias("n_base"),
        F.min(F.when(base, F.col("exact"))).alias("first_word"),
        F.max(F.when(base, F.col("exact"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | verified).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(verified, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max(F.when(last, F.col("rows"))).alias("_rows"),
    )
    by_text = checkpointed(by_text)
    many = by_text.where(F.col("_rows") > COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / COPIES))))
    many = many.repartition("doc_id", "_part").withColumn("_rows", F.least(F.lit(COPIES), F.col("_rows") - F.col("_part") * COPIES)).drop("_part")
    every = by_text.where(F.col("_rows") <= COPIES).unionByName(many)
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("text_hash", "_rows", "_copy")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


_VALUES = ", ".join(f"({i}, '{label}', {len(p.split()) - 1}, {at}, '{a}', '{b}')" for i, (label, p) in enumerate(TEMPLATES) for at, (a, b) in enumerate(zip(p.split(), p.split()[1:], strict=False)))

ORACLE_SQL = rf"""
WITH templates(template, label, pairs, spot, a, b) AS (VALUES {_VALUES}),
texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w))) AS p, w FROM texts WHERE len(w) > 1),
pairs AS (SELECT doc_id, p - 1 AS place, w[p] AS a, w[p + 1] AS b FROM places),
hits AS (SELECT doc_id, template, label, pairs, spot, place, place - spot AS diagonal FROM pairs JOIN templates USING (a, b)),
voted AS (SELECT doc_id, template, label, pairs, diagonal, count(*) AS votes FROM hits GROUP BY ALL),
exact AS (SELECT doc_id, label, diagonal FROM voted WHERE template < {N_BASE} AND votes = pairs),
merged AS (
    SELECT v.doc_id, v.template, v.label, v.pairs, v.diagonal, count(DISTINCT h.spot) / v.pairs AS cover
    FROM voted v JOIN hits h ON v.doc_id = h.doc_id AND v.template = h.template AND h.diagonal BETWEEN v.diagonal - {GAP} AND v.diagonal + {GAP}
    WHERE v.template >= {N_BASE} GROUP BY v.doc_id, v.template, v.label, v.pairs, v.diagonal),
all_labels AS (
    SELECT doc_id, label, diagonal AS base, 1.0::DOUBLE AS cover FROM exact
    UNION ALL SELECT doc_id, label, NULL, cover FROM merged WHERE cover >= {COVER}),
found AS (
    SELECT doc_id, count(base) AS n_base, min(base) AS first_word, max(base) AS last_word,
           array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (base IS NOT NULL), [])), ',') AS base_labels,
           array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score
    FROM all_labels GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN found USING (doc_id)
"""
