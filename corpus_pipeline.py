"""A text corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame. All but
the last return the columns of documents. Extra columns pass through the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchwell.llm import langid, packing, pii, quality, simhash
from sketchwell.llm.common import checkpoint_dir, documents

#: Two standard deviations of the cosine of unrelated vectors: below it a text has no known language.
MIN_COSINE = 2 / langid.DIMENSIONS**0.5


READ = ["doc_id", "text", "lang", "source", "n_chars"]


def shielded(stage):
    """stage with columns of docs that it does not read under names that cannot clash with its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        own = [c if c in READ else f"_extra_{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*own), sf_dir).select(*own).toDF(*names)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@shielded
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, and in the one that they are marked with if any.

    Rejected are texts that are null, empty or without a letter, texts unlike every prototype, and
    texts whose predicted language is not that of their lang column. Null languages pass. Very long
    texts count whole; repeated rows are judged alike.
    """
    found = langid.predict(docs, langid.train(docs))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_COSINE)
    return found.where(known & F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(True))).select(*docs.columns)


@shielded
def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds.

    Null and empty texts go. Null languages and sources are a group. Very long texts count whole;
    repeated rows count as often as they occur, and stay or go together.
    """
    return quality.judge(quality.with_counts(docs)).where("kept").select(*docs.columns)


@shielded
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Null, empty and wordless texts are one group. Of repeated rows one stays. A null id stays only in
    a group without others. Very long texts count whole.
    """
    return simhash.keep_one(docs)


@shielded
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null, and a null n_chars stays null. All rows stay, repeated ones too.
    """
    redacted = pii.find(docs).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return redacted.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null text is packed as empty."""
    return packing.pack(packing.pieces(docs).drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identified),
    ("quality", of_quality),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Quality thresholds, fingerprints and token ids are beyond SQL here; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared checkpoint folder and read again.

    A stage's folder is removed when the next one is written; the last is what the result is read from.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
