"""Language-model scoring: a gated recurrent network over frequent words, unigram tails, whole documents.

Words and one end token make a text. The network's symbols are the most frequent words, the end, and
TAILS buckets of all other words by their last letters; a bucket's word has its share of the bucket's
count. So a text's probability is that of its symbols under the network, whose state runs through the
whole text, times those shares. A word never seen has the bucket's remaining half count.

Words are counted over all texts, apart for those that train. The most frequent of all are listed:
their counts go to every task. The counts of all others come back to the texts by a join on the
word, where no word can crowd a task, since a frequent one is on the list, whichever texts hold it.
Symbols, counts and network come from training texts only, and from every one of them: in each of
ROUNDS rounds every task trains a copy on its share of the texts, and the copies are averaged by the
symbols they saw. Every text trains once. More tasks train more copies, for fewer steps each, so the
network (not the counts) depends on how the input is dealt.

Null text counts as empty: it is the end token alone. Repeated rows train as often as they occur,
and each gives its own result. A very long text is one run of the state, in windows, and costs as its
length. Words of equal counts are ordered by their bytes. Without training texts the base score is
log10(1) for each token.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import ROWS_PER_CALL, checkpointed, documents, remainder

TAILS = 64
END = gru.SYMBOLS - TAILS - 1
#: Words whose counts every task holds.
LISTED = 131_072
#: Distinct words that a counting task holds before it hands them on.
HELD = 600_000
#: Rounds of training; the numbers of one block of the network; groups in which tasks' blocks are added up first.
ROUNDS, BLOCK, GROUPS = 2, 1024, 64
#: Symbols that are trained on, and scored, together, lanes side by side.
LEARNED, POOL = 4_000_000, 1_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class _Tails(dict):
    """Buckets by last letters, as they are met."""

    def __missing__(self, letters: bytes) -> int:
        self[letters] = found = zlib.crc32(letters) % TAILS
        return found


_TAILS = _Tails()


def _slices(batches):
    for batch in batches:
        yield from (batch.slice(a, ROWS_PER_CALL) for a in range(0, batch.num_rows, ROWS_PER_CALL))


def tail_of(word: bytes) -> int:
    return _TAILS[word[-3:]]


def _tail_column(word):
    return F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % TAILS


class Lists:
    """Numbers of listed words, and each one's symbol; symbols are words with a symbol of their own."""

    def __init__(self, words: list[bytes], symbols: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        own = {w: i for i, w in enumerate(symbols)}
        self.symbol = np.array([own[w] if w in own else END + 1 + tail_of(w) for w in words], "int16")

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(numbers, -1 if not listed; symbols with the end; words not listed)."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), "int64", len(words))
        symbols = np.empty(len(ids) + 1, "int16")
        symbols[-1] = END
        other = np.flatnonzero(ids < 0)
        rest = [words[i] for i in other.tolist()]
        if len(ids):
            symbols[:-1] = self.symbol[ids] if len(self.symbol) else 0
            symbols[other] = [END + 1 + _TAILS[w[-3:]] for w in rest]
        return ids, symbols, rest


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, train, n): how often each word of docs (text, _train) stands in training texts, and in all."""

    def count(batches):
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out():
            words = list(found[True] | found[False])
            trained = [found[True][w] for w in words]
            columns = [pa.array(words, pa.binary()), pa.array(trained, pa.int64()), pa.array([found[False][w] + n for w, n in zip(words, trained, strict=True)], pa.int64())]
            found[True].clear(), found[False].clear()
            return pa.RecordBatch.from_arrays(columns, names=["w", "train", "n"])

        for batch in _slices(batches):
            for text, training in zip(batch.column("text").to_pylist(), batch.column("_train").to_pylist(), strict=True):
                found[training].update(words_of(text))
                if len(found[training]) > HELD:
                    yield out()
        yield out()

    rows = docs.select("text", "_train").mapInArrow(count, "w binary, train long, n long")
    return rows.groupBy("w").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


def _least(words: DataFrame, column: str, n: int, more: bool) -> int:
    """A count that at most n words reach, or (more) that n words reach if there are so many; counts are rounded down to six bits."""
    value = F.col(column)
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(value)) - 6)).cast("long")
    rows = sorted(words.where(value > 0).groupBy((value - value % step).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # 32 rows for each doubling
    found, upto = 0, 0
    for c, k in rows:
        if not more and upto + k > n:
            break
        found, upto = c, upto + k
        if more and upto >= n:
            break
    return found or 2**62


def train_network(texts: DataFrame, lists, start: np.ndarray) -> np.ndarray:
    """Network parameters after ROUNDS of training, each on its share of texts, averaged over tasks; lists is a broadcast (words, symbols)."""
    flat = start
    context = texts.sparkSession.sparkContext
    share = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = context.broadcast(flat)

        def learn(batches, shared=shared):
            known, at, held, n, seen = Lists(*lists.value), shared.value, [], 0, 0
            for batch in _slices(batches):
                for t in batch.column("text").to_pylist():
                    held.append(known.read(words_of(t))[1])
                    n += len(held[-1])
                    if n > LEARNED:
                        at, trained = gru.train(at, held, END)
                        seen, held, n = seen + trained, [], 0
            at, trained = gru.train(at, held, END)
            if seen + trained:
                blocks = [at[i : i + BLOCK].astype("float64") * (seen + trained) for i in range(0, gru.SIZE, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(seen + trained)] * len(blocks)), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "weight", "x"])

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "weight": [pdf["weight"].sum()], "x": [np.sum(pdf["x"].to_list(), axis=0)]})

        schema = "block int, weight double, x array<double>"
        parts = texts.where(share == k).select("text").mapInArrow(learn, schema).withColumn("_group", F.spark_partition_id() % GROUPS)
        rows = sorted(parts.groupBy("block", "_group").applyInPandas(added, schema).groupBy("block").applyInPandas(added, schema).collect())  # the network's size
        if rows:
            flat = np.concatenate([np.array(r["x"]) / r["weight"] for r in rows]).astype("float32")
    return flat


def score(df: DataFrame, training) -> DataFrame:
    """df's doc_id with n_tokens, n_known, train_tokens, base_score and score; training is a condition on df's rows.

    The text-free rows are cut from their lineage before their words are counted.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    docs = df.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("_train"))
    words = checkpointed(word_counts(docs))
    n_texts = docs.where("_train").count()
    ranked = words.where(F.col("train") >= _least(words, "train", END, True)).orderBy(F.desc("train"), "w").limit(END).select("w", "train").collect()  # END rows
    top = words.where(F.col("n") >= _least(words, "n", LISTED, False)).select("w", "train").toPandas()  # LISTED rows at most
    symbols = [bytes(r["w"]) for r in ranked]
    count_of = dict(zip(map(bytes, top["w"]), top["train"].tolist(), strict=True)) | {bytes(r["w"]): r["train"] for r in ranked}
    lists = context.broadcast((list(count_of), symbols))
    counts = np.array(list(count_of.values()), "int64")
    per_tail = words.groupBy(_tail_column(F.col("w")).alias("t")).agg(F.sum("train").alias("n"), F.sum((F.col("train") > 0).cast("long")).alias("v")).collect()  # TAILS rows
    n_tail, v_tail = np.zeros(TAILS), np.zeros(TAILS)
    for t, n, v in per_tail:
        n_tail[t], v_tail[t] = n, v
    total, distinct = int(n_tail.sum()) + n_texts, int(v_tail.sum()) + (n_texts > 0)
    unit = math.log10(total + 0.5 * (distinct + 1))
    for w in symbols:  # what has a symbol of its own is in no bucket
        n_tail[tail_of(w)] -= count_of[w]
        v_tail[tail_of(w)] -= 1
    units = np.log10(n_tail + 0.5 * (v_tail + 1))
    start = np.zeros(gru.SYMBOLS)
    start[: len(symbols)] = [count_of[w] for w in symbols]
    start[END], start[END + 1 :] = n_texts, n_tail
    network = context.broadcast(train_network(docs.where("_train"), lists, gru.initial(start)))
    shared = context.broadcast(counts)

    def read(batches):
        known, counts, flat = Lists(*lists.value), shared.value, network.value
        logs, rare = np.log10(counts + 0.5), known.symbol > END
        held, n = [], 0

        def out():
            values = gru.score(flat, [h[-1] for h in held], END) / math.log(10)
            columns = [pa.array(c, t) for c, t in zip(list(zip(*[h[:-1] for h in held], strict=True)), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=["doc_id", "_train", "n_tokens", "known", "listed_log", "rare_log", "tails", "rest", "network"])

        for batch in _slices(batches):
            for doc_id, text, training in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "_train")], strict=True):
                ids, symbols, rest = known.read(words_of(text))
                listed = ids[ids >= 0]
                tails = np.bincount(symbols[symbols > END] - END - 1, minlength=TAILS)
                held.append((doc_id, training, len(symbols), int((counts[listed] > 0).sum()), float(logs[listed].sum()), float(logs[listed[rare[listed]]].sum()), tails, b" ".join(rest), symbols))
                n += len(symbols)
                if n > POOL:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    schema = "doc_id long, _train boolean, n_tokens long, known long, listed_log double, rare_log double, tails array<int>, rest binary, network double"
    scored = checkpointed(docs.mapInArrow(read, schema)).withColumn("_row", F.monotonically_increasing_id())
    rest = scored.where(F.length("rest") > 0).select("_row", F.explode(F.split(F.col("rest").cast("string"), " ")).alias("word"))
    counted = words.select(F.col("w").cast("string").alias("word"), F.col("train").alias("c"))
    found = rest.join(counted, "word").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("rest_log"), F.sum((F.col("c") > 0).cast("long")).alias("rest_known"))
    joined = scored.drop("rest").join(found, "_row", "left")
    rest_log, rest_known = F.coalesce("rest_log", F.lit(0.0)), F.coalesce("rest_known", F.lit(0))
    tails = F.aggregate(F.zip_with("tails", F.array(*[F.lit(float(u)) for u in units]), lambda n, u: n * u), F.lit(0.0), lambda a, b: a + b)
    return joined.select(
        "doc_id",
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + rest_known + int(n_texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("listed_log") + rest_log + math.log10(n_texts + 0.5) - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("network") + F.col("rare_log") + rest_log - tails).alias("score"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), remainder(F.col("doc_id")) != 1)
