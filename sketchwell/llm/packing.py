"""Best-fit packing of tokenized documents into sequences of CAPACITY tokens, by large-item matching.

Documents of one length are alike to a packer, so the packing is made on the histogram of lengths,
which has at most CAPACITY entries however many documents there are. It gives bin patterns (lists of
lengths with a count). Documents then take the places of their length in the order of a hash: each
finds its rank among its length from counts per (length, bucket), so that no task holds a length: a
length has a bucket for each BUCKET_ROWS of its rows and up to SPREAD more, and rows that are alike
are dealt over them too.

Only documents of over CAPACITY tokens are cut: their first piece takes the remainder, the others
are full. Of the items, those above a third of the capacity come at most two to a bin: descending,
each is matched with the largest other that fits beside it, unless a full bin of one kind is at
hand; items of a third or less best-fit the gaps left, then new bins.

Null text counts as empty: its only id is the end id. Repeated rows are packed as often as they
occur. Documents of one length are interchangeable, so ties may fall either way. A very long text is
encoded and cut whole. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, checkpointed, documents

CAPACITY, END = 1024, 2
#: Distinct words that a Python worker keeps with their ids, and the characters of the longest.
CACHED_WORDS, KEPT_CHARS = 600_000, 64
#: What a text that is encoded word by word does not hold, besides white space other than space and line feed.
PAIRS = ("  ", "\n\n", " \n", "\n ", "<|endoftext|>")
#: Ranks of one length are dealt over buckets of at most about so many rows, and over so many buckets if it has rows enough.
BUCKET_ROWS, SPREAD, LEAST_ROWS = 200_000, 64, 50


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian uint32 bytes, with a cache of words.

    The vocabulary's pattern never joins characters over a single space or line feed, other than
    that a space may begin a word. A text with only such white space is therefore encoded word by
    word; any other text, or one that names the special token, goes whole to the tokenizer.
    """

    def __init__(self, path: str | None = None):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: The same vocabulary in a library that is quick on short strings.
        self.short = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.white = re.compile(r"[^\S \n]")
        self.words: dict[str, bytes] = {}
        self.line = self._ids("\n")

    def _ids(self, word: str) -> bytes:
        return np.array(self.short.encode_ordinary(word), "<u4").tobytes()

    def odd(self, text: str) -> bool:
        """Whether text must go whole to the tokenizer."""
        return text[0].isspace() or text[-1].isspace() or any(p in text for p in PAIRS) or self.white.search(text) is not None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        words, out = self.words, []
        # A space goes with the word behind it, a line feed stands alone.
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.line)
            parts = line.split(" ")
            keys = [parts[0], *[" " + p for p in parts[1:]]]
            try:
                out += [words[k] for k in keys]
            except KeyError:
                for k in keys:
                    got = words.get(k)
                    if got is None:
                        got = self._ids(k)
                        if len(k) <= KEPT_CHARS:
                            words[k] = got
                    out.append(got)
        return b"".join(out)


@cache
def encoder() -> Encoder:
    """One encoder in each Python worker, kept from task to task with the words it has met."""
    return Encoder()


def pieces(df: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): the pieces of every whole text; ids as uint32 bytes."""
    fields = [T.StructField("found", T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])))]

    def make():
        encode, end = encoder(), np.array([END], "<u4").tobytes()

        def compute(texts):
            rows = []
            for t in texts:
                ids = encode(t or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows.append([{"piece": i, "start": a, "length": b - a, "ids": ids[4 * a : 4 * b]} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
            return [rows]

        return compute

    found = append_columns(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), ["text"], fields, make)
    return found.select("doc_id", F.explode("found").alias("p")).select("doc_id", "p.*", F.crc32("p.ids").alias("ids_crc32"))


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(count, lengths) of bins that hold every item of the histogram once; no bin exceeds the capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by gap: counts and contents
    out: list[tuple[int, list[int]]] = []

    def put(count: int, contents: tuple[int, ...]) -> None:
        gap = capacity - sum(contents)
        (open_bins.setdefault(gap, []) if gap else out).append((count, contents))

    def largest(most: int, above: float) -> int | None:
        i = bisect.bisect_right(lengths, most) - 1
        while i >= 0 and not left.get(lengths[i]):
            lengths.pop(i)
            i = bisect.bisect_right(lengths, most) - 1
        return lengths[i] if i >= 0 and lengths[i] > above else None

    third = capacity / 3
    while (a := largest(capacity, third)) is not None:  # greedy matching, the largest first
        b = largest(capacity - a, third)
        if b is None:
            put(left.pop(a), (a,))
        elif b == a:
            n, left[a] = left[a] // 2, left[a] % 2
            if n:
                put(n, (a, a))
            else:
                below = largest(a - 1, third)
                single = left.pop(a)
                if below is None:
                    put(single, (a,))
                else:
                    left[below] -= 1
                    put(1, (a, below))
        else:
            n = min(left[a], left[b])
            left[a] -= n
            left[b] -= n
            put(n, (a, b))
    gaps = sorted(open_bins)
    while (a := largest(capacity, 0)) is not None:  # best fit, the largest first
        i = bisect.bisect_left(gaps, a)
        while i < len(gaps) and not open_bins[gaps[i]]:
            gaps.pop(i)
        if i == len(gaps):
            each = capacity // a
            n, rest = divmod(left[a], each)
            left[a] = 0
            new = [(n, (a,) * each)] * (n > 0) + [(1, (a,) * rest)] * (rest > 0)
        else:
            count, contents = open_bins[gaps[i]].pop()
            each = min(gaps[i] // a, left[a])
            n = min(count, left[a] // each)
            left[a] -= n * each
            if count > n:
                open_bins[gaps[i]].append((count - n, contents))
            new = [(n, contents + (a,) * each)]
        for count, contents in new:
            gap = capacity - sum(contents)
            put(count, contents)
            if gap and (j := bisect.bisect_left(gaps, gap)) in (len(gaps),) or gap and gaps[j] != gap:
                gaps.insert(j, gap)
    return out + [x for bins in open_bins.values() for x in bins]


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, first bins, items a bin, and offsets in a bin, one entry a run of alike bins.

    Within a run with k items of the length a bin, rank r stands in bin first + (r - start) // k, at
    offset + ((r - start) % k) * length.
    """
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    upto: dict[int, int] = {}
    first = 0
    for count, contents in bins:
        at = i = 0
        while i < len(contents):
            n = contents[i]
            k = 1
            while i + k < len(contents) and contents[i + k] == n:
                k += 1
            found.setdefault(n, []).append((upto.get(n, 0), first, k, at))
            upto[n] = upto.get(n, 0) + count * k
            at, i = at + n * k, i + k
        first += count
    return {n: tuple(np.array(c, "int64") for c in zip(*rows, strict=True)) for n, rows in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ...) with sequence_id and offset; lineage is cut before ranks are dealt."""
    cut = checkpointed(cut.withColumn("_row", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())))
    histogram = dict(map(tuple, cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()))  # at most capacity rows
    dealt = {n: c // BUCKET_ROWS + min(SPREAD, c // LEAST_ROWS) + 1 for n, c in histogram.items()}
    buckets = F.element_at(F.array(*[F.lit(dealt.get(n, 1)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    cut = cut.withColumn("_bucket", F.pmod("_row", buckets).cast("int"))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each BUCKET_ROWS rows, and SPREAD + 1 for each length
    before: dict[int, np.ndarray] = {}
    for length, b, n in counts:
        before.setdefault(length, np.zeros(dealt[length] + 1, "int64"))[b + 1] = n
    before = {n: np.cumsum(x) for n, x in before.items()}
    slots = places(patterns(histogram, capacity))
    shared = cut.sparkSession.sparkContext.broadcast((before, slots))
    order = W.partitionBy("length", "_bucket").orderBy("_row", "doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1)

    def make():
        before, slots = shared.value

        def compute(lengths, buckets, ranks):
            bins, offsets = [], []
            for n, b, r in zip(lengths, buckets, ranks, strict=True):
                rank = int(before[n][b]) + r
                starts, firsts, per, at = slots[n]
                i = int(np.searchsorted(starts, rank, "right")) - 1
                q, m = divmod(rank - int(starts[i]), int(per[i]))
                bins.append(int(firsts[i]) + q)
                offsets.append(int(at[i]) + m * n)
            return bins, offsets

        return compute

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return append_columns(ranked, ["length", "_bucket", "_rank"], fields, make).drop("_bucket", "_rank", "_row")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(documents(spark, sf_dir)).drop("ids")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
