"""SentencePiece encoding and decoding by streaming Viterbi over a public model's pieces and scores.

A text's symbols are its characters, with `▁` for each space and one before the text. The encoding
is the segmentation into pieces of the largest score sum; of equal sums, at each place, the one with
the longer last piece. A character that is no piece costs PENALTY less than the worst score and is
written as its UTF-8 bytes, as is a `▁` of the text itself, so that decoding gives the text back.

The stream keeps scores and back pointers only from the last committed boundary on. It commits when
all surviving paths converge: at once where no piece spans the place, and otherwise, each time the
window has grown by four longest pieces, at the boundary that the back pointers of all live ends meet in.
Before a run of spaces, around a line feed and before the marks behind a word no piece spans the
place, so windows between such boundaries are told apart beforehand and those met before are reused.

Null text has no ids and decodes to null; empty text has no ids. A very long text costs as its
length; its window stays bounded. Ties are broken as said, so results do not depend on what a task
met before. Repeated rows give equal results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import ROWS_PER_CALL, append_columns, documents

SPACE = "▁"
PENALTY = 10.0
#: Distinct words that a Python worker keeps with their ids, twice, and the characters of the longest.
CACHED_WORDS, KEPT_CHARS = 400_000, 64
#: Marks that may stand behind a word.
MARKS = ".,;:!?|#*$%&"
#: Scores below it mark pieces that a model keeps for later rules; they cost as much as the worst other piece.
LEAST_SCORE = -1e8


def tree_of(pieces: dict[str, tuple[int, float]]) -> dict:
    """By first symbol: (the same of what may follow, id, score); id -1 where a piece only begins."""
    root: dict = {}
    for piece in sorted(pieces):  # a prefix comes before what it begins
        at = root
        for c in piece[:-1]:
            at = at.setdefault(c, ({}, -1, 0.0))[0]
        at[piece[-1]] = ({}, *pieces[piece])
    return root


class Vocabulary:
    """Pieces with their ids and scores, and the prefixes that make longer ones reachable."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = range(model.vocab_size())
        plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        worst = min(s for i in plain if (s := model.get_score(i)) > LEAST_SCORE)
        self.pieces = {model.id_to_piece(i): (i, max(worst, model.get_score(i))) for i in plain}
        self.text = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in n if model.is_byte(i)}
        self.text |= {i: bytes([b]) for b, i in self.byte.items()}
        self.unknown = worst - PENALTY
        self.longest = max(map(len, self.pieces))
        self.root = tree_of(self.pieces)
        #: Symbols that stand side by side in a piece; between others a text may be cut.
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        #: Whether a space can only begin a piece and a line feed is in none, so that a text may be cut before each run of spaces and around line feeds.
        self.cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces)


def window(vocabulary: Vocabulary, symbols: str) -> list[int]:
    """Ids of symbols as one window; what `stream` gives, for a text of bounded length."""
    n, root, unknown = len(symbols), vocabulary.root, vocabulary.unknown
    best = [float("-inf")] * (n + 1)
    best[0] = 0.0
    came, ids = [0] * (n + 1), [-1] * (n + 1)
    for start in range(n):
        here, end, nodes = best[start], start, root
        for c in symbols[start:]:
            found = nodes.get(c)
            if found is None:
                break
            end += 1
            nodes, i, score = found
            if i >= 0 and here + score > best[end]:  # an earlier start came first, so ties keep the longer piece
                best[end], came[end], ids[end] = here + score, start, i
        end = start + 1
        if here + unknown > best[end] and root.get(symbols[start], ((), -1))[1] < 0:
            best[end], came[end], ids[end] = here + unknown, start, -1
    out, at = [], n
    while at:
        start, i = came[at], ids[at]
        out += [i] if i >= 0 else [vocabulary.byte[b] for b in symbols[start:at].encode()][::-1]
        at = start
    return out[::-1]


def stream(vocabulary: Vocabulary, symbols: str) -> Iterator[list[int]]:
    """Ids of symbols, a list for each commit, with a window of bounded size."""
    root, unknown, longest = vocabulary.root, vocabulary.unknown, vocabulary.longest
    never, nothing = float("-inf"), (-1, -1)
    n, base, reach = len(symbols), 0, 0
    best: list[float] = [0.0]  # of ends base, base + 1, ...
    back: list[tuple[int, int]] = [(-1, -1)]  # start and id (-1: by bytes) of the last piece
    asked = 4 * longest

    def commit(end: int) -> list[int]:
        nonlocal base
        out, at = [], end
        while at > base:
            start, i = back[at - base]
            out += [i] if i >= 0 else [vocabulary.byte[b] for b in symbols[start:at].encode()][::-1]
            at = start
        del best[: end - base], back[: end - base]
        base = end
        return out[::-1]

    for start in range(n):
        if reach <= start and start > base:  # no piece spans this place: every path goes through it
            yield commit(start)
            asked = 4 * longest
        elif start - base >= asked:
            live = {start, *range(start + 1, reach + 1)} & {e for e in range(base + 1, base + len(best)) if best[e - base] != never} | {start}
            while len(live) > 1:
                top = max(live)
                live.discard(top)
                live.add(back[top - base][0])
            if (meet := live.pop()) > base:
                yield commit(meet)
            asked = start - base + 4 * longest
        here = best[start - base]
        stop = min(n, start + longest)
        if (more := stop - base + 1 - len(best)) > 0:
            best += [never] * more
            back += [nothing] * more
        single, end, nodes = False, start, root
        for c in symbols[start:stop]:
            found = nodes.get(c)
            if found is None:
                break
            end += 1
            nodes, i, score = found
            if i >= 0:
                if end == start + 1:
                    single = True
                if end > reach:
                    reach = end
                if here + score > best[end - base]:  # an earlier start came first, so ties keep the longer piece
                    best[end - base], back[end - base] = here + score, (start, i)
        if not single:
            reach = max(reach, start + 1)
            if here + unknown > best[start + 1 - base]:
                best[start + 1 - base], back[start + 1 - base] = here + unknown, (start, -1)
    if n > base:
        yield commit(n)


class Codec:
    """Encodes and decodes whole texts, with a cache of words."""

    def __init__(self, path: str | None = None):
        self.vocabulary = v = Vocabulary(path)
        self.words: dict[str, bytes] = {}  # symbols between two boundaries; a leading space counts as one
        self.older: dict[str, bytes] = {}
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.line = self._ids("\n")
        self.table = [v.text.get(i, b"") for i in range(max(v.text) + 1)]

    def _ids(self, symbols: str) -> bytes:
        v = self.vocabulary
        ids = window(v, symbols) if len(symbols) <= 4 * v.longest else [i for part in stream(v, symbols) for i in part]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not text:
            return b""
        if SPACE in text:
            literal = np.array([self.vocabulary.byte[b] for b in SPACE.encode()], "<u4").tobytes()
            parts = text.split(SPACE)
            return self._plain(" " + parts[0]) + b"".join(literal + (self._plain(p) if p else b"") for p in parts[1:])
        return self._plain(" " + text)

    def _plain(self, text: str) -> bytes:
        if not self.vocabulary.cut:
            return self._ids(text.replace(" ", SPACE))
        if len(self.words) > CACHED_WORDS:  # the last generation stays at hand
            self.older, self.words = self.words, {}
        out: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.line)
            if "  " in line:
                keys = [k for k in self.parts.findall(line.replace(" ", SPACE)) if k]
            else:
                first, *keys = line.split(" ")
                keys = [SPACE + k for k in keys]
                if first:
                    keys.insert(0, first)
            found = list(map(self.words.get, keys))
            if None in found:
                found = [self._word(k) if got is None else got for k, got in zip(keys, found, strict=True)]
            out += found
        return b"".join(out)

    def _word(self, k: str) -> bytes:
        got = self.words.get(k)
        if got is None:
            got = self.older.get(k)
        if got is None:
            stem = k.rstrip(MARKS)
            if stem and len(stem) < len(k) and k[len(stem) - 1 : len(stem) + 1] not in self.vocabulary.joined:
                got = self._word(stem) + self._word(k[len(stem) :])
            else:
                got = self._ids(k)
        if len(k) <= KEPT_CHARS:
            self.words[k] = got
        return got

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


@cache
def codec() -> Codec:
    """One codec in each Python worker, kept from task to task with the words it has met."""
    return Codec()


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ids: uint32 bytes, null for null."""
    fields = [T.StructField("ids", T.BinaryType())]
    return append_columns(df, [text], fields, lambda: lambda texts: [[None if t is None else codec().encode(t) for t in texts]])


def decode(df: DataFrame, ids: str = "ids") -> DataFrame:
    """df with decoded: the text of ids, null for null."""
    fields = [T.StructField("decoded", T.StringType())]
    return append_columns(df, [ids], fields, lambda: lambda rows: [[None if r is None else codec().decode(r) for r in rows]])


def transcode(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array, n_ids, ids_crc32, round_trip) of every whole text, encoded and decoded in one pass.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers. Null text has null for all but
    round_trip, which is true.
    """
    schema = T.StructType([df.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_CALL):
                batch = whole.slice(start, ROWS_PER_CALL)
                texts = batch.column(1).to_pylist()
                rows = [None if t is None else codec().encode(t) for t in texts]
                same = [t is None or codec().decode(r) == t for t, r in zip(texts, rows, strict=True)]
                ends = np.cumsum([0, *(len(r or b"") // 4 for r in rows)])
                offsets = pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in rows), False]))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(r or b"" for r in rows), "<i4")))
                numbers = [pa.array([None if r is None else f(r) for r in rows], pa.int64()) for f in (lambda r: len(r) // 4, zlib.crc32)]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, *numbers, pa.array(same)], names=schema.names)

    return df.select(id_column, text).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids, their number and checksum, and whether they decode to the text."""
    return transcode(documents(spark, sf_dir))
