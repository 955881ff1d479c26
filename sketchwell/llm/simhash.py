"""SimHash near-duplicates by tables of pivot distances.

A fingerprint has 64 bits; two link at MAX_BITS or fewer differing bits. PIVOTS are random, fixed
fingerprints. The table of a fingerprint holds its Hamming distances to every pivot, block by block:
a distance within one of four blocks of bits, or of six or eight where fingerprints are more than the
values of two of four blocks' bits (2 ** 32), or of four of six blocks' (2 ** 42). By the triangle inequality two fingerprints' distances
to a pivot differ by no more, in sum over the blocks, than they themselves do; and as MAX_BITS
differing bits leave all but MAX_BITS blocks alone, there is a choice of so many blocks in which all
their distances are equal. So candidates are those with equal coordinates in one choice of blocks,
found by a shuffle on those coordinates' hash. Of these, pairs with a coordinate that differs by more
than MAX_BITS are discarded, and the rest verified by their differing bits. Nothing is lost.

A choice that many fingerprints share is not paired: each of its members is written with every way
of clearing up to MAX_BITS of the bits outside the choice, and members that agree then are within
MAX_BITS of each other, so one link from each to the least of them keeps all links' components. If
two differ in exactly those bits they meet there, so none is lost.

Text is lower-cased in A-Z. Null and empty text, and text without a word, has fingerprint zero. A
very long text counts whole, all its shingles. A bit that ties is 0. Repeated rows each give their
own row; a null id takes part, and is never the smallest unless alone. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, documents

MAX_BITS, SHINGLE = 2, 3
#: Numbers of blocks, of which the least is taken whose keys have a value for each fingerprint, or the last.
BLOCKS = (4, 6, 8)
#: Members of one choice up to which they are paired with each other.
PAIRED = 24
#: Keys with more than one row in so many are looked up apart from others, once there are LEAST_HEAVY.
SHARES, LEAST_HEAVY = 1000, 500
#: Random pivots: fixed values from a seed.
PIVOTS = [int(x) for x in np.random.default_rng(11).integers(-(2**63), 2**63 - 1, 16)]

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of the text's SHINGLE-word shingles."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[SHINGLE:], strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    return append_columns(df, [text], [T.StructField("fp", T.LongType())], lambda: lambda texts: [[fingerprint(t) for t in texts]])


def blocks_for(n: int) -> int:
    """How many blocks the fingerprints' bits are cut into, for n of them."""
    return next((of for of in BLOCKS if n <= 2 ** (64 * (of - MAX_BITS) // of)), BLOCKS[-1])


def choices(of: int) -> list[tuple[int, ...]]:
    """The ways to choose, of so many blocks, those that MAX_BITS differing bits may leave alone."""
    return list(combinations(range(of), of - MAX_BITS))


def _bits(block: int, of: int) -> range:
    return range(64 * block // of, 64 * (block + 1) // of)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _cleared(choice: tuple[int, ...], of: int) -> list[int]:
    """Masks that clear MAX_BITS bits outside the choice of blocks; those that clear fewer are covered."""
    free = [i for b in range(of) if b not in choice for i in _bits(b, of)]
    return [_signed((2**64 - 1) & ~sum(1 << i for i in c)) for c in combinations(free, MAX_BITS)]


def distances(fp: Column, of: int = BLOCKS[0]) -> Column:
    """The table's row of a fingerprint: by block, its distances to the pivots within the block."""
    mask = lambda b: F.lit(_signed(sum(1 << i for i in _bits(b, of))))
    at = lambda p, b: F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(mask(b))).cast("byte")
    return F.array(*[F.array(*[at(p, b) for p in PIVOTS]) for b in range(of)])


def may_link(s: Column, t: Column, of: int = BLOCKS[0]) -> Column:
    """Whether no distance to a pivot differs by more than MAX_BITS between two rows of the table."""
    apart = lambda u, v: F.zip_with(u, v, lambda p, q: p - q)
    blocks = [apart(s[b], t[b]) for b in range(of)]
    whole = blocks[0]
    for more in blocks[1:]:
        whole = F.zip_with(whole, more, lambda p, q: p + q)
    return F.forall(whole, lambda d: F.abs(d) <= MAX_BITS)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp of fps that keep the components of all links.

    fps must be cheap to count.
    """
    of = blocks_for(fps.count())
    table = fps.select("fp", distances(F.col("fp"), of).alias("t"))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(*[F.col("t")[b] for b in blocks]).alias("key")) for i, blocks in enumerate(choices(of))]))
    keyed = table.select("fp", keys.alias("k")).select("fp", "k.choice", "k.key")
    shared = checkpointed(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = checkpointed(keyed.join(shared, ["choice", "key"]))
    few = members.where(F.col("n") <= PAIRED).groupBy("choice", "key").agg(F.sort_array(F.collect_list(F.struct("fp", distances(F.col("fp"), of).alias("t")))).alias("m"))
    left = few.select(F.posexplode("m").alias("i", "x"), "m")
    near = lambda y: may_link(F.col("x.t"), y["t"], of) & (F.bit_count(F.col("x.fp").bitwiseXOR(y["fp"])) <= MAX_BITS)
    pairs = left.select(F.col("x.fp").alias("a"), F.explode(F.filter(F.slice("m", F.col("i") + 2, PAIRED), near)).alias("y")).select("a", F.col("y.fp").alias("b"))
    masks = fps.sparkSession.createDataFrame([(i, m) for i, c in enumerate(choices(of)) for m in _cleared(c, of)], "choice int, mask long")
    masks = masks.groupBy("choice").agg(F.collect_list("mask").alias("masks"))
    many = members.where(F.col("n") > PAIRED).join(F.broadcast(masks), "choice")
    cleared = many.select("fp", F.explode("masks").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    least = cleared.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    starred = cleared.join(least, ["mask", "rest"]).where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def looked_up(left: DataFrame, key: Column, right: DataFrame, name: str, value: str) -> DataFrame:
    """left with _found: `value` of right's row whose `name`, which is unique, equals key; null where there is none.

    left must be cheap to read again. A key that more than one in SHARES of its rows have is looked
    up in a broadcast table of such keys (fewer than SHARES rows); all others by a shuffle.
    """
    least = max(LEAST_HEAVY, left.count() // SHARES)
    heavy = [r["k"] for r in left.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > least) & F.col("k").isNotNull()).select("k").collect()]
    table = right.select(F.col(name).alias("_name"), F.col(value).alias("_found"))
    if not heavy:
        return left.join(table, key == F.col("_name"), "left").drop("_name")
    crowded = F.coalesce(key.isin(heavy), F.lit(False))
    few = F.broadcast(table.where(F.col("_name").isin(heavy)))
    return left.where(~crowded).join(table, key == F.col("_name"), "left").unionByName(left.where(crowded).join(few, key == F.col("_name"), "left")).drop("_name")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, rank) with the least rank of every component; nodes are (fp, rank), edges (a, b) between them.

    A rank is (missing, id, fp) and names the node whose own it is. Ranks spread over the links and
    jump to the rank of the node they name, until none changes; each round is cut from its lineage.
    """
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.select(F.col("a").alias("fp")).distinct()
    state = checkpointed(nodes.join(linked, "fp").select("fp", "rank"))
    while True:
        offers = looked_up(both, F.col("b"), state, "fp", "rank").groupBy(F.col("a").alias("fp")).agg(F.min("_found").alias("offer"))
        stepped = checkpointed(state.join(offers, "fp").select("fp", F.col("rank").alias("before"), F.least("rank", "offer").alias("rank")))
        if not stepped.where(F.col("rank") != F.col("before")).limit(1).count():
            return state.unionByName(nodes.join(linked, "fp", "left_anti").select("fp", "rank"))
        state = checkpointed(looked_up(stepped, F.col("rank.fp"), stepped, "fp", "rank").select("fp", F.least("rank", "_found").alias("rank")))


def _ranked(hashed: DataFrame) -> DataFrame:
    """hashed (fp, doc_id, ...) with _rank: (missing, id, fp) of the node that names the component; its lineage is cut."""
    hashed = checkpointed(hashed.drop("component_id"))
    nodes = hashed.groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = checkpointed(nodes.select("fp", F.struct(F.col("id").isNull().alias("missing"), "id", "fp").alias("rank")))
    named = checkpointed(components(nodes, links(nodes.select("fp"))))
    return looked_up(hashed, F.col("fp"), named, "fp", "rank").withColumnRenamed("_found", "_rank")


def group(hashed: DataFrame) -> DataFrame:
    """hashed (doc_id, fp, ...) with component_id, the smallest doc_id of the component; its lineage is cut."""
    return _ranked(hashed).withColumn("component_id", F.col("_rank.id")).drop("_rank")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the first row of the document that names the component.

    Groups are told apart by the id and fingerprint that name them, since an id may name several.
    Rows are told apart by id and a hash of the text, so that texts are read again, not kept. Copies of
    one row meet on the map side first; texts are shuffled once.
    """
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    ranked = _ranked(with_fingerprint(docs.select("doc_id", "text", same.alias("_hash"))).drop("text"))
    naming = ranked.where((F.col("fp") == F.col("_rank.fp")) & F.col("doc_id").eqNullSafe(F.col("_rank.id"))).groupBy("fp").agg(F.min("doc_id").alias("_id"), F.min("_hash").alias("_hash"))
    row = lambda i: {"_none": F.col(i).isNull(), "_number": F.coalesce(F.col(i), F.lit(0))}
    naming = naming.withColumns(row("_id")).select("_none", "_number", "_hash").distinct()
    each = docs.withColumns({**row("doc_id"), "_hash": same}).dropDuplicates(["_none", "_number", "_hash"])
    return each.join(naming, ["_none", "_number", "_hash"], "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group(with_fingerprint(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
