"""MinHash near-duplicates with circulant signatures, banding and exact verification.

A document's set is its distinct SHINGLE-word shingles (the whole sequence if it has fewer words), as
64-bit hashes. Two fixed permutations of UNIVERSE places give all coordinates of its signature: one
spreads the hashes over the places, the other, shifted circularly by k, gives coordinate k as the
least value of the set. A shift by k reads the table k places further on, so the values of one shingle
for all coordinates are one slice of it.

Documents with equal sets are one node. BANDS keys of ROWS coordinates each make candidates: two sets
of similarity PERCENT/100 share no key with a probability under 1e-9, which is what this method may
lose. Candidates are confirmed on their full sets. Under a key of up to PAIRED nodes all pairs of
fitting size are tried. Under a crowded key pairs are not made: its nodes are compared with PIVOTS of
them, which joins groups of many near copies at one comparison a node and pivot. Keys whose nodes are
all linked with one pivot then are done. Nodes of the others are dealt over blocks, and a task has two blocks
of a key: it counts the shingles that all their nodes share by products of small matrices, and gives
only the links that join nodes of different pivots or of none. So no component is missed, no pairs are
written, and no task holds a whole key; the work on a key that stays open is the square of its nodes.

Text is lower-cased in A-Z. Null, empty and wordless text has an empty set, is linked with nothing and
is its own component. Very long texts count whole. Repeated rows each give their row, in one
component. A null id takes part and is the smallest only where no other is there; it is kept only
then. An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, documents
from .simhash import components, looked_up

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 36, 5
COORDINATES = BANDS * ROWS
UNIVERSE, SEED = 1 << 22, 5
#: Nodes of one key up to which all pairs are tried; pivots of a crowded key.
PAIRED, PIVOTS = 16, 3
#: Nodes and shingles of a block, about; columns of a matrix.
BLOCK_NODES, BLOCK_ITEMS, COLUMNS = 2000, 2_000_000, 4096
#: Shingles whose slices are held at once.
SLICE = 2048

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the text's set."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined)], "u8")
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip(starts, starts[SHINGLE:], strict=False)], "u8"))


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes, and all slices of COORDINATES values of the second permutation."""
    rng = np.random.default_rng(SEED)
    spread, values = rng.permutation(UNIVERSE).astype("u4"), rng.permutation(UNIVERSE).astype("u4")
    return spread, np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDINATES]]), COORDINATES)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima: coordinate k is that of the second permutation, shifted by k, over the set's places."""
    spread, slices = _permutations()
    places = spread[(hashes % UNIVERSE).astype("i8")]
    return reduce(np.minimum, (slices[places[i : i + SLICE]].min(axis=0) for i in range(0, len(places), SLICE)))


def band_keys(sig: np.ndarray) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]


def with_sketch(docs: DataFrame) -> DataFrame:
    """docs with fp (a digest of the set, null if it is empty), n_shingles and band keys."""

    def make():
        import xxhash

        def compute(texts):
            fps, sizes, keys = [], [], []
            for t in texts:
                found = shingles(t)
                sizes.append(len(found))
                fps.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found)) if len(found) else [])
            return fps, sizes, keys

        return compute

    return append_columns(docs, ["text"], [T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))], make)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, items): the full set of every wanted (fp, rep), read again from the row of docs that rep (missing, id, hash of text) names."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    asked = wanted.select(F.col("rep.id").alias("_id"), F.col("rep.hash").alias("_of"))
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left_semi")

    def make():
        import xxhash

        def compute(texts):
            found = [shingles(t) for t in texts]
            return [xxhash.xxh3_128_digest(s.tobytes()) for s in found], [s.view("i8") for s in found]

        return compute

    made = append_columns(texts.select("text"), ["text"], [T.StructField("fp", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))], make)
    return made.select("fp", "items").dropDuplicates(["fp"])


def _near(a, b):
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; a may be in many pairs, and its set is not copied for each."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("items").alias(f"_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * shared >= PERCENT * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of fitting size under keys of few nodes."""
    few = members.where(F.col("n") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "size"))).alias("m"))  # at most PAIRED
    left = few.select(F.posexplode("m").alias("i", "x"), "m")
    fits = F.filter(F.slice("m", F.col("i") + 2, PAIRED), lambda y: _near(F.col("x.size"), y["size"]))
    return left.select(F.col("x.fp").alias("a"), F.explode(fits).alias("y")).select("a", F.col("y.fp").alias("b"))


def _open(crowded: DataFrame, pivots: DataFrame, edges: DataFrame) -> DataFrame:
    """crowded (key, fp, size) with comp, the first of its key's pivots that it is linked with or else itself, of keys where these differ."""
    met = crowded.join(pivots.select("key", "a", "_place"), "key")
    sides = lambda a, b: [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]
    joined = met.select("key", "fp", "_place", "a", *sides("a", "fp")).join(edges.select(*sides("a", "b")), ["_x", "_y"]).select("key", "fp", "_place", "a")
    itself = met.where("fp = a").select("key", "fp", "_place", "a")
    covered = joined.unionByName(itself).groupBy("key", "fp").agg(F.min(F.struct("_place", "a"))["a"].alias("comp"))
    named = crowded.join(covered, ["key", "fp"], "left").withColumn("comp", F.coalesce("comp", "fp"))
    named = checkpointed(named)
    several = named.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z")).where("_a < _z").select("key")
    return named.join(several, "key", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs; the pivot stays first unless both orders occur."""
    return pairs.where("a != b").groupBy(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("_x"), F.col("_y")).otherwise(F.col("_x")).alias("b"))


def joining_links(fps: list, comps: list, sets: list[np.ndarray]) -> list[tuple]:
    """Links (a, b) between nodes of different components that join all that any links between them join.

    A component counts as joined in itself, so there are fewer links than components.
    """
    sizes = np.array([len(s) for s in sets])
    owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    common = times[column] > 1  # others are in no intersection
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), "f4")
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        matrix = np.zeros((len(sets), COLUMNS), "f4")
        matrix[owner[at], column[at] - first] = 1
        shared += matrix @ matrix.T
    _, comp = np.unique(np.array([bytes(c).hex() for c in comps]), return_inverse=True)
    near = (100 * shared >= PERCENT * (sizes[:, None] + sizes - shared)) & (comp[:, None] != comp)
    members = np.split(np.argsort(comp, kind="stable"), np.cumsum(np.bincount(comp))[:-1])
    found, reached = [], np.zeros(len(sets), bool)
    for start in np.unique(comp[near.any(axis=1)]):
        queue = [] if reached[members[start][0]] else [start]
        reached[members[start]] = True
        while queue:
            for i in members[queue.pop()]:
                for j in np.flatnonzero(near[i] & ~reached):
                    if not reached[j]:
                        reached[members[comp[j]]] = True
                        found.append((fps[i], fps[j]))
                        queue.append(comp[j])
    return found


def _block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between nodes of different components under the keys of open_ (key, fp, size, comp)."""
    import pandas as pd

    counts = open_.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_ITEMS)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = open_.join(counts, "key").select("key", "fp", "comp", own.alias("_own"), other.alias("_other"))
    rows = placed.select("key", "fp", "comp", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")).join(sets, "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = joining_links(list(pdf["fp"]), list(pdf["comp"]), [np.asarray(x) for x in pdf["items"]])
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return rows.select("key", "_i", "_j", "fp", "comp", "items").groupBy("key", "_i", "_j").applyInPandas(compare, "a binary, b binary")


def linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, rank) with the least rank of every component; nodes are (fp, rank, rep, n_shingles, keys)."""
    ranks = nodes.select("fp", "rank")
    keyed = nodes.select("fp", F.col("n_shingles").cast("int").alias("size"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(keyed.join(shared, "key"))
    wanted = nodes.select("fp", "rep").join(members.select("fp").distinct(), "fp", "left_semi")
    sets = checkpointed(_sets(docs, wanted))
    crowded = members.where(F.col("n") > PAIRED).select("key", "fp", "size")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("fp"), "fp"))  # the same pivots under many keys
    pivots = crowded.withColumn("_place", place).where(F.col("_place") <= PIVOTS).select("key", F.col("fp").alias("a"), F.col("size").alias("_size"), "_place")
    pivots = checkpointed(pivots)
    met = crowded.join(pivots, "key").where(_near(F.col("size"), F.col("_size"))).select("a", F.col("fp").alias("b"))
    edges = checkpointed(_verified(_ordered(_small_pairs(members).unionByName(met)), sets))
    open_ = checkpointed(_open(crowded, pivots, edges))
    if open_.limit(1).count():
        edges = _ordered(edges.unionByName(_block_links(open_, sets)))  # many keys give the same links
    return components(ranks, edges)


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text); lineage is cut."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = checkpointed(with_sketch(rows).drop("text"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), "hash")).alias("rep")
    nodes = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(rep, F.max("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    nodes = checkpointed(nodes.withColumn("rank", F.struct("rep.missing", "rep.id", "fp")))
    named = linked(nodes, docs)
    found = looked_up(rows.select("doc_id", "n_shingles", "fp"), F.col("fp"), named, "fp", "rank")
    own = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("_found.id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group(documents(spark, sf_dir).select("doc_id", "text"))
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(2, len(ws) - {SHINGLE - 2})), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))) ELSE [] END AS s FROM texts),
nodes AS (
    SELECT s, min(doc_id) AS node, len(s) AS n FROM sets GROUP BY s),
items AS (
    SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
    SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node GROUP BY a.node, b.node HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (
    SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (
    SELECT node, min(other) AS component FROM reached GROUP BY node)
SELECT doc_id, nodes.n::BIGINT AS n_shingles, CASE WHEN nodes.n = 0 THEN doc_id ELSE coalesce(component, nodes.node) END AS component_id,
       doc_id = CASE WHEN nodes.n = 0 THEN doc_id ELSE coalesce(component, nodes.node) END AS kept
FROM sets JOIN nodes USING (s) LEFT JOIN least ON least.node = nodes.node
"""
