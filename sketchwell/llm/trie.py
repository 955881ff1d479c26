"""The trie of conversation prefixes, with rollups over all subtrees.

A conversation c is rebuilt: the first h turns of conversation c - c % BASE (h is crc32 of c's digits,
modulo HEADS), then its own turns after its first h. A node is a distinct sequence of first turns. Its
digest is a sum, over its turns, of hashes of place, role and text (two lanes of 64 bits, in halves, so
that no sum overflows). Sums are taken in blocks of places, so a conversation of any length is spread
over tasks. One aggregation by digest, combined on the map side, gives a row per node.

A node's ancestors at the depths of LADDER name the shards that it may be in: it goes to the first of
at most SHARD_NODES nodes. A task takes a shard, or several small ones, into a succinct level-order
trie: a LOUDS bit vector and an array of labels in numpy. Parents and degrees are read off the bits, and
leaves and saved tokens roll up in reverse level order by add.at. Nodes above all shards, among them the
root, are heavy upper levels: they take the shards' tops' totals, and merge apart by doubling the
distance to the ancestor that totals are passed to, so that a chain of upper nodes takes few rounds.

Hashes of ends need all ids of a node in order: they are sorted in ranges and joined to chunks there,
and a node's chunks go through the hash one by one, not held together.

Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own.
Null role or text is empty. Rows of null conv_id are one conversation that keeps its own turns; it has
an id without digits that is the smallest only where no other is. A conversation may lose all turns: it
is then a member of the root alone. Very long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

BASE, HEADS = 5, 9
LADDER = (1, 2, 4, 8, 16, 32, 64)
SHARD_NODES = 100_000
#: Places in a block of a conversation; values of turn in a block of them; ids joined to a chunk.
PLACES, TURNS, CHUNK = 1024, 256, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

_HALF = 0xFFFFFFFF
_PIECES = ["s0", "s1", "s2", "s3"]


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, l0, l1, bytes): each turn's place in its conversation, two hashes of it, its text's size."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("_block", F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), F.lit(-(2**62))))
    counts = turns.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"), before.alias("_start"))
    place = F.row_number().over(W.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    rows = turns.select("conv_id", "_block", place.alias("_place"), *[F.xxhash64(F.lit(i), "role", "text").alias(f"l{i}") for i in (0, 1)], F.octet_length("text").cast("long").alias("bytes"))
    joined = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of")))
    return joined.select("conv_id", (F.col("_start") + F.col("_place")).alias("pos"), "l0", "l1", "bytes")


def plan(turns: DataFrame) -> DataFrame:
    """(conv_id, h, base, shift, length) of every conversation; shift is added to the places of its own turns."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    other = c.isNotNull() & (c % BASE != 0)
    h = F.when(other, F.crc32(c.cast("string").cast("binary")) % HEADS).otherwise(F.lit(0))
    convs = lengths.select("conv_id", "n", h.alias("h"), F.when(other, c - c % BASE).alias("base"))
    of_base = lengths.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n_base"))
    joined = convs.join(of_base, F.col("base") == F.col("_base"), "left")
    taken = F.least("h", F.coalesce("_n_base", F.lit(0)))
    return joined.select("conv_id", "h", "base", (taken - F.col("h")).alias("shift"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns of the rebuilt conversations: (conv_id, length, pos, l0, l1, bytes)."""
    rows = ["pos", "l0", "l1", "bytes"]
    donors = turns.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("_donor"), *rows)
    heads = convs.where("h > 0").join(donors, (F.col("base") == F.col("_donor")) & (F.col("pos") < F.col("h"))).select("conv_id", "length", *rows)
    named = convs.select(F.col("conv_id").alias("_conv"), "h", "shift", "length")
    own = turns.join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).where(F.col("pos") >= F.col("h"))
    return heads.unionByName(own.select("conv_id", "length", (F.col("pos") + F.col("shift")).alias("pos"), "l0", "l1", "bytes"))


def _lane(high: Column, low: Column) -> Column:
    half = lambda c: c.bitwiseAND(F.lit(_HALF))
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rebuilt turns with depth, digest (d0, d1), the parent's (p0, p1) and rungs: keys of the ancestors at LADDER's depths."""
    hashes = [F.xxhash64(F.lit(2 + i), "pos", "l0", "l1") for i in (0, 1)]
    pieces = [piece for x in hashes for piece in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_HALF)))]
    rows = turns.select("*", *[p.alias(s) for p, s in zip(pieces, _PIECES, strict=True)], F.floor(F.col("pos") / PLACES).alias("_block"))
    upto = lambda s, depth: F.sum(F.when(F.col("pos") < depth, F.col(s)))
    rung = lambda depth: F.when(F.max("pos") >= depth - 1, F.xxhash64(F.lit(depth), _lane(upto("s0", depth), upto("s1", depth)), _lane(upto("s2", depth), upto("s3", depth))))
    blocks = rows.groupBy("conv_id", "_block").agg(*[F.sum(s).alias(s) for s in _PIECES], F.array(*[rung(depth) for depth in LADDER]).alias("_rungs"))
    conv, earlier = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    first = F.first("_rungs").over(conv.orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow))
    starts = blocks.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"), first.alias("_rungs"), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}") for s in _PIECES])
    joined = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of")))
    running = W.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = joined.select("conv_id", "length", (F.col("pos") + 1).alias("depth"), "bytes", "_rungs", *_PIECES, *[(F.col(f"_{s}") + F.sum(s).over(running)).alias(f"t{s}") for s in _PIECES])
    here, above = [F.col(f"t{s}") for s in _PIECES], [F.col(f"t{s}") - F.col(s) for s in _PIECES]
    rungs = [F.when(F.col("depth") >= depth, F.col("_rungs")[i]).alias(f"r{i}") for i, depth in enumerate(LADDER)]
    return summed.select("conv_id", "length", "depth", "bytes", _lane(*here[:2]).alias("d0"), _lane(*here[2:]).alias("d1"), _lane(*above[:2]).alias("p0"), _lane(*above[2:]).alias("p1"), *rungs)


def _same_node(rows):
    """Runs of equal (d0, d1) in sorted Arrow batches: (d0, d1, first of run, batch, start, end)."""
    for batch in rows:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else ():
            yield int(keys[a, 0]), int(keys[a, 1]), batch, int(a), int(b)


def _chunks(batches):
    """(d0, d1, first id, ids joined by commas) of sorted (d0, d1, conv_id)."""
    names = ["d0", "d1", "first", "ids"]
    out: list[list] = [[], [], [], []]
    for d0, d1, batch, a, b in _same_node(batches):
        for i in range(a, b, CHUNK):
            ids = batch.column(2)[i : min(b, i + CHUNK)].to_pylist()
            for column, value in zip(out, (d0, d1, ids[0], ",".join("" if x is None else str(x) for x in ids)), strict=True):
                column.append(value)
        if len(out[0]) >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], "int64"), pa.array(out[1], "int64"), pa.array(out[2], "int64"), pa.array(out[3], "string")], names=names)
            out = [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(out[0], "int64"), pa.array(out[1], "int64"), pa.array(out[2], "int64"), pa.array(out[3], "string")], names=names)


def _hashed(batches):
    """(e0, e1, sha) of sorted (d0, d1, first, ids): a node's chunks go through one running hash."""
    at, sha, out = None, None, []

    def flush():
        arrays = [pa.array([r[0] for r in out], "int64"), pa.array([r[1] for r in out], "int64"), pa.array([r[2] for r in out], "string")]
        return pa.RecordBatch.from_arrays(arrays, names=["e0", "e1", "sha"])

    for d0, d1, batch, a, b in _same_node(batches):
        for i in range(a, b):
            ids = batch.column(3)[i].as_py().encode()
            if at == (d0, d1):
                sha.update(b"," + ids)
            else:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (d0, d1), hashlib.sha256(ids)
        if len(out) >= CHUNK:
            yield flush()
            out.clear()
    if at is not None:
        out.append((*at, sha.hexdigest()))
    yield flush()


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(e0, e1, sha) of every node at which conversations (d0, d1, conv_id) end."""
    ranged = ends.select("d0", "d1", F.col("conv_id").cast("long")).repartitionByRange("d0", "d1", "conv_id").sortWithinPartitions("d0", "d1", "conv_id")
    chunks = ranged.mapInArrow(_chunks, "d0 long, d1 long, first long, ids string")
    return chunks.repartition("d0", "d1").sortWithinPartitions("d0", "d1", F.col("first").asc_nulls_first()).mapInArrow(_hashed, "e0 long, e1 long, sha string")


class Louds:
    """A forest under a super-root, in level order: for each node as many ones as it has children, then a zero."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray):
        """degrees of the super-root and then of all nodes in level order; labels of the nodes."""
        self.bits = np.ones(int(degrees.sum()) + len(degrees), "u1")
        self.bits[np.cumsum(degrees + 1) - 1] = 0
        self.labels = labels

    def degrees(self) -> np.ndarray:
        """Children of each node, without the super-root."""
        return np.diff(np.flatnonzero(self.bits == 0))[: len(self.labels)] - 1

    def parents(self) -> np.ndarray:
        """The place of each node's parent, -1 under the super-root: zeros before the node's own one, less the super-root."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def levels(self) -> list[slice]:
        """Places of the nodes of each level."""
        degrees, found = self.degrees(), []
        first, end = 0, len(self.labels) - int(degrees.sum())
        reached = np.append(0, np.cumsum(degrees))
        tops = end
        while first < end:
            found.append(slice(first, end))
            first, end = end, tops + int(reached[end])
        return found

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (a row per node) over all subtrees."""
        total, parents = values.copy(), self.parents()
        for level in self.levels()[:0:-1]:
            np.add.at(total, parents[level], total[level])
        return total


def build(rel: np.ndarray, node: list[tuple], parent: list[tuple]) -> tuple[Louds, np.ndarray]:
    """The trie of nodes with depths rel under their shards' tops, and their order in it; node and parent are digests."""
    place_of = {d: i for i, d in enumerate(node)}
    above = np.array([place_of[p] if r else -1 for p, r in zip(parent, rel.tolist(), strict=True)], "i8")
    labels = np.array([d[0] for d in node], "i8")
    by_level = np.argsort(rel, kind="stable")
    cuts = np.searchsorted(rel[by_level], np.arange(int(rel.max()) + 2))
    rank, order = np.full(len(node) + 1, -1, "i8"), []
    used = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = by_level[a:b]
        rows = rows[np.lexsort((labels[rows], rank[above[rows]]))]
        rank[rows] = np.arange(used, used + len(rows))
        used += len(rows)
        order.append(rows)
    order = np.concatenate(order)
    places = np.where(above[order] < 0, 0, rank[above[order]] + 1)
    return Louds(np.bincount(places, minlength=len(node) + 1), labels[order]), order


_NODE = ["conv_id", "depth", "n_convs", "bytes", "sha", "d0", "d1", "p0", "p1"]
_DONE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, p0 long, p1 long, top boolean"


def _shards(batches):
    """_DONE rows of nodes sorted by shard; small shards share a trie."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solved(table: pa.Table):
        get = lambda c: table.column(c).to_numpy()
        d, p = list(zip(get("d0").tolist(), get("d1").tolist(), strict=True)), list(zip(get("p0").tolist(), get("p1").tolist(), strict=True))
        rel = get("depth") - get("rung")
        trie, order = build(rel, d, p)
        parents, degrees = trie.parents(), trie.degrees()
        n = get("n_convs")[order]
        total = trie.rollup(np.stack([degrees == 0, (n - 1) * get("bytes")[order]], axis=1).astype("i8"))
        table = table.take(pa.array(order))
        of_parent = table.column("conv_id").combine_chunks().take(pa.array(parents, mask=parents < 0))
        arrays = {"conv_id": table.column("conv_id"), "depth": table.column("depth"), "parent_conv_id": of_parent, "n_convs": table.column("n_convs"), "n_children": degrees, "n_leaves": total[:, 0], "saved_tokens": total[:, 1], "sha": table.column("sha"), "p0": table.column("p0"), "p1": table.column("p1"), "top": parents < 0}
        return pa.table(arrays).combine_chunks().to_batches()

    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        if not len(shard):
            continue
        if rows >= SHARD_NODES // 4:  # enough held: cut where the shard changes
            last = held[-1].column(batch.schema.get_field_index("shard"))[-1].as_py()
            other = np.flatnonzero(shard != last)
            cut = int(other[0]) if len(other) else len(shard)
            held.append(batch.slice(0, cut))
            if cut < len(shard):
                yield from solved(pa.Table.from_batches(held))
                held, rows, batch = [], 0, batch.slice(cut)
            else:
                continue
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from solved(pa.Table.from_batches(held))


def _sharded(nodes: DataFrame) -> DataFrame:
    """nodes with shard and rung (null for those of upper levels)."""
    rungs = [f"r{i}" for i in range(len(LADDER))]
    keys = nodes.select(F.explode(F.array(*rungs)).alias("key")).where("key IS NOT NULL")
    heavy = checkpointed(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_NODES).select("key"))
    light = [F.col(r).isNotNull() for r in rungs]
    if heavy.limit(1).count():
        for i, r in enumerate(rungs):  # Spark decides by size whether these few keys are broadcast
            nodes = nodes.join(heavy.select(F.col("key").alias(f"_h{i}")), F.col(r) == F.col(f"_h{i}"), "left")
        light = [ok & F.col(f"_h{i}").isNull() for i, ok in enumerate(light)]
    first = lambda values: F.coalesce(*[F.when(ok, v) for ok, v in zip(light, values, strict=True)])
    return nodes.select(*_NODE, first([F.col(r) for r in rungs]).alias("shard"), first([F.lit(d) for d in LADDER]).cast("long").alias("rung"))


def _upper(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """_DONE rows of upper nodes; tops are the shards' tops."""
    below = tops.groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
    inner = nodes.where("depth > 0").groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("_inner"))
    at = lambda df, tag: df.withColumnRenamed("p0", f"_{tag}0").withColumnRenamed("p1", f"_{tag}1")
    own = lambda tag: (F.col("d0") == F.col(f"_{tag}0")) & (F.col("d1") == F.col(f"_{tag}1"))
    joined = nodes.join(at(below, "b"), own("b"), "left").join(at(inner, "i"), own("i"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    children = zero(F.col("_children")) + zero(F.col("_inner"))
    state = joined.select(*_NODE, children.alias("n_children"), F.when(children == 0, 1).otherwise(zero(F.col("_leaves"))).cast("long").alias("n_leaves"), (zero(F.col("_saved")) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), *[F.when(F.col("depth") > 0, F.col(f"p{i}")).alias(f"j{i}") for i in (0, 1)])
    state = checkpointed(state)
    while state.where("j0 IS NOT NULL").limit(1).count():
        sent = state.where("j0 IS NOT NULL").groupBy("j0", "j1").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        sent = sent.select(F.col("j0").alias("_b0"), F.col("j1").alias("_b1"), "_leaves", "_saved")
        passed = state.join(sent, own("b"), "left").withColumn("n_leaves", F.col("n_leaves") + zero(F.col("_leaves"))).withColumn("saved_tokens", F.col("saved_tokens") + zero(F.col("_saved"))).drop("_b0", "_b1", "_leaves", "_saved")
        further = state.select(F.col("d0").alias("_b0"), F.col("d1").alias("_b1"), F.col("j0").alias("_j0"), F.col("j1").alias("_j1"))
        jumped = passed.join(further, (F.col("j0") == F.col("_b0")) & (F.col("j1") == F.col("_b1")), "left")
        state = checkpointed(jumped.drop("j0", "j1", "_b0", "_b1").withColumnRenamed("_j0", "j0").withColumnRenamed("_j1", "j1"))
    return state


def _with_parents(rows: DataFrame, upper: DataFrame) -> DataFrame:
    """rows (p0, p1, ...) with parent_conv_id from the upper nodes; the root, whose children may be most rows, is joined as one row."""
    of = upper.select("depth", F.col("d0").alias("_u0"), F.col("d1").alias("_u1"), F.col("conv_id").alias("_parent"))
    root = of.where("depth = 0").select(F.col("_u0").alias("_r0"), F.col("_u1").alias("_r1"), F.col("_parent").alias("_root"))
    at_root = (F.col("p0") == F.col("_r0")) & (F.col("p1") == F.col("_r1"))
    marked = rows.drop("parent_conv_id").crossJoin(F.broadcast(root))  # one row
    first = marked.where(at_root).withColumn("parent_conv_id", F.col("_root"))
    rest = marked.where(~at_root).join(of.where("depth > 0").drop("depth"), (F.col("p0") == F.col("_u0")) & (F.col("p1") == F.col("_u1"))).withColumn("parent_conv_id", F.col("_parent"))
    names = [f.split()[0] for f in _DONE.split(", ")]
    return first.select(*names).unionByName(rest.select(*names))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; conv_id must be a whole number."""
    turns = checkpointed(placed(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))))
    convs = checkpointed(plan(turns))
    rows = checkpointed(prefixes(rebuilt(turns, convs)))
    rungs = [F.max(f"r{i}").alias(f"r{i}") for i in range(len(LADDER))]
    nodes = rows.groupBy("d0", "d1").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p0").alias("p0"), F.max("p1").alias("p1"), *rungs)
    zero = F.lit(0).cast("long")
    none = [F.lit(None).cast("long").alias(f"r{i}") for i in range(len(LADDER))]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("d0"), zero.alias("d1"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), zero.alias("p0"), zero.alias("p1"), *none)
    ends = rows.where("depth = length").select("d0", "d1", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("d0"), zero.alias("d1"), "conv_id"))
    nodes = nodes.unionByName(root).join(ends_hashed(ends), (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1")), "left").drop("e0", "e1")
    nodes = checkpointed(_sharded(checkpointed(nodes)))
    light = nodes.where("shard IS NOT NULL").repartition("shard").sortWithinPartitions("shard")
    done = checkpointed(light.mapInArrow(_shards, _DONE))
    upper = _upper(nodes.where("shard IS NULL").drop("shard", "rung"), done.where("top"))
    names = [f.split()[0] for f in _DONE.split(", ")]
    inner = _with_parents(upper.where("depth > 0").withColumn("top", F.lit(False)), upper)
    whole = reduce(lambda a, b: a.unionByName(b), [done.where("NOT top"), _with_parents(done.where("top"), upper), inner, upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("top", F.lit(False)).select(*names)])
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of a short text, bit by bit; 3988292384 is the reversed polynomial.
_CRC_SQL = "xor(list_reduce([ord(x) for x in string_split({0}, '')], lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295)"

ORACLE_SQL = f"""
WITH turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
           coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
lengths AS (
    SELECT c, count(*) AS n FROM turns GROUP BY c),
convs AS (
    SELECT v.c, CASE WHEN v.c % {BASE} = 0 THEN 0 ELSE {_CRC_SQL.format("v.c::VARCHAR")} % {HEADS} END AS h, v.c - v.c % {BASE} AS base, coalesce(b.n, 0) AS n_base
    FROM lengths v LEFT JOIN lengths b ON b.c = v.c - v.c % {BASE}),
rebuilt AS (
    SELECT v.c, pos, r, t FROM convs v JOIN turns o ON o.c = v.base AND pos < h
    UNION ALL SELECT v.c, pos - h + least(h, n_base), r, t FROM convs v JOIN turns o ON o.c = v.c AND pos >= h),
sequences AS (
    SELECT convs.c, coalesce(s, []) AS s FROM convs LEFT JOIN (SELECT c, list([r, t] ORDER BY pos) AS s FROM rebuilt GROUP BY c) USING (c)),
prefixes AS (
    SELECT c, d, sha256(to_json(s[1:d])::VARCHAR) AS id, sha256(to_json(s[1:d - 1])::VARCHAR) AS above, s[d][2] AS t, d = len(s) AS ends
    FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM sequences)),
nodes AS (
    SELECT id, d AS depth, min(c) AS c, count(*) AS n, any_value(above) AS above, coalesce(max(strlen(t)), 0) AS bytes,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS sha FROM prefixes GROUP BY id, d),
children AS (
    SELECT above AS id, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
sums AS (
    SELECT p.id, count(*) FILTER (k.id IS NULL) AS leaves, sum((m.n - 1) * m.bytes) AS saved
    FROM nodes m JOIN prefixes p ON p.c = m.c AND p.d <= m.depth LEFT JOIN children k ON k.id = m.id GROUP BY p.id)
SELECT m.c AS conv_id, m.depth::BIGINT AS depth, up.c AS parent_conv_id, m.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, m.sha AS ends_sha256
FROM nodes m JOIN sums USING (id) LEFT JOIN children k ON k.id = m.id LEFT JOIN nodes up ON m.depth > 0 AND up.id = m.above
"""
