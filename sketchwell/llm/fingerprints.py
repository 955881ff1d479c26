"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, DataFrame operations only.

A text's paragraphs are its lines, cut again behind a full stop and a space so that one-line texts
compare too; its digests are their distinct 64-bit hashes. A table has three rows of cells; a digest
is in one cell of each. A cell holds a count, and the xor of its digests and of their check hashes.
Tables of two versions subtract cell by cell. Peeling then takes cells that hold one digest (count 1
or -1 and a right check), takes that digest out of its other cells, and goes on until none is left.
If cells are left over it failed, and is tried again with larger tables.

A text's fingerprint is its table of FINGERPRINT cells a row, whatever its length, written out, so
that any two can be subtracted. Where their difference is too large for that, both texts' digests
are dealt by a hash over sections of about SECTION digests of both, whose tables are tried with
WIDTHS in turn; a section that fails at all of them is compared by its digests. Sections are rows of
their own, so that none filters all digests; they are exploded from one array that is made before, since an
explode copies whatever else its row holds for each digest (measured, two texts: 16,000 lines 19 s,
32,000 lines 20 s, 64,000 lines 30 s; with the arrays in the row 64,000 lines took 69 s on a faster day).
That array is never empty and the explode is an outer one: for an inner one Spark infers a filter on the
array's size, pushes it down to the texts and makes all digests, tables and peelings for it once more.

Null text counts as empty; empty text has no digest and an empty table, two of which are alike (1).
Repeated rows come one after the other: equal ids are ordered by a hash of their text; null ids come
first. A single row is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

#: Cells in each of a fingerprint's rows, and widths (powers of two) of sections' tables, tried in turn.
FINGERPRINT, WIDTHS = 8, (8, 16, 32, 128, 1024)
SECTION, ROUNDS = 16, 14
#: Rows that are put in order together; there are never more than so many such ranges.
RANGE_ROWS, MAX_RANGES, COARSE = 1_000, 100_000, 1_000


def digests(text: Column) -> Column:
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(". "), F.lit(".\n")), "\n", -1)
    return F.array_distinct(F.transform(F.filter(lines, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(h: Column) -> Column:
    return F.xxhash64(F.lit(97), h)


def _placed(h: Column, **more: Column) -> Column:
    """A digest with its check and, from its bits, its place in each of three rows; masks cut them to size."""
    bits = lambda n: F.shiftrightunsigned(h, n).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")
    return F.struct(*[v.alias(k) for k, v in more.items()], h.alias("k"), _check(h).alias("x"), bits(16).alias("r0"), bits(32).alias("r1"), bits(48).alias("r2"))


def _cell(count: Column, keys: Column, checks: Column) -> Column:
    return F.struct(count.alias("c"), keys.alias("k"), checks.alias("x"))


def _rows(make) -> Column:
    return F.struct(*[make(r).alias(r) for r in ("r0", "r1", "r2")])


def table(found: Column, mask: Column) -> Column:
    """The cells of an array of placed digests: three rows of mask + 1 cells."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda s, e: _cell(s["c"] + 1, s["k"].bitwiseXOR(e["k"]), s["x"].bitwiseXOR(e["x"]))
    return _rows(lambda r: F.transform(F.sequence(F.lit(0), mask), lambda i: F.aggregate(F.filter(found, lambda e: e[r].bitwiseAND(mask) == i), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    less = lambda p, q: _cell(p["c"] - q["c"], p["k"].bitwiseXOR(q["k"]), p["x"].bitwiseXOR(q["x"]))
    return _rows(lambda r: F.zip_with(a[r], b[r], less))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def peel(cells: Column, mask: Column) -> Column:
    """The digests of a subtracted table as (c: 1 or -1, k: digest); null if cells are left over."""
    none = F.expr("cast(array() as array<struct<c:int,k:bigint>>)")
    single = lambda c: (F.abs(c["c"]) == 1) & (c["x"] == _check(c["k"]))
    drop = lambda c, p: _cell(c["c"] - p["c"], c["k"].bitwiseXOR(p["k"]), c["x"].bitwiseXOR(p["x"]))
    short = lambda ps: F.transform(ps, lambda p: F.struct(p["c"].alias("c"), p["k"].alias("k")))

    def step(s: Column) -> Column:
        pure = F.array_distinct(F.transform(F.concat(*[F.filter(s["cells"][r], single) for r in ("r0", "r1", "r2")]), lambda c: _placed(c["k"], c=c["c"])))
        without = lambda ps: _rows(lambda r: F.transform(s["cells"][r], lambda c, i: F.aggregate(F.filter(ps, lambda p: p[r].bitwiseAND(mask) == i), c, drop)))
        return _let(pure, lambda ps: F.struct(F.when(F.size(ps) == 0, s["cells"]).otherwise(without(ps)).alias("cells"), F.concat(s["found"], short(ps)).alias("found"), (F.size(ps) > 0).alias("going")))

    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("going"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["going"], step(s)).otherwise(s))
    clean = lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["x"] == 0)
    return _let(end, lambda s: F.when(F.forall(s["cells"]["r0"], clean) & F.forall(s["cells"]["r1"], clean) & F.forall(s["cells"]["r2"], clean), s["found"]))


def of_digests(found: Column, width: int | Column) -> Column:
    """The table of an array of digests."""
    mask = F.lit(width - 1) if isinstance(width, int) else width - 1
    return _let(F.transform(found, lambda h: _placed(h)), lambda placed: table(placed, mask))


def difference(a: Column, b: Column) -> Column:
    """(c, k) of the digests in one of two short arrays only: c is 1 for those of a, -1 for those of b."""
    none = F.expr("cast(null as array<struct<c:int,k:bigint>>)")
    placed = F.struct(F.transform(a, lambda h: _placed(h)).alias("a"), F.transform(b, lambda h: _placed(h)).alias("b"))
    tried = lambda x: F.aggregate(F.array(*[F.lit(w - 1) for w in WIDTHS]), none, lambda done, m: F.when(done.isNotNull(), done).otherwise(peel(subtract(table(x["a"], m), table(x["b"], m)), m)))
    only = lambda x, y, sign: F.transform(F.array_except(x, y), lambda k: F.struct(F.lit(sign).alias("c"), k.alias("k")))
    return F.coalesce(_let(placed, tried), F.concat(only(a, b, 1), only(b, a, -1)))


def dealt(pair: int, a: Column, b: Column) -> Column:
    """The digests of two versions as (pair, section, c, k); c is 1 for a, -1 for b."""
    last = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), (F.size(a) + F.size(b)) / SECTION)))).cast("long") - 1
    of = lambda c, m: lambda h: F.struct(F.lit(pair).alias("pair"), F.xxhash64(F.lit(5), h).bitwiseAND(m).alias("section"), F.lit(c).alias("c"), h.alias("k"))
    return _let(last, lambda m: F.concat(F.transform(a, of(1, m)), F.transform(b, of(-1, m))))


def recovered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pair, section, found, kept): what tells the versions apart, section by section.

    rows are (keys, e, kept), e of `dealt`; kept is passed on where it is not null.
    """
    side = lambda c: F.transform(F.filter("_all", lambda e: e["c"] == c), lambda e: e["k"])
    held = rows.groupBy(*keys, "e.pair", "e.section").agg(F.collect_list(F.struct("e.c", "e.k")).alias("_all"), F.first("kept", ignorenulls=True).alias("kept"))
    return held.select(*keys, "pair", "section", difference(side(1), side(-1)).alias("found"), "kept")


def text_of(cells: Column) -> Column:
    """A table's cells as text: count, xor of digests and xor of checks in hexadecimal; rows apart by `;`."""
    cell = lambda c: F.concat_ws(":", F.hex(c["c"].cast("long")), F.hex(c["k"]), F.hex(c["x"]))
    row = lambda r: F.array_join(F.transform(r, cell), ",")
    return F.concat_ws(";", row(cells["r0"]), row(cells["r1"]), row(cells["r2"]))


def cells_of(text: Column) -> Column:
    """The table that text_of wrote."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    cell = lambda c: _let(F.split(c, ":"), lambda p: _cell(number(p[0]).cast("int"), number(p[1]), number(p[2])))
    return _let(F.split(text, ";"), lambda rows: F.struct(*[F.transform(F.split(rows[i], ","), cell).alias(r) for i, r in enumerate(("r0", "r1", "r2"))]))


def likeness(both: Column, differ: Column) -> Column:
    """Shared digests over all digests of two versions with so many in sum, so many of which are in one only."""
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def with_next(df: DataFrame, id_column: str, values: list[str]) -> DataFrame:
    """df with next_<v> of the next row in the order of the id (then of `_tie`), and the first row's behind the last.

    Rows are put in ranges of the id of about RANGE_ROWS rows; an id that many rows have is cut again
    by `_tie`. The first row of each range is copied to the end of the range before it, so that ranges
    can be ordered apart. Rows also get _range and _place, which tell them apart.
    """
    low = -(2**63)
    at = F.coalesce(F.col(id_column).cast("long"), F.lit(low))
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(id_column, [i / COARSE for i in range(COARSE + 1)], 20 * COARSE).alias("edges")).first()
    every = stats["edges"] or []
    edges, crowded = sorted(set(every)), {e for e, f in zip(every, every[1:], strict=False) if e == f}
    fine = max(1, min(stats["n"] // RANGE_ROWS, MAX_RANGES) // max(1, len(edges)))
    n_coarse = max(1, min(len(edges), stats["n"] // RANGE_ROWS))
    edges = sorted({*edges[:: max(1, len(edges) // n_coarse)], *crowded})
    known = F.array(*[F.lit(e) for e in edges]) if edges else F.expr("cast(array() as array<bigint>)")
    coarse = F.size(F.filter(known, lambda e: e <= at)) if edges else F.lit(0)
    start, stop = F.element_at(known, F.greatest(coarse, F.lit(1))), F.get(known, coarse)
    part = F.when((coarse > 0) & stop.isNotNull(), F.floor((at - start).cast("double") / (stop - start).cast("double") * fine)).otherwise(0).cast("int") if edges else F.lit(0)
    many = (at == low) | (F.array_contains(F.array(*[F.lit(e) for e in sorted(crowded)]), at) if crowded else F.lit(False))
    band = F.when(many, F.shiftright("_tie", 58).cast("int")).otherwise(0)  # the order of the hash
    ranged = df.withColumn("_at", at).withColumn("_range", F.struct(coarse.alias("a"), F.when(many, -1).otherwise(F.coalesce(part, F.lit(0))).alias("b"), band.alias("c")))
    value = F.struct(*[F.col(v) for v in values])
    firsts = ranged.groupBy("_range").agg(F.min_by(value, F.struct("_at", "_tie")).alias("_value"))
    order = firsts.select("_range").withColumn("_before", F.lag("_range").over(W.orderBy("_range")))  # one small row a range
    last = order.agg(F.max("_range").alias("_last"))
    order = order.crossJoin(F.broadcast(last)).select("_range", F.coalesce("_before", "_last").alias("_before"))
    copies = firsts.join(F.broadcast(order) if fine * len(edges) < 20_000 else order, "_range").select(F.col("_before").alias("_range"), "_value")
    rest = [c for c in df.columns if c not in values]
    rows = ranged.select("_range", F.struct(*[F.col(c) for c in rest]).alias("_rest"), value.alias("_value"), F.lit(0).alias("_copy"), "_at", "_tie")
    blank = F.lit(None).cast(rows.schema["_rest"].dataType)
    rows = rows.unionByName(copies.select("_range", blank.alias("_rest"), "_value", F.lit(1).alias("_copy"), F.lit(None).cast("long").alias("_at"), F.lit(None).cast("long").alias("_tie")))
    along = W.partitionBy("_range").orderBy("_copy", "_at", "_tie")
    following = rows.select("_range", "_rest", "_value", "_copy", F.lead("_value").over(along).alias("_next"), F.row_number().over(along).alias("_place")).where("_copy = 0")
    return following.select("_range", "_place", "_rest.*", "_value.*", *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])


def versions(df: DataFrame) -> DataFrame:
    """_range, _place, doc_id, text, edited, and digests of text, edited and the next text, of every whole text."""
    own = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    found = with_next(own, "doc_id", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = found.select("_range", "_place", "doc_id", "text", "next_text", edited.alias("edited"))
    return found.select("_range", "_place", "doc_id", "text", "edited", *[digests(F.col(c)).alias(d) for c, d in (("text", "d0"), ("edited", "d1"), ("next_text", "d2"))])


def compare(found: DataFrame) -> DataFrame:
    """A row per row of `versions`: doc_id, n_chars, hash of the edited text, fingerprints, and both likenesses.

    Versions whose fingerprints subtract and peel are done with; others go on by sections, in the
    same tasks, since rows stay in their range.
    """
    tables = found.select("_range", "_place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "d0", "d1", "d2", *[of_digests(F.col(f"d{i}"), FINGERPRINT).alias(f"t{i}") for i in range(3)])
    first = lambda i: F.array_size(peel(subtract(F.col("t0"), F.col(f"t{i}")), F.lit(FINGERPRINT - 1)))
    done = tables.select("*", *[F.when(F.col("d0") == F.col(f"d{i}"), F.lit(0)).otherwise(first(i)).alias(f"near_{i}") for i in (1, 2)])
    kept = F.struct("doc_id", "n_chars", "edited_sha256", text_of(F.col("t0")).alias("fingerprint"), text_of(F.col("t1")).alias("edited_fingerprint"), *[(F.size("d0") + F.size(f"d{i}")).alias(f"both_{i}") for i in (1, 2)], "near_1", "near_2")
    none = F.expr("cast(array() as array<struct<pair:int,section:bigint,c:int,k:bigint>>)")
    failed = [F.when(F.col(f"near_{i}").isNull(), dealt(i, F.col("d0"), F.col(f"d{i}"))).otherwise(none) for i in (1, 2)]
    own = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).cast("long").alias("section"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("k")))
    ready = done.select("_range", "_place", kept.alias("_kept"), F.concat(own, *failed).alias("_all"))  # no other array goes into the explode
    rows = ready.select("_range", "_place", "_kept", F.explode_outer("_all").alias("e"))
    rows = rows.select("_range", "_place", "e", F.when(F.col("e.pair") == 0, F.col("_kept")).alias("kept"))
    found = recovered(rows, ["_range", "_place"])
    sums = [F.sum(F.when(F.col("pair") == i, F.size("found"))).alias(f"_far_{i}") for i in (1, 2)]
    by_row = found.groupBy("_range", "_place").agg(F.first("kept", ignorenulls=True).alias("kept"), *sums)
    near = lambda i: likeness(F.col(f"kept.both_{i}"), F.coalesce(F.col(f"kept.near_{i}"), F.col(f"_far_{i}")))
    return by_row.select("kept.doc_id", "kept.n_chars", "kept.edited_sha256", "kept.fingerprint", "kept.edited_fingerprint", near(1).alias("near_edited"), near(2).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(versions(documents(spark, sf_dir)))
