"""MinHash near-dedup with bottom-k sketches from one hash function.

Every shingle has one 64-bit hash. A document's sketch is the bottom of its
set in one order common to all documents: rare shingles first, by a table of
hashed counts over all documents, then by hash. Sets of n shingles with a
similarity of at least s share an element among the first
k = n - ceil(s * n) + 1 in any common order, so sketches of that k lose no link.

1. Documents with equal sets are one class; only one row of each goes on.
2. Inverted lists of the retained values give the pairs that overlap, at
   places in both sets that leave enough of each after them. Values that no
   other document can hold (their cell of the table counts one) are not listed.
3. The union sketch of a pair bounds its similarity from the number of values
   that both sketches hold, and bitmaps of the full sets bound it from the
   cells that only one of them fills; pairs that cannot reach s go. The rest
   are confirmed by exact Jaccard on full sets.
4. Links are joined to components by alternating star contraction.

The table has at most 2^28 cells: a bit for each cell that counts one, and a
byte for each 16 cells that orders by count, 48 MB in all. Over more than some
10^8 shingles its cells hold several each; their mean is common to all, so
what is lost is only the order among shingles whose counts differ by less than
its square root: lists get longer, links stay the same.

A value that many classes retain (a family of near copies) would give all
pairs of its list. Such a list first meets one member; members confirmed with
it are one component already, and only pairs across components go on. That is
exact, as a pair inside a component adds nothing to it. There are no caps.

Defined cases: null and empty texts have no shingles and are linked with
nothing; a text shorter than a shingle is one shingle; repeated rows and
copies are one class; a null id never names a component unless all ids of it
are null; an empty table gives no rows; extra columns are kept by ``dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import fresh, join_bounded, load, null_safe, ship_code, slices, stage_table, text_batches

#: Lists longer than this meet one member first.
LONG_LIST = 24
#: Rounds in which long lists that hold several components meet more members,
#: and how many members in each.
ROUNDS, PIVOTS = 2, 24
#: log2 of the count table's cells, at least and at most; of cells to one code.
LEAST_BITS, MOST_BITS, CODE_BITS = 16, 28, 4
#: The table is cut in this many slices, which are summed apart.
SLICES = 256
#: Bytes of text whose shingles a task counts before it emits slices.
TABLE_BYTES = 4 << 20
#: Tables of up to so many pairs of numbers are broadcast to the texts.
SMALL_ROWS = 1_000_000
#: Distinct words whose hashes a worker remembers between batches.
MEMORY = 60_000
_WORDS: dict[bytes, int] = {}


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > MEMORY:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    one = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ one[k:len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


# ---------------------------------------------------------- common order
def table_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Bits of the table, about one cell for each 2 code points of the corpus,
    and the number of tasks that fill it."""
    sizes = docs.select(F.length(text).alias("chars"), F.spark_partition_id().alias("part"))
    chars, last = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(chars / 2 + 1)))), last + 1


def count_table(docs: DataFrame, text: str, width: int, bits: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (document, shingle) by cell, the first bits of the hash: a
    bit for each cell that counts one, and for each 2^CODE_BITS cells a code of
    one byte that grows with their sum.

    Tasks emit sparse slices; slices are summed by Spark in two steps, so that
    no group holds more than the square root of all tasks' slices. The driver
    gets the packed table, at most 48 MB."""
    ship_code(docs.sparkSession)
    salts = max(1, math.isqrt(tasks))
    per = (1 << bits) // SLICES
    schema = "slice int, cells binary, n binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in slices(batches, "t", TABLE_BYTES):
            sets += [shingle_hashes(t or "", width) for t in batch.column("t").to_pylist()]
            held += batch.column("t").nbytes
            if held >= TABLE_BYTES:
                yield cut(sets)
                sets, held = [], 0
        if sets:
            yield cut(sets)

    def cut(sets: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
        cuts = np.searchsorted(cells.astype(np.int64), np.arange(SLICES + 1) * per)
        rows = [(k, x, y) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return pa.RecordBatch.from_pydict({
            "slice": pa.array([k for k, _, _ in rows], pa.int32()),
            "cells": pa.array([_planes(cells[x:y].astype(np.int64) - k * per, True) for k, x, y in rows],
                              pa.binary()),
            "n": pa.array([_planes(n[x:y], False) for _, x, y in rows], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for cells, n in zip(table.column("cells").to_pylist(), table.column("n").to_pylist()):
            total[_unplanes(cells, True)] += _unplanes(n, False)
        at = np.flatnonzero(total)
        return pa.table({"slice": table.column("slice").slice(0, 1), "cells": [_planes(at, True)],
                         "n": [_planes(np.minimum(total[at], 2**31), False)]},
                        schema=pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())]))

    parts = (docs.select(F.col(text).alias("t")).mapInArrow(emit, schema)
             .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))))
    parts = (parts.groupBy("slice", "salt").applyInArrow(merge, schema)
             .groupBy("slice").applyInArrow(merge, schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, codes = [], []
            for cells, n in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist()):
                cells, n = _unplanes(cells, True), _unplanes(n, False)
                one = np.zeros(per, np.uint8)
                one[cells[n == 1]] = 1
                ones.append(np.packbits(one, bitorder="little").tobytes())
                total = np.bincount(cells >> CODE_BITS, weights=n, minlength=per >> CODE_BITS)
                codes.append(_codes(total).tobytes())
            yield pa.RecordBatch.from_pydict({"slice": batch.column("slice"), "ones": pa.array(ones, pa.binary()),
                                              "codes": pa.array(codes, pa.binary())})

    ones, codes = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - CODE_BITS, np.uint8)
    with text_batches(docs.sparkSession):
        for row in parts.mapInArrow(pack, "slice int, ones binary, codes binary").toLocalIterator():
            for table, part in ((ones, row["ones"]), (codes, row["codes"])):
                table[row["slice"] * len(part):(row["slice"] + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return ones, codes


def _codes(n: np.ndarray) -> np.ndarray:
    """24 steps for each doubling from a 16th to 16 times the mean, and one for
    each doubling beyond it."""
    low = max(1.0, float(n.mean()) / 16)
    fine = 24 * np.log2(np.clip(n / low, 1, 256))
    coarse = np.log2(np.maximum(n / low / 256, 1))
    return np.minimum(fine + coarse, 255).astype(np.uint8)


def _planes(x: np.ndarray, deltas: bool) -> bytes:
    """Whole numbers as four planes of bytes, which compress well: small
    numbers leave three planes empty. ``deltas``: differences of sorted ones."""
    x = np.diff(x, prepend=0) if deltas else x
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes, deltas: bool) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(x) if deltas else x


# -------------------------------------------------------------- sketches
def sketches(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """One row per input row: rid, i, th (hash of the text), n, s1 and s2 (two
    digests of the set; null if empty), vals (retained values that another
    document may hold), places (theirs in the set's order) and bits (the cells
    of a bitmap that the set's values fall in)."""
    spark = docs.sparkSession
    bits, tasks = table_size(docs, text)
    table = spark.sparkContext.broadcast(count_table(docs, text, width, bits, tasks))  # at most 48 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ones, codes = table.value
        for batch in slices(batches, "t", 2 << 20):
            n, one, two, vals, places, maps = [], [], [], [], [], []
            for t in batch.column("t").to_pylist():
                found = shingle_hashes(t or "", width)
                raw = found.tobytes()
                n.append(found.size)
                one.append(_signed(xxhash.xxh3_64_intdigest(raw)) if raw else None)
                two.append(_signed(xxhash.xxh3_64_intdigest(raw, 1)) if raw else None)
                cell = (found >> np.uint64(64 - bits)).astype(np.int64)
                kept = found.size - (found.size * percent + 99) // 100 + 1
                keep = np.argsort(codes[cell >> CODE_BITS], kind="stable")[:kept]  # by code, then by hash
                cell = cell[keep]
                alone = (ones[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
                places.append(np.flatnonzero(alone == 0).astype(np.int32))
                vals.append(found[keep[places[-1]]].view(np.int64))
                maps.append(bitmap(found))
            ends = np.cumsum([0, *map(len, vals)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "i": batch.column("i"), "th": batch.column("th"), "n": pa.array(n, pa.int64()),
                "s1": pa.array(one, pa.int64()), "s2": pa.array(two, pa.int64()),
                "vals": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vals))),
                "places": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places))),
                "bits": pa.array(maps, pa.list_(pa.int64()))})

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = (docs.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
            .mapInArrow(run, f"i {kind}, th long, n long, s1 long, s2 long, vals array<long>, "
                             "places array<int>, bits array<long>"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "*")


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each value's cell, in 64-bit words: a power of two of them,
    with four cells to a value at least."""
    words = 1 << max(0, math.ceil(math.log2(max(found.size, 1) / 16)))
    flags = np.zeros(64 * words, np.uint8)
    flags[(found & np.uint64(64 * words - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(rid, hashes) for (rid, i, th): full sets from the rows with that id and
    text; a repeated row repeats its set."""
    texts = docs.select(F.col(doc_id).alias("di"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = join_bounded(texts, wanted, ["th"], "inner", SMALL_ROWS).where(F.col("i").eqNullSafe(F.col("di")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2 << 20):
            sets = [shingle_hashes(t or "", width).view(np.int64) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    return texts.select("rid", "t").mapInArrow(run, "rid long, hashes array<long>")


def confirm(docs: DataFrame, rows: DataFrame, pairs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose exact Jaccard reaches the limit."""
    ends = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    wanted = stage_table(rows.select("rid", "i", "th").join(ends, "rid", "left_semi"), "near-wanted")
    with text_batches(docs.sparkSession):
        full = stage_table(full_sets(docs, wanted, doc_id, text, width), "near-sets")
    one = full.select(F.col("rid").alias("a"), F.col("hashes").alias("ha"))
    two = full.select(F.col("rid").alias("b"), F.col("hashes").alias("hb"))
    both = (pairs.select("a", "b").join(one, "a").join(two, "b")
            .select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("inter"),
                    (F.size("ha") + F.size("hb")).cast("long").alias("total")))
    return both.where(100 * F.col("inter") >= percent * (F.col("total") - F.col("inter"))).select("a", "b").distinct()


# ------------------------------------------------------------ components
def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (c, comp): the smallest member of each linked node's component.

    Alternating large-star and small-star contraction; each round is two
    aggregations of minima joined back, and is written to the shared folder.
    A component of d members needs about log2(d) rounds."""
    edges = stage_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), "links-0")
    mark, rounds = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stage_table(large, f"links-large-{rounds}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        rounds += 1
        edges = stage_table(small, f"links-{rounds}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("c"), F.col("v").alias("comp"))


# -------------------------------------------------------------- the whole
def link_sets(docs: DataFrame, sets: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Distinct sets (rid, i, th, n, vals, places) -> (a, b): confirmed links,
    enough of them that their components are those of all links."""
    # a set too small to be similar to any other set is in no list
    able = sets.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    posts = (able.select(F.col("rid").alias("c"), "n", F.explode(F.arrays_zip("vals", "places")).alias("p"))
             .select("c", "n", F.col("p.vals").alias("val"), F.col("p.places").alias("at")))
    lists = posts.groupBy("val").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    posts = stage_table(posts.join(lists, "val"), "near-lists")
    grouped, known = posts.withColumn("g", F.col("c")), None
    for turn in range(1 + ROUNDS):
        stars = stage_table(_stars(grouped, turn, percent), "near-stars")
        if not stars.limit(1).count():
            break
        sure = stage_table(confirm(docs, sets, stars, doc_id, text, width, percent), "near-star-links")
        if not sure.limit(1).count():
            break
        edges = sure if known is None else sure.unionByName(
            known.select(F.col("c").alias("a"), F.col("comp").alias("b")))
        known = stage_table(components(edges), "near-star-components")
        grouped = join_bounded(posts, known, ["c"], "left", SMALL_ROWS)
        grouped = grouped.select("c", "n", "val", "at", "held", F.coalesce("comp", "c").alias("g"))
        if known.count() > SMALL_ROWS:  # else the broadcast join is read again, which shuffles nothing
            grouped = stage_table(grouped, "near-groups")
    posts = grouped
    if known is not None:
        mixed = posts.groupBy("val").agg(F.min("g").alias("g1"), F.max("g").alias("g2"))
        posts = posts.join(mixed.where(F.col("g1") != F.col("g2")).select("val"), "val", "left_semi")

    pairs = stage_table(_overlaps(posts, percent).distinct(), "near-overlaps")
    near = _both(pairs, sets, "bits").where(_reach(_common("na", "bits_a", "nb", "bits_b"), percent))
    pairs = stage_table(near.select("a", "b", "na", "nb"), "near-bitmaps")
    # union sketch: what both sketches hold, and at most all that lies beyond one of them
    beyond = F.greatest(_kept("na", percent), _kept("nb", percent)) - 1
    shared = F.size(F.array_intersect("vals_a", "vals_b"))
    pairs = stage_table(_both(pairs, sets, "vals").where(_reach(shared + beyond, percent)).select("a", "b"), "near-pairs")
    links = stage_table(confirm(docs, sets, pairs, doc_id, text, width, percent), "near-links")
    if known is not None:
        links = links.unionByName(known.select(F.col("c").alias("a"), F.col("comp").alias("b")))
    return links


def _stars(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): members a of the largest group of each long list with every
    member b outside that group. At first, when each is a group of its own, a
    is the one in most long lists; then several by a hash of theirs, which
    picks the same ones in lists that hold much the same members."""
    long = posts.where(F.col("held") > LONG_LIST)
    if turn == 0:
        often = long.groupBy("c").agg(F.count(F.lit(1)).alias("lists"))
        pivots = (long.join(often, "c").groupBy("val").agg(F.max(F.struct("lists", "c")).alias("best"))
                  .select("val", F.col("best.c").alias("a"), F.col("best.c").alias("top")))
    else:
        top = (long.groupBy("val", "g").agg(F.count(F.lit(1)).alias("n"), *[
                   F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + k), "c"), "c")).alias(f"p{k}")
                   for k in range(PIVOTS)])
               .groupBy("val").agg(F.max(F.struct("n", "g", *[F.col(f"p{k}.c").alias(f"c{k}")
                                                              for k in range(PIVOTS)])).alias("best")))
        pivots = top.select("val", F.col("best.g").alias("top"), F.explode(F.array_distinct(F.array(
            *[F.col(f"best.c{k}") for k in range(PIVOTS)]))).alias("a"))
    # a stands in the list itself, at its own place
    own = long.select("val", F.col("c").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    met = long.join(pivots, "val").where(F.col("g") != F.col("top"))
    met = met.select("val", "a", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    return met.join(own, ["val", "a"]).where(_first(percent)).select("a", "b").distinct()


def _overlaps(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) for each list that both are in, in different groups, at
    places that the first of a similar pair's common values can have."""
    left = posts.select("val", F.col("c").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("g").alias("ga"))
    right = posts.select("val", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("g").alias("gb"))
    return (left.join(right, "val").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _first(percent))
            .select("a", "b", "na", "nb"))


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both members, ``_a`` and ``_b``; rows of sets in
    no pair stay where they are."""
    ends = stage_table(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(),
                       "near-ends")
    met = join_bounded(sets.select("rid", column), ends, ["rid"], "left_semi", SMALL_ROWS)
    for end in ("a", "b"):
        pairs = pairs.join(met.select(F.col("rid").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _reach(overlap, percent: int):
    """Whether an overlap makes sets of na and nb similar."""
    return (100 + percent) * overlap >= percent * (F.col("na") + F.col("nb"))


def _first(percent: int):
    """Whether enough of both sets stands from their places on; sets of one
    size differ in one value at least."""
    most = F.least("na", "nb") - (F.col("na") == F.col("nb")).cast("int")
    return _reach(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"), most), percent)


def _common(na: str, ba: str, nb: str, bb: str):
    """At most so many values are in both sets: one whose cell the other's
    bitmap leaves empty is not. The larger of two bitmaps is folded once; sets
    of more different sizes are bounded by the smaller alone."""
    a, b = F.col(ba), F.col(bb)
    folded = [F.when(F.size(x) > F.size(y), F.zip_with(
        F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))).otherwise(x)
        for x, y in ((a, b), (b, a))]

    def apart(x, y):
        each = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(each, F.lit(0), lambda s, k: s + k)

    near = (F.size(a) <= 2 * F.size(b)) & (F.size(b) <= 2 * F.size(a))
    return F.when(near, F.least(F.col(na) - apart(*folded), F.col(nb) - apart(*folded[::-1]))).otherwise(F.least(na, nb))


def _kept(n: str, percent: int):
    """ceil(n * percent / 100) in whole numbers."""
    return F.floor((F.col(n) * percent + 99) / 100)


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """One row per input row: i, th, n, comp (null without shingles) and component_id."""
    sketched = sketches(docs, doc_id, text, width, percent)
    with text_batches(docs.sparkSession):
        rows = stage_table(sketched, "near-sketches")
    digest = ["s1", "s2"]  # 128 bits name a set
    classes = stage_table(rows.where(F.col("n") > 0).groupBy(*digest).agg(F.min("rid").alias("rid"), F.min("i").alias("i")),
                          "near-classes")
    copies = stage_table(rows.where(F.col("n") > 0).select("rid").join(classes.select("rid"), "rid", "left_anti"),
                         "near-copies")
    sets = join_bounded(rows.where(F.col("n") > 0), copies, ["rid"], "left_anti", SMALL_ROWS)
    comp = components(link_sets(docs, sets, doc_id, text, width, percent))
    named = stage_table(classes.join(comp.withColumnRenamed("c", "rid"), "rid", "left")
                        .select(*digest, "i", F.coalesce("comp", "rid").alias("comp")), "near-components")
    best = named.groupBy("comp").agg(F.min("i").alias("component_id"))
    named = named.join(best, "comp").select(*digest, "comp", "component_id")
    return rows.select("i", "th", "n", *digest).join(named, digest, "left").drop(*digest)


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                percent: int = 80) -> DataFrame:
    """One row per input row: id, th, n_shingles, component_id, kept."""
    found = _grouped(docs, doc_id, text, width, percent)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("i"))
    return found.select(F.col("i").alias(doc_id), "th", F.col("n").alias("n_shingles"), own.alias("component_id"),
                        own.eqNullSafe(F.col("i")).alias("kept"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5,
          percent: int = 80) -> DataFrame:
    """One document of each group, with all columns."""
    i, th, own, row = fresh(docs, "id", "th", "own_th", "row")
    found = _grouped(docs, doc_id, text, width, percent)
    # equal (id, text) rows are counted first, then the least of each component is chosen
    first = (found.where(F.col("n") > 0).groupBy("comp", "i", "th").agg(F.count(F.lit(1)).alias("rows"))
             .groupBy("comp").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "th", "rows")).alias("least"))
             .select("least.i", "least.th", "least.rows"))
    alone = (found.where(F.col("n") == 0).select("i", "th").distinct()
             .select("i", "th", F.lit(1).cast("long").alias("rows")))  # not grouped: all of them stay
    chosen = stage_table(first.unionByName(alone).select(F.col("i").alias(i), F.col("th").alias(th), "rows"),
                         "near-chosen")
    hashed = docs.withColumn(own, F.xxhash64(docs[text]))

    def rows_of(kept: DataFrame) -> DataFrame:
        return hashed.join(kept, null_safe(hashed, kept, [(doc_id, i)]) & (hashed[own] == kept[th]), "left_semi")

    out = rows_of(chosen.where(F.col("rows") == 1)).select(*docs.columns)
    again = chosen.where(F.col("rows") > 1)
    if not again.limit(1).count():
        return out
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))
    one = (rows_of(again).groupBy(F.col(doc_id).alias(i), F.col(own).alias(th))
           .agg(F.min_by(F.struct(*docs.columns), others).alias(row)))
    return out.unionByName(one.select(f"{row}.*"))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_groups(load(spark, sf_dir, "documents"), width=2, percent=80)
    return out.drop("th")
