"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash of its id, and behind it one of its id,
its text and its number among equal rows, which orders rows that share an id.
A source's budget of words is met by a threshold on both: sizes are summed by
source and hash bucket, the bucket in which the running sum passes the budget
is found, and only that boundary bucket is refined, until it is one value of
both hashes. Documents under the threshold are taken by a filter; no document is sorted. What is left of a
budget is filled the same way among the documents not taken that still fit.

A target above a source's size repeats the whole source and fills the rest by
a threshold, up to ``max_repeats`` times.

Defined cases: a null text has size 0; a null source is a source of its own,
last; a null id hashes as the word ``null``; rows with equal ids are taken one
by one (the SQL oracle takes them together, so it holds for distinct ids);
of rows with equal id, source and text ``mix`` takes the first by their other
columns as text, with a window over the rows at the boundary only; documents of size 0 cost nothing and are taken with
their bucket; an empty table gives no rows. Extra columns are kept by ``mix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import WORDS, fresh, load, null_safe, stage_table

BITS, STEP = 60, 12
#: Rounds that fill what is left of a budget with documents that still fit.
FILLS = 3
#: Equal rows are counted, then numbered in blocks of this many.
BLOCK = 10_000


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    return _first60(_id_text(doc_id))


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _first60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _facts(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(i, key, size, th, h, g): a row for each document; ``th`` is the hash of
    its text and ``g`` orders rows of one ``h``. Equal rows are counted and
    numbered by an explode of the count, so no row is sorted."""
    units = (docs.select(F.col(doc_id).alias("i"), F.col(source).alias("key"), n_words(F.col(text)).alias("size"),
                         F.xxhash64(text).alias("th"))
             .groupBy("i", "key", "size", "th").agg(F.count(F.lit(1)).alias("n")))
    last = F.col("n") - 1
    begin = F.col("block") * BLOCK
    rows = units.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK))))
    rows = rows.withColumn("copy", F.explode(F.sequence(begin, F.least(begin + BLOCK - 1, last))))
    return rows.select("i", "key", "size", "th", hash60(F.col("i")).alias("h"),
                       _first60(F.concat_ws(":", _id_text(F.col("i")), "th", "copy")).alias("g"))


def _under(cut: Column, cut_g: Column) -> Column:
    """Whether a row's two hashes stand before the threshold."""
    return (F.col("h") < cut) | ((F.col("h") == cut) & (F.col("g") < cut_g))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3,
            share: int = 100) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share ``share`` per cent of all words; a target stops at ``max_repeats``
    times its source, and the excess is shared again by weight. In closed form:
    in order of limit / weight, the first sources stop at their limits, and
    the others have one common target per weight. The windows run over one
    row for each source.
    """
    cap, w = F.col("cap"), F.col("w")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    rows = sizes.select("source", "source_size", weight.alias("w"),
                        (F.col("source_size") * max_repeats).alias("cap"))
    total = F.sum("source_size").over(Window.partitionBy()) * share / 100
    ratio = Window.orderBy(cap / w, F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select("source", "source_size", "w", "cap", total.alias("total"),
                       F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("used"),
                       F.sum("w").over(after).alias("open"))
    # the first source that can take its share of what is left sets the level
    level = F.struct((F.col("total") - F.col("used")).alias("left"), F.col("open").alias("open"))
    fits = cap.cast("double") * F.col("open") >= w * (F.col("total") - F.col("used"))
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("used"), level))).over(Window.partitionBy()))
    goal = w * F.col("level.col2.left") / F.col("level.col2.open")
    return rows.select("source", "source_size",
                       F.least(cap.cast("double"), F.coalesce(goal, cap.cast("double"))).alias("target"))


def thresholds(units: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, h, g, size), (key, budget) -> (key, cut, cut_g, got): the documents
    of the key with (h, g) < (cut, cut_g) are as many as the budget holds; they
    sum to got.

    ``key`` may be null. Each level is one aggregation by key and bucket; the
    levels of h come first, then those of g inside one h.
    """
    state = budgets.select("key", "budget", F.lit(0).cast("long").alias("prefix"),
                           F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("got"))
    closed, half = [], BITS // STEP
    for level in range(2 * half):
        first = level < half
        shift = BITS - STEP * (level % half + 1)
        open_keys = state.count()
        if level and not open_keys:
            break
        k = state.select(F.col("key").alias("k"), "budget", "prefix", "at", "got")
        inside = units.join(F.broadcast(k) if open_keys <= 100_000 else k,
                            units["key"].eqNullSafe(F.col("k")))
        if not first:
            inside = inside.where(F.col("h") == F.col("at"))
        if level % half:
            inside = inside.where(F.shiftright("h" if first else "g", shift + STEP) == F.col("prefix"))
        place = F.struct("h", "g")
        hist = (inside.groupBy("key", "budget", "got", F.shiftright("h" if first else "g", shift).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min(place).alias("lo"), F.max(place).alias("hi")))
        run = Window.partitionBy("key").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("got") + F.sum("words").over(run))
        over = F.col("upto") > F.col("budget")
        found = stage_table(hist.groupBy("key", "budget").agg(
            F.min(F.when(over, F.struct("bucket", "lo", "hi"))).alias("edge"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.max("got")).alias("got")), f"mix-level-{level}")
        # all fits, or the boundary bucket is one value of both hashes: done
        done = F.col("edge").isNull() | (F.col("edge.lo") == F.col("edge.hi"))
        if level == 2 * half - 1:
            done = F.lit(True)
        closed.append(found.where(done).select(
            "key", F.coalesce("edge.lo.h", F.lit(1 << BITS)).alias("cut"),
            F.coalesce("edge.lo.g", F.lit(0)).cast("long").alias("cut_g"), "got"))
        state = found.where(~done).select("key", "budget", F.col("edge.bucket").alias("prefix"),
                                          F.col("edge.lo.h").alias("at"), "got")
    return reduce(DataFrame.unionByName, closed)


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats."""
    return _planned(docs, doc_id, text, source, weights, max_repeats).select(
        F.col("i").alias(doc_id), F.col("key").alias(source), "size", "source_size", "target", "repeats")


def _planned(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...],
             max_repeats: int) -> DataFrame:
    """(i, key, th, size, source_size, target, repeats) of each document."""
    facts = stage_table(_facts(docs, doc_id, text, source), "mix-facts")
    sizes = facts.groupBy(F.col("key").alias("source")).agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, max_repeats)
    full = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    goal = goal.withColumn("full", full)
    rest = F.when(F.col("full") < max_repeats, F.col("target") - F.col("full") * F.col("source_size")).otherwise(0.0)
    goal = stage_table(goal.select(F.col("source").alias("key"), "source_size", "target", "full",
                                   rest.alias("budget")), "mix-targets")
    left, open_, cuts = goal.select("key", "budget"), facts, []
    for _ in range(1 + FILLS):
        cut = stage_table(
            thresholds(open_, left).join(left.withColumnRenamed("key", "k"),
                                         F.col("key").eqNullSafe(F.col("k")))
            .select(F.col("key").alias("k"), "cut", "cut_g", F.col("budget").alias("fit"),
                    (F.col("budget") - F.col("got")).alias("budget")), "mix-cuts")
        cuts.append(cut)
        left = cut.select(F.col("k").alias("key"), "budget")
        # what may still fill: not taken, and no larger than what is left
        open_ = (_with(open_, cut)
                 .where(~_under(F.col("cut"), F.col("cut_g")) & (F.col("size") <= F.col("budget")))
                 .select("key", "size", "h", "g"))
    marks = facts.withColumn("taken", F.lit(False))
    for n, cut in enumerate(cuts):
        fits = F.lit(True) if n == 0 else F.col("size") <= F.col("fit")
        low = _under(F.coalesce("cut", F.lit(0)), F.coalesce("cut_g", F.lit(0)))
        marks = (_with(marks, cut.select("k", "cut", "cut_g", "fit"))
                 .select("i", "key", "th", "size", "h", "g", (F.col("taken") | (fits & low)).alias("taken")))
    goal = goal.withColumnRenamed("key", "k")
    return (_with(marks, goal)
            .select("i", "key", "th", "size", "source_size", "target",
                    F.least(F.col("full") + F.col("taken").cast("long"), F.lit(max_repeats)).alias("repeats")))


def _with(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Join a stage table of one row per source on its null-safe key ``k``;
    broadcast where it is counted small, else left to AQE."""
    small = F.broadcast(by_source) if by_source.count() <= 100_000 else by_source
    return rows.join(small, F.col("key").eqNullSafe(F.col("k")), "left")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    i, k, th, n, more, own, place, each = fresh(docs, "mix_id", "mix_source", "mix_th", "mix_repeats", "mix_more",
                                                "mix_own_th", "mix_place", "mix_copy")
    chosen = _planned(docs, doc_id, text, source, weights, max_repeats)
    # equal rows: all are taken ``n`` times, and the first ``more`` of them once more
    chosen = stage_table(
        chosen.groupBy(F.col("i").alias(i), F.col("key").alias(k), F.col("th").alias(th))
        .agg(F.min("repeats").alias(n), F.sum("repeats").alias("all"), F.count(F.lit(1)).alias("rows"))
        .select(i, k, th, n, (F.col("all") - F.col(n) * F.col("rows")).alias(more))
        .where((F.col(n) > 0) | (F.col(more) > 0)), "mix-chosen")
    hashed = docs.withColumn(own, F.xxhash64(docs[text]))

    def rows_of(part: DataFrame) -> DataFrame:
        return hashed.join(part, null_safe(hashed, part, [(doc_id, i), (source, k)]) & (hashed[own] == part[th]))

    out = rows_of(chosen.where(F.col(more) == 0)).select(*docs.columns, n)
    split = chosen.where(F.col(more) > 0)
    if split.limit(1).count():
        others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))
        at = F.row_number().over(Window.partitionBy(i, k, th).orderBy(others))
        out = out.unionByName(rows_of(split).withColumn(place, at).select(
            *docs.columns, (F.col(n) + (F.col(place) <= F.col(more)).cast("long")).alias(n)).where(F.col(n) > 0))
    return (out.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
            .select(*docs.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = plan(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("repeats")).alias("taken"))
