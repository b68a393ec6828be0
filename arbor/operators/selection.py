"""Exact order statistics by distributed selection.

The values are counted once per (group, value), a shuffle that is split by
value. A group with more than ``LEAF`` distinct values is cut by splitters, the
quantiles of a bounded sketch of its distinct values: every splitter is a
range of its own and so is every gap between two. Counting rows by range tells which
range holds each wanted rank; only those ranges are cut again, and a range
of at most ``LEAF`` distinct values is sorted. So no buffer and no task holds a
group's distinct values, a group with most of the rows is as good as any other,
and a value that fills a range by itself is found at once. A round shrinks a
range some ``PARTS``-fold, so 10^12 distinct values need about six.

The sketch only proposes splitters: the counts are exact, and so is the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.session import stage_table

#: Splitters of a range, the accuracy of the sketch that proposes them, and
#: the distinct values that one sort may hold.
PARTS, ACCURACY, LEAF = 64, 2000, 1 << 16
#: Tables of up to so many rows (one for each group or range) are broadcast.
SMALL = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (a stage table) with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _w): each distinct non-NULL value of each non-NULL key with its rows."""
    out = df.select(*keys, F.col(value).cast("double").alias("_v"))
    return out.na.drop(subset=[*keys, "_v"]).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))


def splitters(values: DataFrame, keys: Sequence[str], value: str, parts: Column | int = PARTS) -> DataFrame:
    """(keys, _cuts): sorted quantiles of a sketch, one array of at most
    ``PARTS`` + 1 values for each key."""
    every = F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)])
    return values.groupBy(*keys).agg(
        F.sort_array(F.array_distinct(F.percentile_approx(value, every, ACCURACY))).alias("_cuts"))


def place(value: Column, cuts: Column) -> Column:
    """Range of a value: odd for a splitter itself, even for the gaps between."""
    below = F.size(F.filter(cuts, lambda c: c < value))
    return 2 * below + F.array_contains(cuts, value).cast("int")


def _wanted(sizes: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, _q, _side, _part, _k): the two ranks around each quantile and the
    share of the upper one."""
    rows = []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(p))
        part = at - F.floor(at)
        rows += [F.struct(F.lit(i).alias("_q"), F.lit(side).alias("_side"), part.alias("_part"), rank.cast("long").alias("_k"))
                 for side, rank in ((0, F.floor(at)), (1, F.ceil(at)))]
    return sizes.select(*keys, F.inline(F.array(*rows)))


def order_stats(values: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, q0, q1, ...) of a stage table of :func:`counted`: linearly
    interpolated quantiles, as numpy and pandas give them."""
    keys = list(keys)
    sizes = values.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_values"))
    sizes = stage_table(sizes, "selection-sizes")
    need = _wanted(sizes, keys, probs).withColumn("_range", F.lit(""))
    rows, found, at = values.withColumn("_range", F.lit("")), None, [*keys, "_range"]
    width = sizes.select(*keys, F.lit("").alias("_range"), "_values")
    while True:
        widest = width.agg(F.max("_values")).first()[0] or 0
        if widest <= LEAF:
            part = _sorted(rows, need, at, keys)
        else:
            leaves = stage_table(width.where(F.col("_values") <= LEAF).drop("_values"), "selection-leaves")
            part = _sorted(rows.join(bounded(leaves), at), need, at, keys)
        found = part if found is None else found.unionByName(part)
        if widest <= LEAF:
            break
        wide = bounded(stage_table(width.where(F.col("_values") > LEAF).select(*at), "selection-wide"))
        rows, need, sure = _refined(rows.join(wide, at), need.join(wide, at), at, keys)
        found = found.unionByName(sure)
        width = stage_table(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_values")), "selection-widths")
    pair = found.groupBy(*keys, "_q").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_hi"), F.max("_part").alias("_part"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") * (1 - F.col("_part")) + F.col("_hi") * F.col("_part"))
    return pair.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, value)).alias(f"q{i}")
                                     for i in range(len(probs))])


def _sorted(rows: DataFrame, need: DataFrame, at: list[str], keys: list[str]) -> DataFrame:
    """The wanted ranks of ranges that one sort can hold."""
    upto = F.sum("_w").over(Window.partitionBy(*at).orderBy("_v"))
    ranked = rows.withColumn("_upto", upto)
    hit = (F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_w"))
    return ranked.join(need, at).where(hit).select(*keys, "_q", "_side", "_part", "_v")


def _refined(rows: DataFrame, need: DataFrame, at: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ranks) of the smaller ranges that hold wanted ranks, and the ranks
    that a splitter answers."""
    rows = stage_table(rows, "selection-rows")
    cuts = bounded(stage_table(splitters(rows, at, "_v"), "selection-cuts"))
    cut = rows.join(cuts, at).withColumn("_place", place(F.col("_v"), F.col("_cuts"))).drop("_cuts")
    cut = stage_table(cut, "selection-placed")
    counts = cut.groupBy(*at, "_place").agg(F.sum("_w").alias("_rows"), F.min("_v").alias("_v"))
    upto = F.sum("_rows").over(Window.partitionBy(*at).orderBy("_place"))  # at most 2 PARTS + 3 rows
    counts = counts.withColumn("_upto", upto)
    hit = (F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_rows"))
    hits = stage_table(counts.join(need, at).where(hit), "selection-hits")
    sure = hits.where(F.col("_place") % 2 == 1).select(*keys, "_q", "_side", "_part", "_v")
    open_ = hits.where(F.col("_place") % 2 == 0)
    name = F.concat_ws(".", "_range", F.col("_place").cast("string"))
    need = open_.select(*keys, "_q", "_side", "_part", (F.col("_k") - F.col("_upto") + F.col("_rows")).alias("_k"),
                        name.alias("_range"))
    ranges = stage_table(open_.select(*at, "_place").distinct(), "selection-ranges")
    rows = cut.join(bounded(ranges), [*at, "_place"]).select(*keys, "_v", "_w", name.alias("_range"))
    return rows, stage_table(need, "selection-need"), sure
