"""Window-style operators (survey 2.7) written for skewed keys.

A Spark window puts a whole partition key into one task. Where one key may
hold a large share of the rows (one department, one neighbourhood, one
duplicated id), each operator here has an aggregate form with partial
(map-side) aggregation, and joins its small per-key result back; AQE's
skew join splits a hot key on the large side of that join.

* ``lead_change``: the literal window (LEAD over a per-entity history).
* ``lead_change_sliced``: the same LEAD with histories cut by range
  partitioning, balanced when one entity holds a large share of the rows.
* ``mean_change``: the same per-entity mean change without a window: the
  changes telescope, so mean = (last - first) / (n - 1).
* ``rank_by``: RANK / DENSE_RANK from counts per distinct (key, value):
  the window runs over distinct values, never over raw rows, and over
  slices of equal depth where a key has many of them.
* ``dedupe_first`` / ``duplicated``: keep-first via ``min_by`` (partial
  aggregation), not ``row_number``.
* ``group_impute``: group median (exact selection) joined back, hot groups
  salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.operators.joins import salted_join
from arbor.operators.relational import round_ratio
from arbor.operators.selection import SMALL
from arbor.operators.stats import group_median
from arbor.session import stage_table


def sliced(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "_slice") -> DataFrame:
    """``df`` as a stage table with the number of a row's slice: Spark's range
    partitioning samples ``part`` and ``order`` and cuts the rows at splitters of
    equal depth, so a hot key is many slices and each holds about as many rows.
    Slices ascend with (part, order), NULLs first. ``df`` should be cheap to
    sample (a scan or a stage table)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_table(df.repartitionByRange(n, *part, *order).withColumn(name, F.spark_partition_id()), "slices")


def lead_change(df: DataFrame, part: Sequence[str], order: Sequence[str],
                value: str, next_name: str, change_name: str) -> DataFrame:
    """``win_lead`` + ``win_lead_diff``: next value per entity and the change
    to it, one window (one sort). ``order`` must end in a unique tie-break."""
    w = Window.partitionBy(*part).orderBy(*order)
    nxt = F.lead(F.col(value).cast("int")).over(w)
    return df.withColumns({next_name: nxt,
                           change_name: nxt - F.col(value).cast("int")})


def lead_change_sliced(df: DataFrame, part: Sequence[str], order: Sequence[str],
                       value: str, next_name: str, change_name: str) -> DataFrame:
    """LEAD per entity that stays balanced when one entity holds a large
    share of the rows.

    1. The rows are cut in :func:`sliced` pieces of equal depth, once.
    2. LEAD inside each (entity, slice).
    3. The first row of each (entity, slice), by partial aggregation, and
       from it the first row of the entity's next slice: a window over one
       row per slice, which the last row of a slice takes as its successor.

    Same result as :func:`lead_change` when ``order`` ends in a unique
    tie-break, however the rows are cut."""
    keys = [*part, "_slice"]
    rows = sliced(df.withColumn("_v", F.col(value).cast("int")), part, order)
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = rows.withColumn("_next", F.lead(F.struct("_v")).over(inside))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("_v"), F.struct(*order)).alias("_first"))
    succ = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.lead("_first").over(Window.partitionBy(*part).orderBy("_slice")).alias("_succ"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nxt = F.coalesce("_next", "_succ")["_v"]
    return (local.join(succ, same, "left").withColumns({next_name: nxt, change_name: nxt - F.col("_v")})
            .select(*df.columns, next_name, change_name))


def mean_change(df: DataFrame, key: Sequence[str], order: Sequence[str],
                value: str, name: str, digits: int | None = None) -> DataFrame:
    """Per-key mean of (next - current) along ``order`` without a window.

    sum(next_i - v_i) over consecutive rows equals v_last - v_first, so the
    mean of the n-1 changes is (v_last - v_first) / (n - 1), NULL for n = 1.
    ``min_by``/``max_by`` are partial aggregates: a key with a third of all
    rows is combined map-side before the shuffle."""
    o = F.struct(*[F.col(c) for c in order])
    v = F.col(value).cast("int")
    agg = df.groupBy(*key).agg(
        F.min_by(v, o).alias("_first"), F.max_by(v, o).alias("_last"),
        F.count(F.lit(1)).alias("_n"))
    steps = F.when(F.col("_n") > 1, F.col("_n") - 1)
    diff = F.col("_last") - F.col("_first")
    if digits is None:
        mean = F.try_divide(diff.cast("double"), steps)
    else:
        mean = round_ratio(diff, steps, digits)
    return agg.select(*key, mean.alias(name))


def rank_by(df: DataFrame, part: Sequence[str], value: str, descending: bool = True,
            rank_name: str | None = "rank", dense_name: str | None = None) -> DataFrame:
    """``win_rank`` / ``win_dense_rank`` without sorting raw rows per key.

    rank(v) = 1 + rows in the key ordered strictly before v;
    dense_rank(v) = position of v among the key's distinct values. Both are
    computed on ``(key, value, count)`` -- at most one row per distinct
    value per key -- and joined back on (key, value) null-safely. Returns
    ``df`` with the rank columns (bigint) added.

    More than ``SMALL`` such rows are cut in slices of equal depth; each
    (key, slice) is ranked by itself and lifted by what the slices before it hold,
    so no task sees all distinct values of a hot key."""
    counts = stage_table(df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_cnt")), "rank-counts")
    many = counts.count() > SMALL
    counts = sliced(counts, part, [value]) if many else counts.withColumn("_slice", F.lit(0))

    def order(c: str) -> Column:
        return F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first()

    w = Window.partitionBy(*part, "_slice").orderBy(order(value))
    before = F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.select(*part, value, "_slice", (F.coalesce(before, F.lit(0)) + 1).alias("_rank"),
                           F.row_number().over(w).alias("_dense"))
    if many:
        ranges = counts.groupBy(*part, "_slice").agg(F.sum("_cnt").alias("_rows"), F.count(F.lit(1)).alias("_values"))
        v = Window.partitionBy(*part).orderBy(order("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        lift = ranges.select(*part, "_slice", F.coalesce(F.sum("_rows").over(v), F.lit(0)).alias("_above"),
                             F.coalesce(F.sum("_values").over(v), F.lit(0)).alias("_levels"))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*part, "_slice"]]
        ranked = (ranked.alias("x").join(lift.alias("y"), same)
                  .select(*[f"x.{k}" for k in [*part, value]], (F.col("_rank") + F.col("_above")).alias("_rank"),
                          (F.col("_dense") + F.col("_levels")).alias("_dense")))
    cols = {}
    if rank_name:
        cols[rank_name] = F.col("r._rank").cast("bigint")
    if dense_name:
        cols[dense_name] = F.col("r._dense").cast("bigint")
    keys = list(part) + [value]
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = df.alias("l").join(ranked.alias("r"), cond, "inner")
    return joined.select("l.*", *[c.alias(n) for n, c in cols.items()])


def count_per_key(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """``win_count``: COUNT(*) OVER (PARTITION BY key) as a partial aggregate
    joined back (no per-key sort; hot keys handled by AQE skew join)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return df.alias("l").join(counts.alias("r"), cond, "inner").select("l.*", f"r.{name}")


def dedupe_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``win_dedupe_first``: first row per key by ``order`` (keep='first',
    R15), as ``min_by(struct(row), order)``: partial aggregation keeps one
    row per key per task before the shuffle."""
    others = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in others])
    kept = df.groupBy(*key).agg(F.min_by(row, F.col(order)).alias("_row"))
    return kept.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def keep_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``win_dedupe_first`` for an ``order`` without ties in a key: the least
    order per key is a partial hash aggregate of two columns, and a semi-join
    keeps its rows, so no other column is aggregated and all can be pruned.
    Rows with a NULL key are one group, as in :func:`dedupe_first`."""
    firsts = df.groupBy(*key).agg(F.min(order).alias("_first"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    cond.append(F.col(f"l.{order}").eqNullSafe(F.col("r._first")))
    return df.alias("l").join(firsts.alias("r"), cond, "left_semi").select(*[F.col(f"l.{c}") for c in df.columns])


def duplicated(df: DataFrame, key: Sequence[str], order: str,
               name: str = "duplicated") -> DataFrame:
    """``win_duplicated``: True on the 2nd and later occurrence of a key in
    ``order``. The first occurrence per key is a partial aggregate joined
    back."""
    firsts = df.groupBy(*key).agg(F.min(order).alias("_first"))
    j = df.alias("l").join(firsts.alias("r"),
                           [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key],
                           "inner")
    return j.select("l.*", (F.col(f"l.{order}") != F.col("r._first")).alias(name))


def group_impute(df: DataFrame, key: str, value: str,
                 method: str = "exact", keep_null_key: bool = False) -> DataFrame:
    """``win_group_impute``: fill NULL ``value`` with its group's median;
    rows with a NULL key get NULL (pandas transform, R8), or keep their own
    value with ``keep_null_key``. ``df`` is read three
    times (counts, median, rows): it should be a stage table."""
    med = group_median(df, [key], value, "_med", method)
    j = salted_join(df, med, [key], "left")
    own = F.col(value).cast("double")
    filled = F.when(F.col(key).isNull(), own if keep_null_key else F.lit(None).cast("double")).otherwise(
        F.coalesce(own, F.col("_med")))
    return j.withColumn(value, filled).drop("_med").select(*df.columns)


def top_n_per_key(df: DataFrame, part: Sequence[str], order: Sequence[Column],
                  n: int, name: str = "_rn") -> DataFrame:
    """Rows ranked 1..n per key. ``row_number() <= n`` lets Spark insert a
    per-task group limit before the shuffle, so a hot key ships at most n
    rows per task."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
