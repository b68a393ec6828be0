"""Statistics layer (survey 2.6): Pearson, correlation matrix, descriptive
summary, value counts, distinct and NULL counts, equal-width histograms,
binned Gaussian density, Tukey box statistics, empirical-rule ranges.

Plan shape rules used throughout:

* every rule table (pairs, columns, flags) goes into ONE ``agg`` or one
  ``unpivot`` + ``groupBy``; no action per column;
* aggregates are algebraic (sum/count/min/max) so Spark runs them as a
  partial (map-side) + final ``HashAggregate``;
* exact quantiles first pre-aggregate to ``(group, value, count)`` so that
  the shuffle is split by value, then select the wanted ranks by ranges
  (:mod:`arbor.operators.selection`): no buffer holds a group's values;
  ``method="approx"`` switches to ``percentile_approx`` (a bounded sketch)
  where one cheap pass is enough;
* per-series bounds for histograms are a small table with one row per
  series (bounded by the number of series), joined on the series key;
* reported statistics are rounded to ``digits`` places (default 6) so
  results are stable across summation orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.operators.selection import bounded, counted, order_stats
from arbor.session import stage_table

DIGITS = 6


def _r(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


# ---------------------------------------------------------------- Pearson
def _pearson_expr(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs from three mergeable centred co-moments
    (R3), stable whatever the mean; NULL when a side is constant (its sum of
    squares is then exactly 0, R2)."""
    xd, yd = x.cast("double"), y.cast("double")
    return F.try_divide(F.regr_sxy(yd, xd), F.sqrt(F.regr_sxx(yd, xd)) * F.sqrt(F.regr_syy(yd, xd)))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]],
            digits: int | None = None) -> DataFrame:
    """``agg_pearson`` / ``udf_proc_pearson``: one row per (x, y) pair with
    ``PearsonCorrelation``, all pairs computed in a single aggregation."""
    aggs = [_pearson_expr(F.col(x), F.col(y)).alias(f"r{i}")
            for i, (x, y) in enumerate(pairs)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{x}', '{y}', r{i}" for i, (x, y) in enumerate(pairs))
    return wide.selectExpr(
        f"stack({len(pairs)}, {stack}) AS (ColumnX, ColumnY, PearsonCorrelation)"
    ).withColumn("PearsonCorrelation", _r(F.col("PearsonCorrelation"), digits))


def corr_matrix(df: DataFrame, cols: Sequence[str],
                digits: int | None = DIGITS) -> DataFrame:
    """``agg_corr_matrix``: all ordered pairs (col_a, col_b, r), long form,
    from one read and one row of co-moments a task: a mergeable centred
    co-moment with pairwise-complete counts for each pair of the upper triangle
    (r is symmetric, the diagonal is 1 unless the column is constant)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[_pearson_expr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), _r(F.col(f"r{i}"), digits).alias("r"))
             for i, (a, b) in enumerate(pairs) for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])]
    return wide.select(F.inline(F.array(*cells)))


# ---------------------------------------------------------------- unpivot
def long_values(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
                name: str = "series", value: str = "value",
                cast: str = "double") -> DataFrame:
    """Unpivot numeric columns to (ids..., series, value); NULL values kept."""
    src = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return src.unpivot(list(ids), list(cols), name, value)


# ---------------------------------------------------------------- quantiles
def quantiles(df: DataFrame, group_cols: Sequence[str], value: str,
              probs: Sequence[float], method: str = "exact",
              accuracy: int = 100000) -> DataFrame:
    """Linear-interpolated quantiles per group (numpy/pandas default).

    Returns ``group_cols + [q0, q1, ...]`` (double). NULL values and NULL
    group keys are skipped (pandas ``groupby``, R8)."""
    if method == "approx":
        keyed = df.select(*group_cols, F.col(value).cast("double").alias("_v")).na.drop()
        parr = F.array(*[F.lit(float(p)) for p in probs])
        agg = keyed.groupBy(*group_cols).agg(F.percentile_approx("_v", parr, accuracy).alias("_q"))
        return agg.select(*group_cols, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])
    return order_stats(stage_table(counted(df, group_cols, value), "quantile-values"), group_cols, probs)


def group_median(df: DataFrame, group_cols: Sequence[str], value: str,
                 name: str = "median", method: str = "exact") -> DataFrame:
    """``agg_group_median``: exact median per group (NULLs skipped)."""
    return quantiles(df, group_cols, value, [0.5], method).withColumnRenamed("q0", name)


# ---------------------------------------------------------------- describe
def describe(df: DataFrame, cols: Sequence[str], digits: int | None = DIGITS,
             method: str = "exact") -> DataFrame:
    """``agg_describe``: count, mean, std (sample), min, 25%, 50%, 75%, max
    per column, long form, with interpolated quartiles (R6). The input is read
    once: all of it comes from one table of (column, value, count)."""
    values = stage_table(counted(long_values(df, cols), ["series"], "value"), "describe-values")
    v, w = F.col("_v"), F.col("_w")
    sums = bounded(stage_table(values.groupBy("series").agg(
        F.sum(w).alias("count"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.min(v).alias("min"),
        F.max(v).alias("max")), "describe-sums"))
    gap = v - F.col("mean")
    spread = values.join(sums, "series").groupBy("series", "count", "mean", "min", "max").agg(
        F.try_divide(F.sum(gap * gap * w), F.col("count") - 1).alias("var"))
    moments = spread.withColumn("std", F.sqrt("var"))
    probs = [0.25, 0.5, 0.75]
    qs = order_stats(values, ["series"], probs) if method == "exact" else \
        quantiles(long_values(df, cols), ["series"], "value", probs, method)
    out = moments.join(qs, "series", "inner")
    return out.select(
        F.col("series").alias("column"), "count",
        _r(F.col("mean"), digits).alias("mean"),
        _r(F.col("std"), digits).alias("std"),
        _r(F.col("min"), digits).alias("min"),
        _r(F.col("q0"), digits).alias("q25"),
        _r(F.col("q1"), digits).alias("q50"),
        _r(F.col("q2"), digits).alias("q75"),
        _r(F.col("max"), digits).alias("max"),
    )


# ---------------------------------------------------------------- counts
def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``agg_value_counts`` / ``agg_cat_hist``: frequency of each non-NULL
    value, long form (column, value, count), one shuffle for all columns, by
    column and descending count (ties by value)."""
    src = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    lv = src.unpivot([], list(cols), "column", "value")
    return (lv.filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
              .orderBy("column", F.desc("count"), "value"))


def nunique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """``agg_nunique``: distinct non-NULL values per column (long form).

    Exact form: unpivot + distinct (value, column) + count, which spreads a
    wide column over all shuffle partitions instead of one Expand per
    column. ``approx=True`` uses HyperLogLog++ (one partial aggregation)."""
    src = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    if approx:
        wide = src.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return wide.unpivot([], list(cols), "column", "nunique")
    lv = src.unpivot([], list(cols), "column", "value").filter(F.col("value").isNotNull())
    return (lv.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique")))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``agg_null_count``: NULL count per column in one aggregation."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


def bool_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``agg_bool_hist``: True/False counts for many flags in one pass."""
    src = df.select(*[F.col(f).cast("boolean").alias(f) for f in flags])
    lv = src.unpivot([], list(flags), "feature", "value")
    return (lv.filter(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- histograms
def _bounds(lv: DataFrame, spec: dict[str, int]) -> DataFrame:
    """Per series: numpy edges range, [min, max] (or +-0.5 if constant)."""
    mm = lv.groupBy("series").agg(F.min("value").alias("_mn"),
                                  F.max("value").alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    bins = F.create_map(*[F.lit(x) for k, v in spec.items() for x in (k, int(v))])
    return mm.select(
        "series", F.element_at(bins, F.col("series")).alias("nbins"),
        F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))


def histograms(df: DataFrame, spec: dict[str, int], digits: int | None = DIGITS) -> DataFrame:
    """``agg_histogram``: equal-width bins over [min, max] per column, the
    last bin closed on the right (numpy, R10). Empty bins are listed with
    count 0. Long form: series, bin, lo, hi, count.

    Unpivot -> broadcast of the per-series bounds (one row per column of
    ``spec``, a bound by construction) -> bin index -> ``groupBy(series,
    bin)`` (partial aggregation, so at most ``bins`` rows per series leave
    each task; raw rows are not shuffled)."""
    lv = long_values(df, list(spec)).filter(F.col("value").isNotNull())
    bounds = _bounds(lv, spec)
    width = (F.col("hi") - F.col("lo")) / F.col("nbins")
    idx = F.least(F.floor((F.col("value") - F.col("lo")) / width).cast("int"),
                  F.col("nbins") - 1)
    counts = (lv.join(F.broadcast(bounds), "series", "inner")
                .select("series", idx.alias("bin"))
                .groupBy("series", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = bounds.select("series", "lo", "hi", "nbins",
                         F.explode(F.sequence(F.lit(0), F.col("nbins") - 1)).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.col("nbins")
    return (grid.join(counts, ["series", "bin"], "left")
                .select("series", "bin",
                        _r(F.col("lo") + F.col("bin") * w, digits).alias("lo"),
                        _r(F.when(F.col("bin") == F.col("nbins") - 1, F.col("hi"))
                            .otherwise(F.col("lo") + (F.col("bin") + 1) * w), digits).alias("hi"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def kde(df: DataFrame, cols: Sequence[str], grid: int = 200,
        digits: int | None = DIGITS) -> DataFrame:
    """``agg_kde``: Gaussian density per column on a ``grid``-point grid over
    [min, max], Scott's rule bandwidth (n^-1/5 * sample std).

    Values are counted in bins first, and the density is evaluated from bin
    centres weighted by counts. The bin width follows the bandwidth: the
    largest power of two up to a quarter of it, so the error stays below 1 %
    of the peak however many rows there are, and ``floor(value / width)`` is
    exact in any engine. The moments have one row per column, a bound by
    construction, and are broadcast: only (series, bin) counts are shuffled.
    A column without spread has no density and gives no rows.
    Long form: series, point, x, density."""
    lv = long_values(df, cols).filter(F.col("value").isNotNull())
    mom = lv.groupBy("series").agg(F.count(F.lit(1)).alias("n"),
                                   F.stddev_samp("value").alias("sd"),
                                   F.min("value").alias("mn"),
                                   F.max("value").alias("mx"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    mom = mom.where(F.col("mn") < F.col("mx")).select("series", "n", "mn", "mx", bw.alias("bw"))
    mom = mom.withColumn("w", F.pow(F.lit(2.0), F.floor(F.log2(F.col("bw") / 4))))
    bins = (lv.join(F.broadcast(mom.select("series", "w")), "series")
            .groupBy("series", F.floor(F.col("value") / F.col("w")).alias("bin"))
            .agg(F.count(F.lit(1)).alias("count")))
    pts = bins.join(F.broadcast(mom), "series").select(
        "series", ((F.col("bin") + 0.5) * F.col("w")).alias("c"), "count", "n", "bw", "mn", "mx",
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    x = F.col("mn") + F.col("point") * (F.col("mx") - F.col("mn")) / F.lit(grid - 1)
    z = (x - F.col("c")) / F.col("bw")
    contrib = F.col("count") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.select("series", "point", x.alias("x"),
                      (contrib / (F.col("n") * F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5)))
                      .alias("d"))
    return (dens.groupBy("series", "point", "x").agg(F.sum("d").alias("density"))
                .select("series", "point", _r(F.col("x"), digits).alias("x"),
                        _r(F.col("density"), digits + 6 if digits is not None else None)
                        .alias("density")))


# ---------------------------------------------------------------- box plots
def box_stats(df: DataFrame, group_cols: Sequence[str], value: str,
              digits: int | None = DIGITS, method: str = "exact") -> DataFrame:
    """``agg_box_stats``: Tukey box per group: n, q1, median, q3, whiskers
    (most extreme values within 1.5 IQR), outlier count.

    Raw rows are combined before the shuffle to one ``(group, value, count)``
    row each, split by value; quartiles, whiskers and outliers all come from
    that stage table, joined with one row of quartiles per group (broadcast
    where they are few), so a hot group is not shuffled again."""
    v, w = F.col("_v"), F.col("_w")
    values = stage_table(counted(df, group_cols, value), "box-values")
    probs = [0.25, 0.5, 0.75]
    q = order_stats(values, group_cols, probs) if method == "exact" else \
        quantiles(df, group_cols, value, probs, method)
    q = q.select(*group_cols, F.col("q0").alias("q1"), F.col("q1").alias("median"),
                 F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr)
    agg = values.join(bounded(stage_table(q, "box-quartiles")), list(group_cols), "inner").groupBy(*group_cols, "q1", "median", "q3").agg(
        F.sum(w).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(w)).alias("outliers"),
    )
    return agg.select(*group_cols, "n",
                      *[_r(F.col(c), digits).alias(c)
                        for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "outliers")


def empirical_rule(df: DataFrame, value: str, digits: int | None = DIGITS) -> DataFrame:
    """``agg_empirical_rule``: mean and sample std of log1p(x); the 68 % and
    95 % ranges mapped back with expm1. One row."""
    lx = F.log1p(F.col(value).cast("double"))
    m = df.agg(F.avg(lx).alias("m"), F.stddev_samp(lx).alias("s"))
    mm, s = F.col("m"), F.col("s")
    return m.select(
        _r(mm, digits).alias("mean_log"), _r(s, digits).alias("std_log"),
        _r(F.expm1(mm - s), 2).alias("lo_68"), _r(F.expm1(mm + s), 2).alias("hi_68"),
        _r(F.expm1(mm - 2 * s), 2).alias("lo_95"), _r(F.expm1(mm + 2 * s), 2).alias("hi_95"))
