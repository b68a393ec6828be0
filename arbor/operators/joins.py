"""Joins whose left side may hold a large share of its rows under one key, and
group statistics carried back to the rows (survey 2.5, 2.7, 2.14).

AQE splits a skewed sort-merge join, but not one whose output is
aggregated or sorted on the same key in the same stage, nor one below its byte
thresholds. :func:`salted_join` does not depend on it: keys are counted, the few
that hold more than ``rows`` rows are dealt to that many more tasks, and only
their rows of the right side are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.operators.selection import bounded
from arbor.session import stage_table

#: Rows of one key that one task joins.
ROWS = 1_000_000


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(keys, _salts) of the keys with more than ``rows`` rows: at most one key
    for every ``rows`` rows of ``df``. NULL is a key like any other."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    return stage_table(counts.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_salts")), "hot-keys")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                rows: int = ROWS) -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` (``inner`` or ``left``; NULL
    keys never match), with the hot keys of ``left`` spread over tasks. Columns:
    the keys, then the other columns of both sides."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} join is not supported")
    keys = list(keys)
    hot = hot_keys(left, keys, rows)
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    hot = bounded(hot)

    def with_salts(df: DataFrame) -> DataFrame:
        return (df.alias("l").join(hot.alias("h"), _same("l", "h", keys), "left")
                .select("l.*", F.coalesce("h._salts", F.lit(1)).alias("_salts")))

    # any salt is right for a row of the left side, as the right side has all
    dealt = with_salts(left).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"))
    copies = with_salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def group_transform(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column],
                    columns: dict[str, Column | Callable[..., Column]], rows: int = ROWS) -> DataFrame:
    """``udf_group_lambda``: a caller's own function of each group, carried back
    to its rows, as pandas' ``groupby.transform``.

    ``aggregates`` are any aggregate expressions by name (one value a group, from
    partial aggregation, so a hot group is combined before the shuffle);
    ``columns`` are the results by name: expressions of the rows' columns and
    those names. Rows with a NULL in a key get NULLs, as pandas leaves them out
    of all groups. An expression that is no aggregate, or a name that is taken, raises."""
    keys = list(keys)
    taken = set(df.columns) & (set(aggregates) | set(columns))
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    stats = df.na.drop(subset=keys).groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    joined = salted_join(df, stats, keys, "left", rows)
    out = {n: c if isinstance(c, Column) else c(*[F.col(a) for a in aggregates]) for n, c in columns.items()}
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return joined.select(*df.columns, *[F.when(known, c).alias(n) for n, c in out.items()])
