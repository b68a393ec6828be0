"""Relational building blocks (survey 2.3-2.6): CASE buckets, rates,
rounded means, conditional counts, typed temp tables, two-level
aggregation, joins.

Joins carry no broadcast hints: AQE measures each side at runtime and
broadcasts only a side under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
(a checked size); anything larger stays a sort-merge join, with skewed
partitions split by AQE's skew-join rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den rounded to ``digits`` places, half away from zero, computed
    exactly on integers (no binary-float ties, R12):
    sign(n) * floor((2|n| + den) / (2 den)) / 10^d with n = num * 10^d.
    NULL when den = 0. Inputs must be integral; 38 decimal digits hold what
    sums over very many rows scale up to."""
    n = num.cast("decimal(20,0)") * F.lit(10 ** digits).cast("decimal(8,0)")
    d = den.cast("decimal(20,0)")
    a, b = F.lit(2) * F.abs(n) + d, F.lit(2) * d
    # exact integral division: (a - a mod b) is a multiple of b, and the
    # quotient is small (the rounded mean in 10^-d units)
    q = F.round((a - F.pmod(a, b)) / b).cast("decimal(30,0)")
    units = F.when(d != 0, F.signum(n).cast("decimal(1,0)") * q)
    return units.cast("double") / F.lit(float(10 ** digits))


def avg_round(c: Column | str, digits: int = 2, scale: int = 0) -> Column:
    """``agg_avg_round``: ROUND(AVG(CAST(x AS FLOAT)), 2) for a column of
    integers (``scale`` 0) or fixed-point values with ``scale`` decimals
    (money): the exact mean rounded half away from zero, from an exact
    integer sum and count (both partial aggregates)."""
    units = _c(c) if scale == 0 else F.round(_c(c) * F.lit(10 ** scale), 0)
    units = units.cast("bigint")
    return round_ratio(F.sum(units), F.count(units) * F.lit(10 ** scale), digits)


def sum_fixed(c: Column | str, scale: int = 2) -> Column:
    """Exact sum of fixed-point values with ``scale`` decimals (in integer
    units, then back to double)."""
    units = F.round(_c(c) * F.lit(10 ** scale), 0).cast("bigint")
    return F.sum(units) / F.lit(float(10 ** scale))


def avg_double(c: Column | str) -> Column:
    """``agg_avg``: AVG(CAST(x AS FLOAT))."""
    return F.avg(_c(c).cast("double"))


def count_if(pred: Column) -> Column:
    """``agg_count_if``: COUNT(CASE WHEN p THEN 1 END); NULL p not counted."""
    return F.count_if(pred)


def rate_pct(numer: Column, denom: Column) -> Column:
    """``agg_rate``: numer / denom * 100 in double, NULL on a zero denominator."""
    return F.try_divide(numer.cast("double"), denom.cast("double")) * 100


def bucket(c: Column | str, ranges: Sequence[tuple[int, int, str]], other: str) -> Column:
    """``prj_case_bucket``: first inclusive range that holds the value, else
    ``other`` (which also takes NULL and values below the first range)."""
    out = None
    for lo, hi, label in ranges:
        cond = _c(c).between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(other))


def inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``join_inner_equi`` / ``join_merge``: inner equi-join; rows multiply
    on duplicate keys (R13)."""
    return left.join(right, on, "inner")


def merge(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """``prj_suffix``: inner merge in which columns that both sides have get a
    suffix each, as in pandas."""
    both = (set(left.columns) & set(right.columns)) - {on}

    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in both})

    return named(left, suffixes[0]).join(named(right, suffixes[1]), on, "inner")


#: Text keys equal but for the case of letters (R14).
ANY_CASE = "UTF8_LCASE"


def any_case(key: Column | str) -> Column:
    """A text key that groups, joins and compares without regard to case."""
    return F.collate(_c(key), ANY_CASE)


def plain(key: Column | str) -> Column:
    """A key as plain text again."""
    return F.collate(_c(key), "UTF8_BINARY")


def lookup(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``join_lookup``: values by key from a table with one row per key; rows
    without a match keep NULLs. AQE broadcasts the table where it is small."""
    return left.join(table, key, "left")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``prj_rename``: columns renamed by a dict; unknown keys are ignored."""
    return df.withColumnsRenamed(dict(names))


def semi(left: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``join_left_semi`` / ``flt_isin``: rows whose key is in ``keys``."""
    return left.join(keys, on, "left_semi")


def typed_table(spark: SparkSession, df: DataFrame, schema: StructType,
                view: str | None = None) -> DataFrame:
    """``sink_insert_select``: fill a typed table from a query BY POSITION
    (names come from the target), casting each column to its field type;
    optionally register it as a temp view (``ddl_create_or_replace``)."""
    if len(df.columns) != len(schema.fields):
        raise ValueError("column count differs from the target table")
    out = df.select(*[F.col(f"`{src}`").cast(f.dataType).alias(f.name)
                      for src, f in zip(df.columns, schema.fields)])
    if view:
        out.createOrReplaceTempView(view)
    return out


def not_equal_null_safe(a: Column, b: Column) -> Column:
    """``flt_not_equal_null_safe``: ~(a == b) with NaN semantics: a NULL on
    either side counts as different (NULL vs NULL included)."""
    return ~F.coalesce(a == b, F.lit(False))
