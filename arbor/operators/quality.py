"""Profiling and data-quality operators (survey 2.12, 2.8).

Duplicate detection keys long texts by a fixed-width fingerprint
(``sha2(text, 256)`` plus the length), so shuffles carry 64 characters per
row instead of whole documents; all per-key work is partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(":", F.sha2(col, 256), F.length(col).cast("string"))


def info(df: DataFrame) -> DataFrame:
    """``dq_info``: per column its type and non-NULL count, plus the row
    count, from one aggregation."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    long_ = wide.unpivot(["__rows"], cols, "column", "non_null")
    types = df.sparkSession.createDataFrame(
        [(c, t) for c, t in df.dtypes], "column string, dtype string")
    return long_.join(types, "column").select(
        "column", "dtype", "non_null", F.col("__rows").alias("rows"))


def duplicate_report(df: DataFrame, key: str, out_cols: Sequence[str],
                     by_fingerprint: bool = False) -> DataFrame:
    """``dq_duplicate_report``: every row whose key occurs more than once,
    with the number of copies. Counting is a partial aggregation; the
    duplicated keys come back through a join on the key."""
    k = fingerprint(key) if by_fingerprint else F.col(key)
    keyed = df.select(*out_cols, k.alias("_k"))
    dups = (keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))
    return keyed.join(dups, "_k", "inner").drop("_k")


def null_rows(df: DataFrame, col: str, show: Sequence[str]) -> DataFrame:
    """``dq_null_rows``: rows where an extract failed, with the source."""
    return df.filter(F.col(col).isNull()).select(*show)


def sentinel_rows(df: DataFrame, col: str, value: str, show: Sequence[str]) -> DataFrame:
    """``dq_sentinel``: rows carrying a sentinel value."""
    return df.filter(F.col(col) == value).select(*show)


def cast_rejects(df: DataFrame, texts: Mapping[str, Column], kind: str) -> DataFrame:
    """Per attribute: how many texts it has, and how many of them a cast to
    ``kind`` turns into NULL. One aggregation, one row per attribute."""
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"), c.alias("_text")) for n, c in texts.items()])
    failed = F.col("_text").isNotNull() & F.col("_text").try_cast(kind).isNull()
    return (df.select(F.inline(rows)).groupBy("attribute")
            .agg(F.count("_text").alias("texts"), F.count_if(failed).alias("rejects")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``agg_distinct_values``: distinct values (NULL kept, as pandas)."""
    return df.select(col).distinct()


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """``lim_head``: first n rows in ingest order (a per-task top-n, then a
    merge of at most n rows per task)."""
    return df.orderBy(F.col(order).asc()).limit(n)


def tail(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """``lim_tail``: last n rows in ingest order (not ``DataFrame.tail``,
    which collects to the driver)."""
    return df.orderBy(F.col(order).desc()).limit(n)
