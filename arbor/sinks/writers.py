"""Sinks (survey 2.2): CSV without index, Parquet stage tables, typed
temp views. Writers are distributed (one file per task); nothing passes
through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: arrays/maps/structs become JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def folded(text: str) -> Column:
    """Text in one line, reversibly: backslash, line feed and carriage return
    become two characters each, so that CSV files stay splittable."""
    return F.replace(F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                     F.lit("\r"), F.lit("\\r"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``sink_csv``: header row, no index column, nested values as JSON."""
    _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet stage table (the default sink); optional partition columns
    for partition pruning by later readers."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_or_replace_view(df: DataFrame, name: str) -> DataFrame:
    """``ddl_create_or_replace`` / ``ddl_view``: idempotent named view."""
    df.createOrReplaceTempView(name)
    return df
