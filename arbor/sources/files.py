"""File sources (survey 2.1): CSV with a declared schema, and reading back
list columns that a CSV round trip turned into their text repr."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from arbor.functions.text import ragged, repr_list

#: The text of a row that does not fit the schema.
CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """``src_csv``: header, quoted fields, declared schema (no schema inference
    in jobs), and ``_corrupt``: the text of a row that does not fit it, else
    NULL. Files are split between tasks; ``multi_line`` is for files whose
    quoted fields hold line ends, and makes a file one task."""
    schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def unfolded(text: str) -> Column:
    """Text of a column that :func:`arbor.sinks.writers.folded` wrote in one line."""
    return F.replace(F.replace(F.replace(F.replace(F.col(text), F.lit("\\\\"), F.lit("\\\0")), F.lit("\\n"), F.lit("\n")),
                               F.lit("\\r"), F.lit("\r")), F.lit("\\\0"), F.lit("\\"))


def read_repr_list_columns(df: DataFrame, col: str, width: int, prefix: str) -> DataFrame:
    """``src_repr_list`` + ``src_ragged``: a text-repr list column to
    positional columns (short rows padded with NULL)."""
    return df.select("*", *ragged(repr_list(col), width, prefix))
