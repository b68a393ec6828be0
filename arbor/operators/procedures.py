"""Stored SQL called with names and values as arguments (``udf_proc_pearson``).

The texts have parameter markers; relation and column names go through
``IDENTIFIER``, so no SQL is put together from strings and a name can only be a
name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Pearson r of two columns of a relation over complete pairs.
PEARSON = """
SELECT :x AS ColumnX, :y AS ColumnY,
       round(try_divide(regr_sxy(CAST(IDENTIFIER(:y) AS DOUBLE), CAST(IDENTIFIER(:x) AS DOUBLE)),
                        sqrt(regr_sxx(CAST(IDENTIFIER(:y) AS DOUBLE), CAST(IDENTIFIER(:x) AS DOUBLE)))
                        * sqrt(regr_syy(CAST(IDENTIFIER(:y) AS DOUBLE), CAST(IDENTIFIER(:x) AS DOUBLE)))),
             :digits) AS PearsonCorrelation
FROM IDENTIFIER(:relation)"""

#: Rows and distinct values of a column of a relation by another column.
SPREAD = """
SELECT CAST(IDENTIFIER(:by) AS STRING) AS value, count(*) AS n, count(DISTINCT IDENTIFIER(:column)) AS n_distinct
FROM IDENTIFIER(:relation) GROUP BY ALL"""


def call(spark: SparkSession, text: str, relation: str, columns: dict[str, str], **values) -> DataFrame:
    """Run a stored text on a table or view; ``columns`` and ``values`` fill its
    other markers. An unknown relation or column raises with its name."""
    if not spark.catalog.tableExists(relation):
        raise ValueError(f"there is no table or view {relation!r}")
    there = {c.lower() for c in spark.table(relation).columns}
    for marker, column in columns.items():
        if column.lower() not in there:
            raise ValueError(f"{relation!r} has no column {column!r} (argument {marker!r})")
    return spark.sql(text, args={"relation": relation, **{m: c for m, c in columns.items()}, **values})
