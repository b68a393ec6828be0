"""Named tables that are replaced whole (``ddl_create_or_replace``,
``ddl_view``, ``src_table``).

A new version is written as a catalog table of its own; only then does the name,
a catalog view, point to it. Readers see the old version or the new one, a
failed write leaves the old one, and every session of the catalog reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARK = "__v_"


def versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a named table."""
    return sorted(t.name for t in spark.catalog.listTables(pattern=f"{name}{_MARK}*"))


def replace_table(df: DataFrame, name: str, location: str | None = None, keep: int = 1) -> DataFrame:
    """Write ``df`` under ``name`` and return the table as read by that name.
    Without a ``location`` (a shared folder) the files go to the warehouse.
    ``keep`` older versions stay for readers that have begun."""
    spark = df.sparkSession
    old = versions(spark, name)
    new = f"{name}{_MARK}{len(old):06d}_{uuid.uuid4().hex[:12]}"
    if old:  # versions sort by number
        number = max(int(v.split(_MARK)[1].split("_")[0]) for v in old) + 1
        new = f"{name}{_MARK}{number:06d}_{uuid.uuid4().hex[:12]}"
    writer = df.write.format("parquet").mode("error")
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{new}")
    try:
        writer.saveAsTable(new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS `{new}`")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{new}`")
    for v in old[:max(0, len(old) - keep)]:
        spark.sql(f"DROP TABLE IF EXISTS `{v}`")
    return spark.table(name)
