"""Scans of the driver tables (``src_table``).

One Parquet file or folder per table. Catalyst prunes columns and pushes
filters into these scans, so loaders never select or filter eagerly.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``src_table``: scan one named table."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def named(name: str, sf_dir: str) -> str:
    """A session-wide name of this library for data of one folder."""
    return f"arbor_{name}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:8]}"


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, str]:
    """``src_view``: the tables as views for ``spark.sql``; the view's name of
    each. Names end in a digest of the folder, so jobs on different folders in
    one session do not replace each other's."""
    views = {n: named(n, sf_dir) for n in names}
    for n, view in views.items():
        load(spark, sf_dir, n).createOrReplaceTempView(view)
    return views
