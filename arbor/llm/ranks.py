"""Places of rows in a sorted table, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import stage_table


def partitions(spark) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place_in(df: DataFrame, key: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with ``at``, the place (from 0) of a row among those of its
    ``key``, and ``n``, their number.

    The rows are range-partitioned and sorted by key and order, so a hot key
    spreads over many tasks, and are written with their place in the partition
    (``df`` should be a stage table, as the ranges are sampled from it). The
    offsets come from one row for each key and partition. ``order`` must tell
    apart all rows that differ."""
    put = (df.repartitionByRange(partitions(df.sparkSession), F.col(key), *order)
           .sortWithinPartitions(F.col(key), *order)
           .select("*", F.spark_partition_id().alias("part"),
                   F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    put = stage_table(put, f"{name}-sorted")
    runs = stage_table(put.groupBy(key, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")),
                       f"{name}-runs")
    so_far = Window.partitionBy(key).orderBy("part")
    runs = runs.select(F.col(key).alias("run_key"), F.col("part").alias("run_part"),
                       (F.sum("rows").over(so_far) - F.col("rows") - F.col("first")).alias("shift"),
                       F.sum("rows").over(Window.partitionBy(key)).alias("n"))
    runs = stage_table(runs, f"{name}-offsets")
    same = (F.col("part") == F.col("run_part")) & F.col(key).eqNullSafe(F.col("run_key"))
    many = runs.count() > 100_000
    return (put.join(runs if many else F.broadcast(runs), same)
            .withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift", "run_key", "run_part"))
