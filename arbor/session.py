"""Spark session and shared-folder helpers.

Jobs take the session they are given. Only tests and local tools build one
here, with settings sized for ``local[N]``; a cluster brings its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours should carry. AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splits a hot join key
# across tasks. Broadcasts are left to AQE's runtime size check.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "arbor") -> SparkSession:
    """Session for tests and local runs (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The setting is used as it is. Where it is unset, a ``local`` master gets a
    scratch folder (tests, a laptop); any other master is an error, because a
    folder of the driver's machine is not there for the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and "
                               f"all executors of {master} share")
        current = tempfile.mkdtemp(prefix="arbor-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own (no two jobs get the same) under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{uuid.uuid4().hex}/{name}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet stage table under the shared folder and read
    it back: cuts lineage, so a lost executor recomputes from the stage, not
    from the first scan. Returns the re-read DataFrame."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
