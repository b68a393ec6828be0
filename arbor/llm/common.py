"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.session import ensure_checkpoint_dir, shared_path, stage_table

__all__ = ["ensure_checkpoint_dir", "shared_path", "stage_table", "ship_code", "fresh",
           "load", "slices", "text_batches", "join_bounded", "null_safe", "WORDS"]

#: Words of the contracts: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1_000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver uses
    (a cluster without a shared code folder passes it with ``--py-files``)."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names starting with the given words that ``df`` does not have,
    whatever the case, so that helper columns never clash with extra ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str,
           max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` a piece
    (one longer text is a piece of its own). A batch that is cut is given up
    before the next one is read: its pieces are copies."""
    source = iter(batches)
    while True:
        batch = next(source, None)
        if batch is None:
            return
        rows = max(1, int(batch.num_rows * max_bytes / max(batch.column(column).nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            if rows < batch.num_rows:
                piece = piece.take(pa.array(range(piece.num_rows), pa.int32()))
            if start + rows >= batch.num_rows:
                batch = None
                pa.default_memory_pool().release_unused()
            yield piece
            if batch is None:
                break


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """For actions that hand whole texts to Python workers: Arrow batches of at
    most ``TEXT_ROWS`` rows, as a batch stands whole in the executor and once
    more in its worker. The session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """``<=>`` on each pair of columns, so that null keys meet null keys."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                 max_rows: int = 100_000) -> DataFrame:
    """Join a table of counted size: broadcast where it has at most
    ``max_rows`` rows (numbers and short keys), else a plain join, which AQE
    splits on skewed keys. ``right`` must be cheap to count (a stage table)."""
    return left.join(F.broadcast(right) if right.count() <= max_rows else right, on, how)
