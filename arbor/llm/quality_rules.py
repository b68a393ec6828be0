"""Quality rules: zstandard compression bands.

Text that compresses far better than prose repeats itself; text that hardly
compresses is noise. The ratio (bytes / compressed bytes) is taken of the
whole text and of fixed chunks, because a long text may repeat only far apart
or only in places. Limits depend on the length, as short texts compress less.
The lower ones stand between random base64 cut into words or lines and prose.

Defined cases: a null text counts as empty; an empty text has no words and
fails the base rule; texts under ``BANDS[0][0]`` bytes have no ratio limit;
rows are judged one by one, so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, slices

#: Limits of the whole text's ratio by its bytes: (at least, lowest, highest).
#: Under 224 bytes base64 in short words and dense prose overlap; there the
#: lowest is that of prose.
BANDS = ((128, 1.04, 2.4), (160, 1.08, 2.4), (192, 1.12, 2.4), (224, 1.19, 2.4), (256, 1.21, 2.8),
         (320, 1.24, 2.8), (384, 1.28, 2.8), (448, 1.32, 2.8), (512, 1.35, 3.2), (768, 1.40, 3.2),
         (1024, 1.50, 3.8), (4096, 1.70, 4.5), (16384, 1.70, 5.5), (65536, 1.70, 7.0))
CHUNK_BYTES = 4096
#: A last chunk under this length has no limit of its own.
LEAST_CHUNK = 1024
#: Lowest ratio of a shorter last chunk, of a full one (half base64 is under
#: it), and the highest.
CHUNK_LIMITS = (1.50, 1.75, 4.0)
#: A text is rejected when more than this share of its chunks is outside, or
#: more than the smaller share is under the lowest ratio.
BAD_CHUNKS, NOISE_CHUNKS = 0.5, 0.1
LEVEL = 3
WINDOW = 8
_SYMBOLS = "#*$%&|<>"


def band(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio for a text of that length."""
    low, high = 0.0, float("inf")
    for least, lo, hi in BANDS:
        if n_bytes >= least:
            low, high = lo, hi
    return low, high


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more.

    Exact: windows get integer names by doubling (a name for a pair of
    neighbouring names), so equal names are equal windows.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) > len(words) - width:  # too few repeated words for a repeated window
        return 0
    step = 1
    while step < width:
        _, ids = np.unique(ids[:-step] * np.int64(len(words) + 1) + ids[step:], return_inverse=True)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes.split() cuts at 0x20 and 0x09-0x0D exactly
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    seen: set = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return (len(words), len(text) - spaces, sum(text.count(c) for c in _SYMBOLS), dup,
            repeated_words(words))


def ratios(raw: bytes, compressor) -> tuple[float, int, int, int]:
    """Whole ratio (0 for an empty text), chunks with a limit, chunks outside
    it, chunks under the lowest ratio."""
    if not raw:
        return 0.0, 0, 0, 0
    whole = len(raw) / len(compressor.compress(raw))
    chunks = [raw[k:k + CHUNK_BYTES] for k in range(0, len(raw), CHUNK_BYTES)]
    if len(chunks) == 1:
        return whole, 0, 0, 0  # the whole text's limits hold
    limited = [c for c in chunks if len(c) >= LEAST_CHUNK]
    short, low, high = CHUNK_LIMITS
    noise = bad = 0
    for c in limited:
        ratio = len(c) / len(compressor.compress(c))
        under = ratio < (low if len(c) == CHUNK_BYTES else short)
        noise += under
        bad += under or ratio > high
    return whole, len(limited), bad, noise


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, ratios, the base rule and the verdict."""
    ship_code(docs.sparkSession)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, "t"):
            texts = [t or "" for t in batch.column("t").to_pylist()]
            base = [base_counts(t) for t in texts]
            found, failed, kept = [], [], []
            for t, b in zip(texts, base):
                raw = t.encode("utf-8")
                whole, chunks, bad, noise = ratios(raw, z)
                low, high = band(len(raw))
                found.append((whole, chunks, bad))
                failed.append(b[0] < 20 or 100 * b[4] > 30 * b[0])
                kept.append(not failed[-1] and low <= whole <= high and bad <= BAD_CHUNKS * chunks
                            and noise <= NOISE_CHUNKS * chunks)
            yield pa.RecordBatch.from_pydict({
                "i": batch.column("i"),
                **{c: pa.array([b[k] for b in base], pa.int64()) for k, c in enumerate(longs)},
                "base_failed": pa.array(failed, pa.bool_()), "kept": pa.array(kept, pa.bool_()),
                "ratio": pa.array([f[0] for f in found], pa.float64()),
                "chunks": pa.array([f[1] for f in found], pa.int64()),
                "bad_chunks": pa.array([f[2] for f in found], pa.int64())})

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (f"i {kind}, " + ", ".join(f"{c} long" for c in longs) +
              ", base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long")
    return (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
            .mapInArrow(run, schema).withColumnRenamed("i", doc_id))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))
