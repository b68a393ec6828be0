"""Token counts with a digest cache.

A text's count is stored under the digest of its normalised content and the
digest of the tokenizer file, in a Parquet table in a shared folder. A run
joins the distinct digests of its documents to the cache, encodes one text for
each miss, appends the new counts and answers from the cache. Duplicates
meet in an aggregation with map-side combine, so a hot text is encoded once.

Normalised content: for a tokenizer whose own rules drop white space, runs of
ASCII white space become one space and the ends are trimmed, which cannot
change a token; for any other tokenizer the text as it is.

Defined cases: a null text counts as empty and has 0 tokens; the cache may be
missing, empty or hold the same count twice (a retried append); repeated rows
each get their count; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import load, shared_path, ship_code, slices, stage_table

#: Pieces between spaces whose counts a worker remembers; emptied when full.
MEMORY = 500_000
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Tokenizers that a worker process has loaded.
_COUNTERS: dict = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_space(path: str) -> bool:
    """Whether the tokenizer itself turns white space runs to one space and
    gives no token to a space (read from its file)."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    replaced = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"}
                   and n.get("content") == " " for n in norm.get("normalizers", [norm]))
    removed = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")
                  and r"[^\s" in p.get("pattern", {}).get("Regex", "") for p in pre.get("pretokenizers", [pre]))
    return replaced and removed


def content(text: Column, squeeze: bool) -> Column:
    """Normalised content of a text column."""
    text = F.coalesce(text, F.lit(""))
    if not squeeze:
        return text
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def counter(path: str, squeeze: bool):
    """Function from a list of texts to their token counts."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def encode(texts: list[str]) -> list[int]:
            return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        if not squeeze:
            return encode
        known: dict[str, int] = {}

        def count(texts: list[str]) -> list[int]:
            # no token spans a space, so a text's count is the sum of its pieces'
            if len(known) > MEMORY:
                known.clear()
            pieces = [t.split(" ") for t in texts]
            new = [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in known]
            known.update(zip(new, encode(new)))
            return [sum(map(known.__getitem__, p)) for p in pieces]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in sp.encode(texts, num_threads=1)]
    return count


def encode_misses(texts: DataFrame, tokenizer: str, digest: str, squeeze: bool) -> DataFrame:
    """(content, text) -> cache rows."""
    ship_code(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, squeeze) not in _COUNTERS:
            _COUNTERS[tokenizer, squeeze] = counter(tokenizer, squeeze)
        count = _COUNTERS[tokenizer, squeeze]
        for batch in slices(batches, "text", 1 << 20):
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "content": batch.column("content"),
                "tokenizer": pa.array([digest] * len(n), pa.string()),
                "n_tokens": pa.array(n, pa.int64())})

    return texts.select("content", "text").mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark, cache: str, digest: str) -> DataFrame:
    """Stored counts of one tokenizer version, each content once."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = (spark.read.schema(CACHE_SCHEMA).parquet(cache) if there
            else spark.createDataFrame([], CACHE_SCHEMA))
    return (rows.where(F.col("tokenizer") == digest)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, content (digest).

    ``cache`` is a folder all executors share; it is read, and what is missing
    is appended to it. Runs at the same time may store a count twice, which
    reading evens out.
    """
    spark = docs.sparkSession
    digest, squeeze = tokenizer_digest(tokenizer), drops_space(tokenizer)
    plain = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = plain.select("t", content(F.col("t"), squeeze).alias("text"))
    texts = texts.select("text", F.sha2("text", 256).alias("content"))
    facts = stage_table(
        plain.select("i", "t", content(F.col("t"), squeeze).alias("text"))
        .select("i", F.octet_length("t").cast("long").alias("n_bytes"),
                F.sha2("text", 256).alias("content")), "token-facts")
    known = read_cache(spark, cache, digest)
    missing = facts.select("content").distinct().join(known, "content", "left_anti")
    # one text of each missing digest; equal digests hold equal texts, so any does
    found = texts.groupBy("content").agg(F.first("text").alias("text"))
    misses = found.join(missing, "content", "left_semi")
    encode_misses(misses, tokenizer, digest, squeeze).write.mode("append").parquet(cache)
    return (facts.join(read_cache(spark, cache, digest), "content", "left")
            .select(F.col("i").alias(doc_id), "n_bytes", "n_tokens", "content"))


def op8_token_counts(spark, sf_dir: str, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """The cache is a folder of its own for each run, so that a run's result
    and work do not depend on earlier runs."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    out = count_tokens(load(spark, sf_dir, "documents"), path, shared_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
