"""Data-quality and preview queries (``dq_*``, ``win_dedupe_first``,
``win_duplicated``, ``lim_*``, ``agg_distinct_values``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbor.operators import quality as Q
from arbor.operators import textrules as TR
from arbor.operators import windows as W
from arbor.plans.listings import structured_listing
from arbor.sources.fixtures import raw_listing
from arbor.sources.tables import load

DOC_COLS = ["doc_id", "lang", "source", "n_chars"]


def _docs(spark, sf):
    return load(spark, sf, "documents")


def dq_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose exact text occurs more than once."""
    return Q.duplicate_report(_docs(spark, sf), "text", DOC_COLS, by_fingerprint=True)


def win_dedupe_first(spark, sf):
    """First document (lowest doc_id) per exact text."""
    d = _docs(spark, sf).select(*DOC_COLS, Q.fingerprint("text").alias("_k"))
    return W.dedupe_first(d, ["_k"], "doc_id").select(*DOC_COLS)


def win_duplicated(spark, sf):
    """Per document: is it the 2nd or later copy of its text (doc_id order)?"""
    d = _docs(spark, sf).select("doc_id", Q.fingerprint("text").alias("_k"))
    return W.duplicated(d, ["_k"], "doc_id").select("doc_id", "duplicated")


def dq_info(spark, sf):
    return Q.info(structured_listing(spark, sf).drop("ingest_seq"))


def dq_null_rows(spark, sf):
    """Listings whose year extract failed, with their source text."""
    raw = raw_listing(spark, sf)
    year = TR.long_feature_cols("features")["year_built"]
    return Q.null_rows(raw.withColumn("year_built", year), "year_built", ["id", "features"])


def dq_sentinel(spark, sf):
    """Listings whose short-path floor is the sentinel "404"."""
    raw = raw_listing(spark, sf)
    floor = TR.short_feature_cols("features")["floor"]
    return Q.sentinel_rows(raw.withColumn("floor", floor), "floor", "404", ["id", "features"])


def agg_distinct_values(spark, sf):
    return Q.distinct_values(TR.short_features(raw_listing(spark, sf), "id", "features"), "floor")


def lim_head(spark, sf):
    return Q.head(raw_listing(spark, sf), "ingest_seq", 5).select("id", "title", "price")


def lim_tail(spark, sf):
    return Q.tail(raw_listing(spark, sf), "ingest_seq", 5).select("id", "title", "price")


QUERIES = {
    "dq_duplicate_report": dq_duplicate_report,
    "win_dedupe_first": win_dedupe_first,
    "win_duplicated": win_duplicated,
    "dq_info": dq_info,
    "dq_null_rows": dq_null_rows,
    "dq_sentinel": dq_sentinel,
    "agg_distinct_values": agg_distinct_values,
    "lim_head": lim_head,
    "lim_tail": lim_tail,
}
