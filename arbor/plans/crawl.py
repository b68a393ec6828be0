"""Crawl queries (``crawl_*``, ``ext_*``) over the fetched ``pages`` table:
seed -> frontier, list pages -> item ids with the last-page stop rule,
detail pages -> raw listing records plus a reject table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbor.operators import extract as X
from arbor.sources.tables import load


def _pages(spark, sf):
    return load(spark, sf, "pages")


def ext_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return X.frontier(X.seeds(_pages(spark, sf)))


def crawl_pages(spark, sf):
    return X.crawl_pages(X.list_pages(_pages(spark, sf))).drop("html")


def crawl_items(spark, sf):
    """Item ids of every list page up to the last one of its seed."""
    return X.page_items(X.crawl_pages(X.list_pages(_pages(spark, sf))))


def ext_items(spark, sf):
    """Items of every page, without the stop rule."""
    return X.page_items(X.list_pages(_pages(spark, sf)))


def crawl_records(spark, sf):
    return X.records(_pages(spark, sf))


def ext_error_rows(spark, sf):
    return X.error_rows(_pages(spark, sf))


QUERIES = {
    "ext_frontier": ext_frontier,
    "crawl_pages": crawl_pages,
    "crawl_items": crawl_items,
    "ext_items": ext_items,
    "crawl_records": crawl_records,
    "ext_error_rows": ext_error_rows,
}
