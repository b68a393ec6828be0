"""Extraction from fetched pages (survey 2.13), as Spark jobs over a table
of pages: the crawl's threads and queues become partitions, the HTML tree
walk becomes a fold over tokens (:mod:`arbor.operators.markup`) in built-in
functions (no Python per row).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.operators import markup as M
from arbor.operators.selection import bounded
from arbor.session import stage_table

# The reference's page-link format and crawl cap.
PAGE_LINK_FORMAT = "pagina-%d.htm"
PAGE_CAP = 60

PAGE_PARAM_PATTERN = r"[?&]page=(\d+)"
SEED_PATTERN = r"^https?://[^/]+/([a-z]+)/"
#: The list that a page is part of: its site and seed.
LIST_PATTERN = r"^https?://([^/]+/[a-z]+)/"


# ------------------------------------------------------------------ frontier
def seeds(pages: DataFrame, url: str = "url") -> DataFrame:
    """Seed table (neighborhood_id, link) from the pages' URL path segment."""
    sid = F.regexp_extract(url, SEED_PATTERN, 1)
    return (pages.select(sid.alias("neighborhood_id")).filter(F.col("neighborhood_id") != "")
            .distinct()
            .select("neighborhood_id",
                    F.concat(F.lit("/"), F.col("neighborhood_id"), F.lit("/")).alias("link")))


def frontier(seed_df: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """``ext_frontier``: the list-page links of every seed, pages 1..cap."""
    idx = F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("page_index")
    f = seed_df.select("neighborhood_id", "link", idx)
    return f.select("neighborhood_id", "page_index",
                    F.concat(F.col("link"), F.format_string(PAGE_LINK_FORMAT, F.col("page_index")))
                    .alias("page_link"))


# ------------------------------------------------------------------ list pages
def list_pages(pages: DataFrame) -> DataFrame:
    """Pages as list pages: seed, list (site and seed), page index (``page=``
    URL parameter, default 1)."""
    pidx = F.coalesce(F.regexp_extract("url", PAGE_PARAM_PATTERN, 1).try_cast("int"), F.lit(1))
    return pages.select(F.regexp_extract("url", SEED_PATTERN, 1).alias("neighborhood_id"),
                        F.regexp_extract("url", LIST_PATTERN, 1).alias("list_id"),
                        "page_id", pidx.alias("page_index"), "html")


def last_pages(lp: DataFrame, next_marker: str | None = None) -> DataFrame:
    """(list_id, last): the index at which a crawl of the list ends, 0 if it
    has no page 1. The crawl goes from page 1 on and ends at the first page
    whose next one is not stored (the first gap), or, with ``next_marker``, at
    the first page whose markup lacks it.

    Gaps by one anti-join of the stored indices with their own predecessors on
    (list, index): no window over a list, however many pages it has."""
    more = F.lit(True) if next_marker is None else F.contains(F.col("html"), F.lit(next_marker))
    stored = (lp.where(F.col("page_index") >= 1).groupBy("list_id", "page_index")
              .agg(F.max(more).alias("_more")))
    # page 0 stands for the start of every list
    heads = lp.select("list_id").distinct().select("list_id", F.lit(0).alias("page_index"), F.lit(True).alias("_more"))
    at = stored.unionByName(heads)
    before = at.select("list_id", (F.col("page_index") - 1).alias("page_index"))
    gaps = at.join(before, ["list_id", "page_index"], "left_anti")
    ends = gaps.unionByName(at.where(~F.col("_more")))
    return ends.groupBy("list_id").agg(F.min("page_index").alias("last"))


def crawl_pages(lp: DataFrame, cap: int | None = None, next_marker: str | None = None) -> DataFrame:
    """``ext_last_page``: per list, the pages from 1 to its last one, with
    ``is_last``; pages that the crawl never reaches are dropped. ``cap`` bounds
    the index where one is given (stored pages have none; a live crawl's
    :func:`frontier` has).

    The last pages, one row a list, are found from indices alone; the html of a page
    crosses the network only if the lists are too many to broadcast."""
    ends = bounded(stage_table(last_pages(lp, next_marker), "last-pages"))
    kept = (lp.join(ends, "list_id").where(F.col("page_index").between(1, F.col("last")))
            .withColumn("is_last", F.col("page_index") == F.col("last")))
    kept = kept.select("neighborhood_id", "list_id", "page_id", "page_index", "is_last", "html")
    return kept if cap is None else kept.where(F.col("page_index") <= cap)


def page_items(lp: DataFrame) -> DataFrame:
    """``ext_items``: one row per ``<li>`` of a page in document order (nested
    ones too): position, first link target (the item id) and text."""
    page = M.parsed(lp.select("neighborhood_id", "page_id", "html"), ["li"])
    cut = F.transform("_elements", lambda e: M.inner(F.col("_tokens"), e))
    it = page.select("neighborhood_id", "page_id", F.posexplode(cut).alias("item_pos", "_inner"))
    links = F.filter(F.transform("_inner", lambda t: F.when(M.is_tag(t), M.attribute(t, "href"))), lambda h: h.isNotNull())
    return it.select("neighborhood_id", "page_id", "item_pos", F.get(links, F.lit(0)).alias("property_id"),
                     M.text_of(F.col("_inner")).alias("item_text"))


# ------------------------------------------------------------------ records
@dataclass(frozen=True)
class Field:
    """The text of the first ``tag`` of a page, of class ``cls`` if given."""

    name: str
    tag: str
    cls: str | None = None
    required: bool = True


# Record fields re-aimed to the fixture pages (h1 title, first paragraph);
# the price element is optional and absent on them.
RECORD_FIELDS = [
    Field("title", "h1"),
    Field("description", "p"),
    Field("price", "span", "txt-bold", required=False),
]


def records_with_errors(pages: DataFrame, fields: Sequence[Field] = RECORD_FIELDS) -> DataFrame:
    """``ext_record`` + ``ext_nested_lists`` + ``ext_error_rows`` in one pass:
    every page yields its record and an error text ('' when the record is
    complete). :func:`records` and :func:`error_rows` split it. ``features`` has
    a list of item texts for every ``<ul>``, nested ones too."""
    wanted = sorted({"ul", "li", *[f.tag for f in fields]})
    page = M.parsed(pages.select(F.col("page_id").alias("id"), "url", "html"), wanted)
    tokens, found = F.col("_tokens"), F.col("_elements")

    def first(f: Field):
        def hit(e):
            own = e["name"] == f.tag
            classes = F.split(M.attribute(F.element_at(tokens, e["at"] + 1), "class"), r"\s+")
            return own if f.cls is None else own & F.coalesce(F.array_contains(classes, f.cls), F.lit(False))
        e = F.get(F.filter(found, hit), F.lit(0))
        return F.nullif(M.text_of(M.inner(tokens, e)), F.lit(""))

    items = F.filter(found, lambda e: e["name"] == "li")
    texts = F.transform(items, lambda e: F.struct(e["at"].alias("at"), M.text_of(M.inner(tokens, e)).alias("text")))
    lists = F.filter(found, lambda e: e["name"] == "ul")
    cols = page.select("id", "url", F.regexp_extract("url", SEED_PATTERN, 1).alias("neighborhood"),
                       *[first(f).alias(f.name) for f in fields], lists.alias("_lists"), texts.alias("_items"))
    nested = F.transform("_lists", lambda ul: F.transform(
        F.filter("_items", lambda e: (e["at"] > ul["at"]) & (e["at"] < ul["stop"])), lambda e: e["text"]))
    missing = F.concat_ws(",", *[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in fields if f.required])
    row = F.struct("id", "url", "neighborhood", *[f.name for f in fields], nested.alias("features"),
                   F.flatten(nested).alias("info_features"), missing.alias("_missing"))
    # one row a page through a generator: a filter on the record is not pushed
    # below it, where it would parse the page again
    return cols.select(F.inline(F.array(row)))


def records(pages: DataFrame, fields: Sequence[Field] = RECORD_FIELDS) -> DataFrame:
    r = records_with_errors(pages, fields)
    return r.filter(F.col("_missing") == "").drop("_missing", "url")


def error_rows(pages: DataFrame, fields: Sequence[Field] = RECORD_FIELDS) -> DataFrame:
    """Pages that failed: (id, link, error); kept, never dropped (Q13, Q21)."""
    r = records_with_errors(pages, fields)
    return r.filter(F.col("_missing") != "").select(
        "id", F.col("url").alias("page_link"),
        F.concat(F.lit("missing: "), F.col("_missing")).alias("error"))
