"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Per line, HyperLogLog
sketches of its sites are built on the map side and merged by one aggregation.
Far from the threshold the sketch decides; lines whose estimate is within
``BAND`` relative errors of it get an exact distinct count. Boilerplate lines
are then removed from all texts, on every site.

A site may be any column (the source here; a host for pages). Lines are
compared without white space at the ends, by 128 bits of two hashes.

Defined cases: a null text counts as empty and has no lines; blank lines are
never counted nor removed, all others are, however short (``min_chars`` can
leave out short ones); a null site is a site of its own; repeated rows of one site count
once; an empty table gives no rows; extra columns are kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import fresh, load, null_safe, stage_table

#: log2 of the sketch's registers: a relative error of 1.04 / sqrt(2^10), 3.3 %.
LOG_K = 10
#: Relative errors around the threshold inside which the count is made exact.
BAND = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    """(i, th, site, at, a, b): a row for each line that can be boilerplate;
    ``th`` tells apart different texts under one id."""
    rows = docs.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("th"),
                       F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
                       F.posexplode(_lines(F.col(text))).alias("at", "line"))
    rows = rows.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")))
    return (rows.where(F.length("line") >= max(1, min_chars))
            .select("i", "th", "site", "at", F.xxhash64("line").alias("a"),
                    F.xxhash64(F.lit(1), "line").alias("b")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(a, b, sites) of the lines on ``min_sites`` sites or more; ``sites`` is
    exact near the threshold and an estimate far above it."""
    spread = stage_table(
        lines.groupBy("a", "b").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"),
            F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites), "line-spread")  # fewer rows than sites cannot spread
    slack = max(2, int(BAND * 1.04 / 2 ** (LOG_K / 2) * min_sites) + 1)
    near = F.col("sites").between(min_sites - slack, min_sites + slack)
    exact = (lines.join(spread.where(near).select("a", "b"), ["a", "b"], "left_semi")
             .select("a", "b", "site").distinct()
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    sure = spread.where(F.col("sites") > min_sites + slack).select("a", "b", "sites")
    return stage_table(sure.unionByName(exact), "line-boilerplate")


def removals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source",
             min_sites: int = 8, min_chars: int = 1) -> DataFrame:
    """(i, th, gone): places of the boilerplate lines of each document that has any."""
    lines = stage_table(line_rows(docs, doc_id, text, site, min_chars), "line-rows")
    found = boilerplate(lines, min_sites).select("a", "b")
    return (lines.join(found, ["a", "b"], "left_semi")
            .groupBy("i", "th").agg(F.collect_set("at").alias("gone")))


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source",
           min_sites: int = 8, min_chars: int = 1, gone: str | None = None) -> DataFrame:
    """The documents with their boilerplate lines removed from ``text``; the
    number of lines taken out goes to the column ``gone`` if it is named."""
    i, th, places, own = fresh(docs, "id", "th", "places", "own_th")
    marks = removals(docs, doc_id=doc_id, text=text, site=site, min_sites=min_sites, min_chars=min_chars)
    marks = marks.select(F.col("i").alias(i), F.col("th").alias(th), F.col("gone").alias(places))
    rows = docs.withColumn(own, F.xxhash64(docs[text]))
    joined = rows.join(marks, null_safe(rows, marks, [(doc_id, i)]) & (rows[own] == marks[th]), "left")
    lines = _lines(F.col(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    # each place beside a reference to the lines: looked up, not searched
    left = F.transform(F.arrays_zip(stay, F.array_repeat(lines, F.size(stay))), lambda x: x["1"][x["0"]])
    clean = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    count = F.coalesce(F.size(places), F.lit(0))
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns],
                         *([F.when(F.col(places).isNull(), 0).otherwise(count).cast("long").alias(gone)]
                           if gone else []))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines on 8 sources or more leave all documents: doc_id, lines taken
    out, code points left, digest of the text left."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = remove(docs, gone="n_removed")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed", F.length(text).cast("long").alias("n_chars"),
                      F.sha2(text, 256).alias("text_sha256"))
