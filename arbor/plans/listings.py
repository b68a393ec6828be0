"""Listing analytics (survey 2.16, ``re_*``): structure scraped listings
into typed columns, clean them, and describe prices by feature, type and
place.

Stage chain (one typed table per stage, Q11):
raw_listing -> short / long / price-title-place paths -> structured
listing (merge) -> analysis listing (dedupe, backfill, impute, drop).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions import rules as RU
from arbor.functions import text as T
from arbor.operators import relational as R
from arbor.operators import stats as S
from arbor.operators import textrules as TR
from arbor.operators import windows as W
from arbor.session import stage_table
from arbor.sources.fixtures import raw_listing

FLAGS = [name for name, _, _ in RU.KEYWORD_FLAGS]
NUMERIC = ["price", "sq_m_built", "floor", "n_bedrooms", "bathrooms", "year_built"]
CATEGORICAL = ["property_type", "neighborhood", "city"]

# Histogram bin counts per characteristic.
PRICE_BINS = {"price": 100, "log_price": 30}
CHARACTERISTIC_BINS = {"price": 100, "sq_m_built": 36, "floor": 26, "n_bedrooms": 18,
                       "bathrooms": 11, "year_built": 100}
KDE_COLUMNS = ["price", "sq_m_built", "floor"]

STRUCTURED_COLUMNS = [
    "id", "property_type", "address", "neighborhood", "city", "price", "sq_m_built",
    "sq_m_floor_area", "n_bedrooms", "bathrooms", "floor", "year_built", "exterior", "lift",
    "terrace", "balcony", "second_hand", "needs_renovating", "parking", "swimming_pool",
    "garden", "air_conditioning", "heating", "central_heating", "heating_type",
    "consumption_kwh_m2_year", "emissions_kgco2_m2_year", "orientation",
]
DROPPED_FOR_ANALYSIS = ["sq_m_floor_area", "central_heating", "heating_type",
                        "consumption_kwh_m2_year", "emissions_kgco2_m2_year", "orientation"]


# ------------------------------------------------------------------ stages
def re_info_features(spark: SparkSession, sf: str) -> DataFrame:
    return TR.short_features(raw_listing(spark, sf), "id", "features")


def re_features(spark, sf):
    return TR.long_features(raw_listing(spark, sf), "id", "features")


def re_price_title_place(spark, sf):
    return TR.price_title_place(raw_listing(spark, sf))


def structured_listing(spark, sf, raw: DataFrame | None = None) -> DataFrame:
    """``re_reconcile_merge``: the structured listing (sizes and floor from
    the long path, bedrooms/exterior/lift from the short path, as the
    reference picks them).

    The reference merges three frames on id; all three are row-wise
    functions of the same raw row, so here they are ONE projection over one
    scan (no join, no shuffle). With duplicated ids the reference's merges
    multiply rows (R13, Q18), which its keep-first dedupe then removes; the
    dedupe in :func:`analysis_listing` yields the same final set."""
    raw = raw_listing(spark, sf) if raw is None else raw
    head = TR.price_title_place_cols()
    short = TR.short_feature_cols("features")
    long_ = TR.long_feature_cols("features")
    pick = {**long_, **head,
            "sq_m_built": long_["sq_m_built"].try_cast("int"),
            "n_bedrooms": short["n_bedrooms"],
            "exterior": short["exterior"],
            "lift": short["lift"]}
    cols = [F.col("id")] + [pick[c].alias(c) for c in STRUCTURED_COLUMNS[1:]]
    return raw.select(*cols, "ingest_seq")


def re_reconcile_merge(spark, sf):
    return structured_listing(spark, sf).drop("ingest_seq")


def dq_reconcile(spark, sf):
    """``dq_reconcile``: the same attribute from both extraction paths,
    listed where they differ (a NULL on either side counts as different).
    Both paths are expressions over the same row: one projection of the values,
    then an ``inline`` of (attribute, left, right) structs of them, then a filter.
    The projection matches a text that several values share once; a generator
    would match it anew at every place where it stands."""
    raw = raw_listing(spark, sf)
    short = TR.short_feature_cols("features")
    long_ = TR.long_feature_cols("features")
    pairs = [("size", short["size_in_m2"], long_["sq_m_built"].try_cast("int")),
             ("bedrooms", short["n_bedrooms"], long_["bedrooms"]),
             ("lift", short["lift"], long_["lift"]),
             ("exterior", short["exterior"], long_["exterior"])]
    values = raw.select("id", *[v.alias(f"{n}_{side}") for n, *both in pairs
                                for side, v in zip(("left", "right"), both)])
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"),
                              F.col(f"{n}_left").cast("string").alias("left_value"),
                              F.col(f"{n}_right").cast("string").alias("right_value"),
                              R.not_equal_null_safe(F.col(f"{n}_left"), F.col(f"{n}_right")).alias("differs"))
                     for n, _, _ in pairs])
    out = values.select("id", F.inline(rows))
    return out.filter("differs").select("attribute", "id", "left_value", "right_value")


ANALYSIS_COLUMNS = [c for c in STRUCTURED_COLUMNS if c not in DROPPED_FOR_ANALYSIS]


def analysis_listing(spark, sf, simultaneous_backfill: bool = False,
                     method: str = "exact", columns: Sequence[str] = ANALYSIS_COLUMNS,
                     keep_placeless: bool = False) -> DataFrame:
    """``re_clean``: keep-first dedupe by id (of raw rows, before any text is
    matched), city/neighbourhood backfill in
    the reference's sequence (Q6), year imputed by the neighbourhood median
    (R8, Q7), rows still without a year dropped, the named analysis columns
    kept. Rows without a neighbourhood go even with a year, unless ``keep_placeless``. The structured listing is staged before the impute, which reads it
    more than once: texts are matched once, and only those of kept columns."""
    raw = W.keep_first(raw_listing(spark, sf), ["id"], "ingest_seq")
    df = structured_listing(spark, sf, raw)
    city, hood = F.col("city"), F.col("neighborhood")
    if simultaneous_backfill:
        df = df.withColumns({"city": F.coalesce(city, hood),
                             "neighborhood": F.when(city.isNull(), F.col("address")).otherwise(hood)})
    else:
        df = df.withColumn("city", F.coalesce(city, hood))
        df = df.withColumn("neighborhood",
                           F.when(F.col("city").isNull(), F.col("address")).otherwise(hood))
    needed = [c for c in ANALYSIS_COLUMNS if c in {*columns, "neighborhood", "year_built"}]
    df = W.group_impute(stage_table(df.select(*needed), "listing"), "neighborhood", "year_built", method, keep_placeless)
    return df.na.drop(subset=["year_built"]).select(*columns)


def re_clean(spark, sf):
    return analysis_listing(spark, sf)


def _staged(spark, sf, *columns: str) -> DataFrame:
    """The named columns of the analysis listing as a stage table, for queries
    that read it more than once: texts are matched and years imputed once."""
    return stage_table(analysis_listing(spark, sf, columns=columns), "analysis-listing")


def _with_log(df):
    return df.withColumn("log_price", F.log1p(F.col("price")))


# ------------------------------------------------------------------ describe
def re_describe(spark, sf):
    return S.describe(analysis_listing(spark, sf, columns=NUMERIC), NUMERIC)


def re_value_counts(spark, sf):
    return S.value_counts(analysis_listing(spark, sf, columns=CATEGORICAL), CATEGORICAL)


def dq_nunique(spark, sf):
    return S.nunique(structured_listing(spark, sf).drop("ingest_seq"),
                     ["id", "property_type", "address", "neighborhood", "city", "price"])


def dq_null_counts(spark, sf):
    return S.null_counts(structured_listing(spark, sf).drop("ingest_seq"))


# ------------------------------------------------------------------ distributions
def re_price_distribution(spark, sf):
    return S.histograms(_with_log(_staged(spark, sf, "price")), PRICE_BINS)


def re_empirical_rule(spark, sf):
    return S.empirical_rule(_staged(spark, sf, "price"), "price")


def re_price_kde(spark, sf):
    return S.kde(_with_log(_staged(spark, sf, "price")), list(PRICE_BINS))


def re_characteristics_hist(spark, sf):
    return S.histograms(_staged(spark, sf, *CHARACTERISTIC_BINS), CHARACTERISTIC_BINS)


def re_characteristics_kde(spark, sf):
    return S.kde(_staged(spark, sf, *KDE_COLUMNS), KDE_COLUMNS)


def re_feature_counts(spark, sf):
    return S.bool_counts(analysis_listing(spark, sf, columns=FLAGS), FLAGS)


def re_corr_matrix(spark, sf):
    return S.corr_matrix(analysis_listing(spark, sf, columns=NUMERIC), NUMERIC)


# ------------------------------------------------------------------ box plots
def re_price_by_feature(spark, sf):
    """Box statistics of log price per flag value: the 11 flags are
    unpivoted so one aggregation serves all of them."""
    df = _with_log(_staged(spark, sf, "price", *FLAGS))
    src = df.select("log_price", *[F.col(f).cast("string").alias(f) for f in FLAGS])
    lv = src.unpivot(["log_price"], FLAGS, "feature", "value")
    return S.box_stats(lv, ["feature", "value"], "log_price")


def re_price_by_type(spark, sf):
    return S.box_stats(_with_log(_staged(spark, sf, "price", "property_type")), ["property_type"], "log_price")


def re_price_by_city(spark, sf):
    return S.box_stats(_with_log(_staged(spark, sf, "price", "city")), ["city"], "log_price")


def re_price_by_place(spark, sf):
    """City-neighbourhood key (NULL when either part is NULL, R7), median
    price per key, box statistics of log price, ordered by the median."""
    df = _with_log(_staged(spark, sf, "price", "city", "neighborhood")).withColumn(
        "city_neighborhood", T.concat_strict("city", F.lit(" - "), "neighborhood"))
    med = S.group_median(df, ["city_neighborhood"], "price", "median_price")
    box = S.box_stats(df, ["city_neighborhood"], "log_price")
    out = box.join(med, "city_neighborhood", "inner")
    return out.select("city_neighborhood", F.round("median_price", S.DIGITS).alias("median_price"),
                      "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers"
                      ).orderBy("median_price", "city_neighborhood")


def re_city_counts(spark, sf, cities: list[str] | None = None):
    """Listings per city, and per neighbourhood within each city (NULL
    categories skipped). ``cities`` restricts the neighbourhood level."""
    df = _staged(spark, sf, "city", "neighborhood").filter(F.col("city").isNotNull())
    by_hood = (df.filter(F.col("neighborhood").isNotNull())
               .groupBy("city", "neighborhood").agg(F.count(F.lit(1)).alias("count")))
    if cities:
        by_hood = by_hood.filter(F.col("city").isin(cities))
    by_city = df.groupBy("city").agg(F.count(F.lit(1)).alias("count"))
    return (by_city.select(F.lit("city").alias("level"), "city",
                           F.lit(None).cast("string").alias("neighborhood"), "count")
            .unionByName(by_hood.select(F.lit("neighborhood").alias("level"), "city",
                                        "neighborhood", "count")))


QUERIES = {
    "re_info_features": re_info_features,
    "re_features": re_features,
    "re_price_title_place": re_price_title_place,
    "re_reconcile_merge": re_reconcile_merge,
    "dq_reconcile": dq_reconcile,
    "re_clean": re_clean,
    "re_describe": re_describe,
    "re_value_counts": re_value_counts,
    "dq_nunique": dq_nunique,
    "dq_null_counts": dq_null_counts,
    "re_price_distribution": re_price_distribution,
    "re_empirical_rule": re_empirical_rule,
    "re_price_kde": re_price_kde,
    "re_characteristics_hist": re_characteristics_hist,
    "re_characteristics_kde": re_characteristics_kde,
    "re_feature_counts": re_feature_counts,
    "re_corr_matrix": re_corr_matrix,
    "re_price_by_feature": re_price_by_feature,
    "re_price_by_type": re_price_by_type,
    "re_price_by_city": re_price_by_city,
    "re_price_by_place": re_price_by_place,
    "re_city_counts": re_city_counts,
}
