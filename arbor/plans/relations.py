"""Queries on operators that the other plans do not reach: lookups, named
tables in SQL text, multiplying merges, membership, renames, cast rejects and
distinct heads; their DuckDB texts state every constant anew."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.operators import extract as X
from arbor.operators import joins as J
from arbor.operators import quality as Q
from arbor.operators import relational as R
from arbor.operators import textrules as TR
from arbor.plans.hr import demographics
from arbor.plans.oracle_listings import RAW_LISTING
from arbor.sources.fixtures import raw_listing, review
from arbor.sources.tables import load, named, register_views


def join_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each stored page with its seed's link, looked up by the seed's key; a
    page of no seed keeps a NULL link."""
    pages = load(spark, sf, "pages")
    listed = X.list_pages(pages).select("page_id", "neighborhood_id", "page_index")
    return R.lookup(listed, X.seeds(pages), "neighborhood_id")


def src_view(spark, sf):
    """Orders and their value per market segment, by SQL over named views."""
    views = register_views(spark, sf, ("customer", "orders"))
    return spark.sql("""
        SELECT c_mktsegment AS segment, COUNT(*) AS n_orders,
               ROUND(SUM(CAST(o_totalprice AS DECIMAL(28, 2))), 2) AS value
        FROM IDENTIFIER(:orders) JOIN IDENTIFIER(:customer) ON o_custkey = c_custkey GROUP BY c_mktsegment""", args=views)


def src_temp(spark, sf):
    """The typed demographics table registered by name, then grouped in SQL."""
    name = named("demographics", sf)
    demographics(spark, sf, view=name)
    return spark.sql("""
        SELECT AgeGroup, Gender, COUNT(*) AS reviews, COUNT(DISTINCT EmployeeID) AS employees
        FROM IDENTIFIER(:demographics) GROUP BY AgeGroup, Gender""", args={"demographics": name})


def join_merge(spark, sf):
    """Orders merged with their line items: order rows multiply. An order with
    a large share of the lines would be spread over tasks."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return J.salted_join(lines, orders, ["id"]).select("id", "o_orderpriority", "l_linenumber")


def join_left_semi(spark, sf):
    """Customers who placed an urgent order, once each."""
    urgent = (load(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
              .select(F.col("o_custkey").alias("c_custkey")))
    return R.semi(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), urgent, "c_custkey")


def prj_rename(spark, sf):
    """Columns renamed by a dict; its key without a column is ignored."""
    return R.rename(load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"),
                    {"s_suppkey": "supplier_id", "s_nationkey": "nation_id", "s_rating": "rating"})


def typ_cast_int(spark, sf):
    """Per text attribute of a listing: texts, and texts that are no integer."""
    raw = raw_listing(spark, sf)
    place = TR.price_title_place_cols()
    texts = {"price": F.replace(F.col("price"), F.lit(","), F.lit("")), "city": place["city"],
             "city_number": T.strip(F.replace(place["city"], F.lit("City "), F.lit(""))),
             "floor": TR.short_feature_cols("features")["floor"]}
    return Q.cast_rejects(raw, texts, "int")


def agg_count_distinct(spark, sf):
    """Reviews and distinct employees per number of trainings taken."""
    return (review(spark, sf).groupBy("TrainingOpportunitiesTaken")
            .agg(F.count(F.lit(1)).alias("reviews"), F.countDistinct("EmployeeID").alias("employees")))


def dq_sentinel_year(spark, sf):
    """Listings whose year text is missing, by the sentinel that fills it."""
    raw = raw_listing(spark, sf)
    year = F.coalesce(TR.long_feature_cols("features")["year_built"].cast("string"), F.lit("404"))
    return Q.sentinel_rows(raw.withColumn("year", year), "year", "404", ["id", "price"])


QUERIES: Mapping = {
    "join_lookup": join_lookup,
    "src_view": src_view,
    "src_temp": src_temp,
    "join_merge": join_merge,
    "join_left_semi": join_left_semi,
    "prj_rename": prj_rename,
    "typ_cast_int": typ_cast_int,
    "agg_count_distinct": agg_count_distinct,
    "dq_sentinel_year": dq_sentinel_year,
}

ORACLE = {
    "join_lookup": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS neighborhood_id,
  coalesce(TRY_CAST(regexp_extract(url, '[?&]page=(\d+)', 1) AS INTEGER), 1) AS page_index FROM pages)
SELECT page_id, neighborhood_id, page_index,
  CASE WHEN neighborhood_id <> '' THEN concat('/', neighborhood_id, '/') END AS link FROM p""",
    "src_view": """
SELECT (SELECT c_mktsegment FROM customer c WHERE c.c_custkey = s.k) AS segment, SUM(n)::BIGINT AS n_orders,
  SUM(v) AS value
FROM (SELECT min(c_custkey) OVER (PARTITION BY c_mktsegment) AS k, c_custkey FROM customer) s
JOIN (SELECT o_custkey, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(28, 2))) AS v FROM orders GROUP BY 1) o
  ON o.o_custkey = s.c_custkey GROUP BY s.k""",
    "src_temp": """
SELECT CASE WHEN age >= 60 THEN '60+' WHEN age >= 50 THEN '50-59' WHEN age >= 40 THEN '40-49'
  WHEN age >= 30 THEN '30-39' ELSE '18-29' END AS AgeGroup, concat('G', k % 4) AS Gender,
  COUNT(*) AS reviews, COUNT(DISTINCT k) AS employees
FROM (SELECT o_custkey AS k, 18 + o_custkey % 50 AS age FROM orders
  WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = o_custkey))
GROUP BY 1, 2""",
    "join_merge": """
SELECT l_orderkey AS id, o_orderpriority, l_linenumber FROM lineitem, orders WHERE l_orderkey = o_orderkey""",
    "join_left_semi": """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1-URGENT')""",
    "prj_rename": "SELECT s_suppkey AS supplier_id, s_nationkey AS nation_id FROM supplier",
    "typ_cast_int": f"""
WITH {RAW_LISTING}, t AS (SELECT replace(price, ',', '') AS price,
  CASE WHEN id % 11 <> 0 THEN split_part(neighborhood, ', ', 2) END AS city,
  CASE WHEN id % 11 <> 0 THEN split_part(neighborhood, ', City ', 2) END AS city_number,
  CAST(id % 9 AS VARCHAR) AS floor FROM raw_listing),
u AS (SELECT * FROM (UNPIVOT t ON price, city, city_number, floor INTO NAME attribute VALUE v))
SELECT attribute, COUNT(v) AS texts, COUNT(*) FILTER (v IS NOT NULL AND NOT regexp_full_match(v, '[0-9]+')) AS rejects
FROM u GROUP BY attribute""",
    "agg_count_distinct": """
SELECT taken AS TrainingOpportunitiesTaken, COUNT(*) AS reviews, COUNT(DISTINCT o_custkey) AS employees
FROM orders JOIN (SELECT l_orderkey, SUM((l_returnflag = 'R')::INT)::BIGINT AS taken FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey GROUP BY taken""",
    "dq_sentinel_year": f"WITH {RAW_LISTING} SELECT id, price FROM raw_listing WHERE id % 7 = 0",
}
