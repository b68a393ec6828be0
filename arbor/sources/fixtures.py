"""Aliased views that express the reference's input tables on the driver
tables (FIXTURES.md section 3).

* ``employee``: one row per customer, HR attributes derived from keys.
* ``review``: one row per order that has line items, ratings derived from
  keys, training counts from the order's line items.
* ``raw_listing``: one scraped listing per part, with the title, place,
  price text and the short feature list as its text repr.
* crawl seeds and list pages come from ``pages`` (``arbor.operators.extract``).

Every column is a built-in expression, so the views stay inside whole-stage
codegen and Catalyst prunes what a query does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.sources.tables import load


def _s(c: Column) -> Column:
    return c.cast("string")


def employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer")
    nation = load(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    j = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
    return j.select(
        key.alias("EmployeeID"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("FirstName"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("LastName"),
        F.col("c_mktsegment").alias("Department"),
        F.col("n_name").alias("Ethnicity"),
        F.concat(F.lit("G"), _s(key % 4)).alias("Gender"),
        (F.lit(18) + key % 50).alias("Age"),
        F.col("c_acctbal").alias("Salary"),
        (key % 46).alias("DistanceFromHome_KM"),
        F.col("c_nationkey").alias("YearsAtCompany"),
        (F.col("c_nationkey") % 5).alias("YearsInMostRecentRole"),
        (F.col("c_nationkey") % 7).alias("YearsSinceLastPromotion"),
        (key % 3 == 0).alias("OverTime"),
        F.when(key % 3 == 0, "None").when(key % 3 == 1, "Some")
         .otherwise("Frequent").alias("BusinessTravel"),
        (F.col("c_acctbal") < 2000).alias("Attrition"),
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: line items offered / returned (map-side partial agg)."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("ReviewID")).agg(
        F.count(F.lit(1)).alias("TrainingOpportunitiesWithinYear"),
        F.count_if(F.col("l_returnflag") == "R").cast("bigint")
         .alias("TrainingOpportunitiesTaken"),
    )


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    mgr = F.substring("o_orderpriority", 1, 1).cast("int")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    r0 = orders.select(
        ok.alias("ReviewID"),
        ck.alias("EmployeeID"),
        F.col("o_orderdate").alias("ReviewDate"),
        mgr.alias("ManagerRating"),
        (F.lit(1) + ok % 5).alias("EnvironmentSatisfaction"),
        (F.lit(1) + (ok * 7) % 5).alias("JobSatisfaction"),
        (F.lit(1) + (ok * 3) % 5).alias("RelationshipSatisfaction"),
        (F.lit(1) + (ck + ok) % 5).alias("WorkLifeBalance"),
        F.least(F.lit(5).cast("bigint"), mgr + ok % 2).alias("SelfRating"),
    )
    # inner join: orders without line items fall out (as in the fixture)
    return r0.join(training(spark, sf_dir), "ReviewID", "inner")


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_listing`` as it reads after the CSV round trip: the short
    feature list is the text repr of a Python list."""
    part = load(spark, sf_dir, "part")
    pk, size = F.col("p_partkey"), F.col("p_size")
    bedrooms = F.when(size % 6 == 0, F.lit("no bedroom")).otherwise(
        F.concat(_s(size % 6), F.lit(" bedrooms")))
    built = F.when(pk % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit(", 'Built in "), _s(F.lit(1950) + size), F.lit("'")))
    lift = F.when(pk % 2 == 0, F.lit("with")).otherwise(F.lit("without"))
    features = F.concat(
        F.lit("['"), _s(F.lit(10) * size), F.lit(" m² built', '"), bedrooms,
        F.lit("', '"), _s(pk % 9), F.lit("th floor "), lift, F.lit(" lift'"),
        built,
        F.lit(", 'Consumption:"), _s(size), F.lit(","), _s(pk % 10),
        F.lit(" kWh/m² year']"),
    )
    no_city = pk % 11 == 0
    return part.select(
        pk.alias("id"),
        pk.alias("ingest_seq"),  # row position in the scraped file
        F.concat(F.col("p_type"), F.lit(" home for sale in "), F.col("p_name"))
         .alias("title"),
        F.concat(F.col("p_brand"),
                 F.when(no_city, F.lit("")).otherwise(F.lit(", City ")),
                 F.when(no_city, F.lit("")).otherwise(_s(size % 5)))
         .alias("neighborhood"),
        F.concat(_s(F.lit(100) + size), F.lit(","), _s(F.lit(100) + pk % 900))
         .alias("price"),
        features.alias("features"),
    )
