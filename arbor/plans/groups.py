"""Queries on group functions carried back to rows, order statistics of large
groups, stored SQL, tables replaced whole, CSV with rejects, keys without regard
to case and merges with suffixes; their DuckDB texts state every constant anew."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from arbor.operators import joins as J
from arbor.operators import procedures as P
from arbor.operators import relational as R
from arbor.operators import stats as S
from arbor.plans.hr import demographics
from arbor.plans.listings import re_features, re_info_features
from arbor.session import shared_path
from arbor.sinks.catalog import replace_table
from arbor.sinks.writers import folded, write_csv
from arbor.sources.files import CORRUPT, read_csv, unfolded
from arbor.sources.fixtures import employee, review
from arbor.sources.tables import load, named


def join_group_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Each employee's salary against the mean of the department. The gap is
    rounded as the SQL rounds: scaled, then to a whole number; Spark's own ROUND
    goes by the shortest decimal text, which parts from it on ties."""
    e = employee(spark, sf).select("EmployeeID", "Department", "Salary")
    out = J.group_transform(e, ["Department"], {"_mean": F.avg("Salary"), "_n": F.count("Salary")},
                            {"gap": lambda mean, n: F.round((F.col("Salary") - mean) * 10_000) / 10_000,
                             "colleagues": lambda mean, n: n - 1})
    return out.drop("Salary")


def udf_group_lambda(spark, sf):
    """Each line item's place between the least and the largest price of its
    part, and whether its part is returned more often than not."""
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    price = F.col("l_extendedprice").cast("double")
    out = J.group_transform(
        rows, ["l_partkey"],
        {"_lo": F.min(price), "_hi": F.max(price), "_back": F.count_if(F.col("l_returnflag") == "R"), "_n": F.count(F.lit(1))},
        {"place": F.round(F.try_divide(price - F.col("_lo"), F.col("_hi") - F.col("_lo")), 6),
         "mostly_returned": F.col("_back") * 2 > F.col("_n")})
    return out.select("l_orderkey", "l_linenumber", "place", "mostly_returned")


def agg_order_stats(spark, sf):
    """Quantiles of prices by return flag: three groups hold all line items."""
    q = S.quantiles(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99])
    return q.select("l_returnflag", *[F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


def udf_proc_pearson(spark, sf):
    """The stored correlation called on a view by name, twice."""
    view = named("reviews", sf)
    review(spark, sf).createOrReplaceTempView(view)
    pairs = [("SelfRating", "ManagerRating"), ("TrainingOpportunitiesTaken", "WorkLifeBalance")]
    one, two = (P.call(spark, P.PEARSON, view, {"x": x, "y": y}, digits=6) for x, y in pairs)
    return one.unionByName(two)


def ddl_create_or_replace(spark, sf):
    """The demographics table created, replaced whole by its elder half, and read
    by name."""
    name, place = named("demographics_table", sf), shared_path(spark, "tables")
    people = demographics(spark, sf)
    replace_table(people, name, place)
    table = replace_table(people.where(F.col("AgeGroup").isin("40-49", "50-59", "60+")), name, place)
    return table.groupBy("AgeGroup").agg(F.count(F.lit(1)).alias("reviews"), F.sum("SelfRating").alias("self_ratings"))


NOTES = StructType([StructField("id", LongType()), StructField("brand", StringType()), StructField("size", IntegerType()),
                    StructField("note", StringType())])


def csv_round_trip(spark, sf):
    """Parts written as CSV and read again: texts with quotes, commas and line
    ends come back whole, and rows whose size is no number are counted."""
    part, key = load(spark, sf, "part"), F.col("p_partkey")
    note = F.concat("p_name", F.lit(', "'), "p_type", F.when(key % 5 == 0, F.lit('"\nsecond line\\n')).otherwise(F.lit("")))
    size = F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    rows = part.select(key.alias("id"), F.col("p_brand").alias("brand"), size.alias("size"), note.alias("note"))
    path = shared_path(spark, "parts-csv")
    write_csv(rows.withColumn("note", folded("note")), path)
    back = read_csv(spark, path, NOTES).withColumn("note", unfolded("note"))
    return back.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("rejects"), F.sum("size").alias("sizes"),
        F.sum(F.length("note")).alias("note_chars"), F.count_if(F.contains("note", F.lit("\n"))).alias("with_line_end"))


def _spelled(column: str, key: str) -> Column:
    text, k = F.col(column), F.col(key)
    return F.when(k % 3 == 0, F.lower(text)).when(k % 3 == 1, F.initcap(text)).otherwise(text)


def agg_any_case(spark, sf):
    """Customers and balances by segment, however it is spelled."""
    rows = load(spark, sf, "customer").select(_spelled("c_mktsegment", "c_custkey").alias("segment"), "c_acctbal")
    out = rows.groupBy(R.any_case("segment").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(28,2)")).alias("balance"))
    return out.where(F.col("k") != F.lit("FURNITURE")).select(F.lower(R.plain("k")).alias("segment"), "n", "balance")


def join_any_case(spark, sf):
    """Customers joined with their nation by a name in another spelling."""
    people = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select("c_custkey", R.any_case(_spelled("n_name", "c_custkey")).alias("k"))
    names = load(spark, sf, "nation").select(R.any_case(F.initcap("n_name")).alias("k"), "n_regionkey")
    return people.join(names, "k").groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").cast("bigint").alias("keys"))


def prj_suffix(spark, sf):
    """Both feature tables of a listing merged: columns of both get a suffix."""
    short, long_ = re_info_features(spark, sf), re_features(spark, sf)
    out = R.merge(short.select("id", "lift", "exterior"), long_.select("id", "lift", "exterior", "terrace"), "id")
    return out.select("id", "lift_x", "lift_y", "exterior_x", "exterior_y", "terrace")


QUERIES: Mapping = {f.__name__: f for f in (
    join_group_stat, udf_group_lambda, agg_order_stats, udf_proc_pearson, ddl_create_or_replace, csv_round_trip,
    agg_any_case, join_any_case, prj_suffix)}

_STAFF = "(SELECT c_custkey, c_mktsegment, c_acctbal FROM customer SEMI JOIN nation ON c_nationkey = n_nationkey)"
_RATED = """SELECT o_orderkey AS k, o_custkey AS c, substr(o_orderpriority, 1, 1)::INT AS m, n, r FROM orders
  JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey"""

ORACLE = {
    "join_group_stat": f"""
SELECT c_custkey AS EmployeeID, c_mktsegment AS Department, round(c_acctbal - m, 4) AS gap, n - 1 AS colleagues
FROM {_STAFF} JOIN (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM {_STAFF} GROUP BY 1) USING (c_mktsegment)""",
    "udf_group_lambda": """
SELECT l_orderkey, l_linenumber,
  round((l_extendedprice::DOUBLE - min(l_extendedprice::DOUBLE) OVER p)
    / nullif(max(l_extendedprice::DOUBLE) OVER p - min(l_extendedprice::DOUBLE) OVER p, 0), 6) AS place,
  avg((l_returnflag = 'R')::INT) OVER p > 0.5 AS mostly_returned
FROM lineitem WINDOW p AS (PARTITION BY l_partkey)""",
    "agg_order_stats": """
SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.1), 4) AS p10,
  round(median(l_extendedprice::DOUBLE), 4) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.99), 4) AS p99
FROM lineitem GROUP BY l_returnflag""",
    "udf_proc_pearson": f"""
WITH v AS ({_RATED})
SELECT 'SelfRating' AS ColumnX, 'ManagerRating' AS ColumnY, round(corr(least(5, m + k % 2), m), 6) AS PearsonCorrelation FROM v
UNION ALL SELECT 'TrainingOpportunitiesTaken', 'WorkLifeBalance', round(corr(r, 1 + (c + k) % 5), 6) FROM v""",
    "ddl_create_or_replace": f"""
SELECT CASE WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' ELSE '60+' END AS AgeGroup, count(*) AS reviews,
  sum(self)::BIGINT AS self_ratings
FROM (SELECT 18 + c % 50 AS age, least(5, m + k % 2) AS self FROM ({_RATED}) WHERE c IN (SELECT c_custkey FROM {_STAFF}))
WHERE age >= 40 GROUP BY 1""",
    "csv_round_trip": """
SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (p_partkey % 13 = 0) AS rejects,
  sum(p_size) FILTER (p_partkey % 13 <> 0)::BIGINT AS sizes,
  sum(length(p_name) + 3 + length(p_type) + CASE WHEN p_partkey % 5 = 0 THEN 15 ELSE 0 END)::BIGINT AS note_chars,
  count(*) FILTER (p_partkey % 5 = 0) AS with_line_end
FROM part GROUP BY p_brand""",
    "agg_any_case": """
SELECT lower(c_mktsegment) AS segment, count(*) AS n, sum(c_acctbal::DECIMAL(28, 2)) AS balance
FROM customer WHERE lower(c_mktsegment) <> 'furniture' GROUP BY 1""",
    "join_any_case": """
SELECT n_regionkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""",
    "prj_suffix": """
SELECT p_partkey AS id, p_partkey % 2 = 0 AS lift_x, p_partkey % 2 = 0 AS lift_y, false AS exterior_x,
  false AS exterior_y, false AS terrace FROM part""",
}
