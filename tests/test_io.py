"""Sinks, file sources and the streaming extraction."""

import os

import pytest
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from arbor.plans import listings
from arbor.sinks.writers import write_csv, write_parquet
from arbor.sources.files import read_csv, read_repr_list_columns
from arbor.sources.tables import load
from arbor.streaming.pages import start_page_extraction
from conftest import SF_SMALL


def test_parquet_round_trip(spark, scratch):
    df = listings.re_reconcile_merge(spark, SF_SMALL)
    path = os.path.join(scratch, "structured")
    write_parquet(df, path)
    back = spark.read.parquet(path)
    assert back.dtypes == df.dtypes and back.exceptAll(df).count() == 0


def test_csv_round_trip_with_repr_list(spark, scratch):
    df = spark.createDataFrame([(1, "['90 m² built', '3 bedrooms']", "a, b")],
                               "id int, info string, place string")
    path = os.path.join(scratch, "raw")
    write_csv(df, path)
    schema = StructType([StructField("id", StringType()), StructField("info", StringType()),
                         StructField("place", StringType())])
    back = read_repr_list_columns(read_csv(spark, path, schema), "info", 3, "c")
    r = back.first()
    assert (r["c0"], r["c1"], r["c2"]) == ("90 m² built", "3 bedrooms", None)


def test_streaming_extraction_matches_batch(spark, scratch):
    src = os.path.join(scratch, "pages")
    load(spark, SF_SMALL, "pages").repartition(3).write.parquet(src)
    rec, err = os.path.join(scratch, "rec"), os.path.join(scratch, "err")
    qs = start_page_extraction(spark, src, rec, err, checkpoint=os.path.join(scratch, "ck"),
                               available_now=True)
    for q in qs:
        q.awaitTermination(120)
    pages = load(spark, SF_SMALL, "pages")
    assert spark.read.parquet(rec).count() + spark.read.parquet(err).count() == pages.count()


def test_table_is_replaced_whole_and_read_by_a_second_session(spark, scratch):
    from arbor.sinks.catalog import replace_table, versions
    name = "t_replaced_whole"
    assert replace_table(spark.range(3).toDF("a"), name, scratch).count() == 3
    replace_table(spark.range(5).selectExpr("id AS a", "id * 2 AS b"), name, scratch)
    other = spark.newSession()
    assert other.table(name).columns == ["a", "b"] and other.table(name).count() == 5
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("a"))
    with pytest.raises(Exception):
        replace_table(broken, name, scratch)
    assert other.table(name).count() == 5 and len(versions(spark, name)) == 2
    for n in range(3):
        replace_table(spark.range(n).toDF("a"), name, scratch)
    assert spark.table(name).count() == 2 and len(versions(spark, name)) == 2
    spark.sql(f"DROP VIEW {name}")


def test_csv_rejects_and_splits(spark, scratch):
    from pyspark.sql.types import IntegerType
    from arbor.sinks.writers import folded
    from arbor.sources.files import CORRUPT, good_rows, unfolded
    texts = ['a "quoted", text', "two\nlines", "back\\slash\\n", "\\\\n\r\n", "", "end\\", None]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("x", "bad"), ("9.5", "bad")], "id string, t string")
    path = os.path.join(scratch, "c")
    write_csv(df.withColumn("t", folded("t")).coalesce(1), path)
    schema = StructType([StructField("id", IntegerType()), StructField("t", StringType())])
    back = read_csv(spark, path, schema)
    assert sorted(r[CORRUPT] for r in back.where(F.col(CORRUPT).isNotNull()).collect()) == ["9.5,bad", "x,bad"]
    got = {r.id: r.t or "" for r in good_rows(back).withColumn("t", unfolded("t")).collect()}
    assert got == {k: t or "" for k, t in enumerate(texts)}
    big = os.path.join(scratch, "big")
    spark.range(200_000).selectExpr("CAST(id AS STRING) AS id", "repeat('x', 40) AS t").coalesce(1).write.option("header", True).csv(big)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert read_csv(spark, big, schema).select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert read_csv(spark, big, schema).count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_stored_sql_names_what_is_missing(spark):
    from arbor.operators import procedures as P
    spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "a int, b double").createOrReplaceTempView("stored_sql_view")
    row = P.call(spark, P.PEARSON, "stored_sql_view", {"x": "a", "y": "b"}, digits=6).first()
    assert tuple(row) == ("a", "b", 1.0)
    spread = P.call(spark, P.SPREAD, "stored_sql_view", {"by": "b", "column": "a"}).collect()
    assert len(spread) == 3 and all(r.n_distinct == 1 for r in spread)
    with pytest.raises(ValueError, match="no column 'c; DROP'"):
        P.call(spark, P.PEARSON, "stored_sql_view", {"x": "a", "y": "c; DROP"}, digits=6)
    with pytest.raises(ValueError, match="no table or view 'nowhere'"):
        P.call(spark, P.PEARSON, "nowhere", {"x": "a", "y": "b"}, digits=6)


def test_keys_without_regard_to_case(spark):
    from arbor.operators import relational as R
    df = spark.createDataFrame([("Ana", 1), ("ANA", 2), ("ana", 3), ("Ñu", 4), ("ñU", 5), (None, 6)], "k string, v int")
    got = {r.k: r.s for r in df.groupBy(R.any_case("k").alias("g")).agg(F.sum("v").alias("s")).select(
        F.lower(R.plain("g")).alias("k"), "s").collect()}
    assert got == {"ana": 6, "ñu": 9, None: 6}
    names = spark.createDataFrame([("aNA", "x")], "k string, n string")
    assert df.join(names, R.any_case(df.k) == R.any_case(names.k)).count() == 3
    assert df.where(R.any_case("k") == "ana").count() == 3


def test_merge_suffixes(spark):
    from arbor.operators import relational as R
    a, b = spark.createDataFrame([(1, 2, 3)], "id int, p int, q int"), spark.createDataFrame([(1, 4, 5)], "id int, p int, z int")
    assert R.merge(a, b, "id").columns == ["id", "p_x", "q", "p_y", "z"]
    assert R.merge(a, b, "id", ("", "_r")).columns == ["id", "p", "q", "p_r", "z"]
