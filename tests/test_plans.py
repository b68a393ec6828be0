"""Plan-shape checks: built-in operators only (no Python evaluation),
column pruning and filter pushdown into the Parquet scan, one scan for a
whole rule table."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from arbor.functions import text as T
from arbor.plans import registry
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_evaluation(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_rule_table_is_one_scan(spark):
    p = _plan(E.queries()["re_reconcile_merge"](spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "Exchange" not in p


def test_scan_prunes_columns(spark):
    df = E.queries()["hr_leaver_tenure_dist"](spark, SF_SMALL)
    p = _plan(df)
    assert "c_acctbal" in p and "c_name" not in p.split("FileScan parquet")[1].split("ReadSchema")[1].split("\n")[0]
    assert "PushedFilters" in p


def test_leaver_filter_pushed_to_scan(spark):
    p = _plan(E.queries()["hr_leaver_tenure_dist"](spark, SF_SMALL))
    assert "LessThan(c_acctbal,2000.0)" in p


@pytest.mark.parametrize("name", ["re_price_kde", "re_characteristics_hist", "re_price_by_place"])
def test_staged_queries_read_no_raw_listing(spark, name):
    """Texts are matched once, in the stage: the plan has no scan of ``part``."""
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "part.parquet" not in p and "stages/" in p


def test_listing_dedupe_aggregates_two_columns(spark):
    p = _plan(E.queries()["re_clean"](spark, SF_SMALL))
    assert "SortAggregate" not in p


def test_reconcile_generator_matches_no_text(spark, scratch):
    """The values are projected once; the generator only pairs them."""
    spark.createDataFrame([(1, "n", "b", "t", 6, 1.0), (2, None, "b", None, None, None), (None, "n", None, "t", 3, 1.0),
                           (1, "n", "b", "t", 7, 1.0)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{scratch}/part.parquet")
    df = E.queries()["dq_reconcile"](spark, scratch)
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    generate = next(line for line in plan.splitlines() if "generate inline" in line)
    assert "split" not in generate and "regexp" not in generate and "lower" not in generate
    none = [("size", None), ("bedrooms", "0"), ("lift", "false"), ("exterior", "false")]
    want = [(a, i, v, None) for i in (2, None) for a, v in none]
    want.append(("bedrooms", 1, None, "0"))  # "no bedroom": no number in the short path
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_repr_item_is_an_element_of_repr_list(spark):
    texts = ["['a b', ' c\u00a0', \"'d'\"]", "[]", "", "['', 'x']", "'', ', ', z", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.array(*[F.get(T.repr_list("t"), i) for i in range(4)]).alias("a"),
        F.array(*[T.repr_item("t", i) for i in range(4)]).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
