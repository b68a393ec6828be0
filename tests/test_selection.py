"""Order statistics, correlations and salted joins against pandas, with a group
that holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbor.operators import joins as J
from arbor.operators import selection as X
from arbor.operators import stats as S

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    n = 20_000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    v = np.exp(rng.normal(size=n) * 3)
    v[rng.random(n) < 0.3] = 7.5
    v[g == "a"] = np.round(v[g == "a"])
    v[g == "b"] = 3.0
    v[:50] = np.nan
    g[50:90] = "none"
    v[50:90] = np.nan
    return pd.DataFrame({"g": g, "v": v})


def _frame(spark, table):
    return spark.createDataFrame(table).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("leaf", [16, 1 << 16])
def test_quantiles_equal_pandas(spark, monkeypatch, table, leaf):
    monkeypatch.setattr(X, "LEAF", leaf)
    got = S.quantiles(_frame(spark, table), ["g"], "v", PROBS).toPandas().set_index("g").sort_index()
    want = table.dropna().groupby("g").v.quantile(PROBS).unstack().sort_index()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.values, want.values, rtol=1e-12)


def test_a_refined_range_is_small_and_a_hot_value_is_found_at_once(spark, table):
    values = X.stage_table(X.counted(_frame(spark, table), ["g"], "v"), "t").withColumn("_range", F.lit(""))
    sizes = values.groupBy("g").agg(F.sum("_w").alias("_n"))
    need = X._wanted(sizes, ["g"], [0.5, 0.9]).withColumn("_range", F.lit(""))
    rows, left, sure = X._refined(values, need, ["g", "_range"], ["g"])
    widths = rows.groupBy("g", "_range").count().toPandas()["count"]
    assert widths.max() <= values.groupBy("g").count().toPandas()["count"].max() / 16
    assert sure.where("_v = 7.5 or _v = 3").count() > 0
    assert left.count() + sure.count() == need.count()


def test_no_percentile_buffer_in_the_plan(spark, table):
    plan = S.quantiles(_frame(spark, table), ["g"], "v", PROBS)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_describe_and_box_equal_pandas(spark, monkeypatch, table):
    monkeypatch.setattr(X, "LEAF", 64)
    df = _frame(spark, table)
    got = S.describe(df, ["v"], digits=None).first()
    want = table.v.describe()
    for a, b in zip(("count", "mean", "std", "min", "q25", "q50", "q75", "max"), want):
        assert got[a] == pytest.approx(b, rel=1e-9)
    boxes = {r.g: r for r in S.box_stats(df, ["g"], "v", digits=None).collect()}
    for g, own in table.dropna().groupby("g").v:
        q1, q3 = own.quantile(0.25), own.quantile(0.75)
        fine = own[(own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))]
        assert boxes[g].n == len(own) and boxes[g].outliers == len(own) - len(fine)
        assert (boxes[g].whisker_lo, boxes[g].whisker_hi) == (fine.min(), fine.max())


def test_correlations_are_stable_far_from_zero_and_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": 1e9 + rng.normal(size=3000), "c": np.full(3000, 1e9)})
    pdf["b"] = pdf.a - 1e9 + rng.normal(size=3000) + 1e9
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(5)
    got = {(r.col_a, r.col_b): r.r for r in S.corr_matrix(df, ["a", "b", "c"], digits=None).collect()}
    want = (pdf[["a", "b"]] - 1e9).corr()
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want.loc["a", "b"], abs=1e-6)
    assert got["a", "a"] == pytest.approx(1) and got["a", "c"] is None and got["c", "c"] is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join_and_spreads_the_hot_key(spark, how):
    left = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k9", 4), (None, 5)], "k string, v int")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.salted_join(left, right, ["k"], how, rows=200)
        want = left.join(right, ["k"], how)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
        tasks = [r["count"] for r in got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 5 and max(tasks) < 3000
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    with pytest.raises(ValueError):
        J.salted_join(left, right, ["k"], "full")


def test_group_transform_equals_pandas_transform(spark, table):
    df = _frame(spark, table.assign(g=table.g.where(table.g != "c")))
    got = J.group_transform(df, ["g"], {"m": F.avg("v"), "n": F.count("v")},
                            {"off": lambda m, n: F.col("v") - m, "share": F.col("v") / (F.col("m") * F.col("n"))}, rows=500)
    pdf = got.toPandas()
    assert len(pdf) == len(table) and list(got.columns) == ["g", "v", "off", "share"]
    known = pdf.dropna(subset=["g"])
    np.testing.assert_allclose(known.off, known.v - known.groupby("g").v.transform("mean"), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(known.share, known.v / known.groupby("g").v.transform("sum"), rtol=1e-6)
    assert pdf[pdf.g.isna()][["off", "share"]].isna().all().all()
    with pytest.raises(ValueError):
        J.group_transform(df, ["g"], {"v": F.avg("v")}, {"x": F.col("v")})
    with pytest.raises(Exception):  # no aggregate
        J.group_transform(df, ["g"], {"m": F.col("v")}, {"x": F.col("m")}).count()
