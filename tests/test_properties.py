"""Properties of the operators on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

import pytest

from arbor.operators import extract as X
from arbor.operators import stats as S
from arbor.operators import textrules as TR
from arbor.operators import windows as W
from arbor.plans import hr, listings, quality
from arbor.sources.fixtures import raw_listing, review
from arbor.sources.tables import load
from conftest import SF_MID, SF_SMALL


def test_rule_tables_keep_row_count(spark):
    n = raw_listing(spark, SF_SMALL).count()
    assert listings.re_features(spark, SF_SMALL).count() == n
    assert listings.re_info_features(spark, SF_SMALL).count() == n
    assert listings.re_reconcile_merge(spark, SF_SMALL).count() == n


def test_histogram_counts_sum_to_non_null(spark):
    df = listings.analysis_listing(spark, SF_SMALL)
    h = S.histograms(df, {"price": 10, "floor": 7})
    sums = {r["series"]: r["s"] for r in h.groupBy("series").agg(F.sum("count").alias("s")).collect()}
    assert sums["price"] == df.filter(F.col("price").isNotNull()).count()
    assert sums["floor"] == df.filter(F.col("floor").isNotNull()).count()


def test_corr_symmetric_and_bounded(spark):
    rows = listings.re_corr_matrix(spark, SF_SMALL).collect()
    r = {(x["col_a"], x["col_b"]): x["r"] for x in rows}
    for (a, b), v in r.items():
        assert v == r[(b, a)]
        assert v is None or -1.000001 <= v <= 1.000001


def test_rank_not_below_dense_rank(spark):
    e = hr.hr_salary_tenure_rank(spark, SF_SMALL)
    e2 = W.rank_by(e, ["Department"], "YearsAtCompany", True, rank_name="TR", dense_name=None)
    assert e2.filter(F.col("TR") < F.col("TenureRank")).count() == 0


def test_mean_change_equals_lead_window(spark):
    r = review(spark, SF_SMALL)
    win = W.lead_change(r, ["EmployeeID"], ["ReviewDate", "ReviewID"], "JobSatisfaction",
                        "nxt", "chg").groupBy("EmployeeID").agg(F.avg("chg").alias("a"))
    agg = W.mean_change(r, ["EmployeeID"], ["ReviewDate", "ReviewID"], "JobSatisfaction", "b")
    j = win.join(agg, "EmployeeID")
    assert j.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_dedupe_idempotent(spark):
    d = quality.win_dedupe_first(spark, SF_SMALL)
    again = W.dedupe_first(d, ["doc_id"], "doc_id")
    assert again.count() == d.count()


def test_records_plus_rejects_cover_pages(spark):
    pages = load(spark, SF_SMALL, "pages")
    assert X.records(pages).count() + X.error_rows(pages).count() == pages.count()


def test_crawl_reads_pages_from_the_first_to_the_first_gap(spark):
    def pages(*indices, site="h"):
        return [(k, f"http://{site}.example.com/en/{k}?page={p}", '<li class="next">' if p % 2 else "<p>")
                for k, p in enumerate(indices)]
    rows = pages(1, 2, 2, 3, 5, 70) + pages(2, 3, site="no-first") + pages(1, site="one")
    lp = X.list_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    read = lambda **o: sorted((r.list_id[:1], r.page_index, r.is_last) for r in X.crawl_pages(lp, **o).collect())
    assert read() == [("h", 1, False), ("h", 2, False), ("h", 2, False), ("h", 3, True), ("o", 1, True)]
    assert read(next_marker='<li class="next"') == [("h", 1, False), ("h", 2, True), ("h", 2, True), ("o", 1, True)]
    assert read(cap=1) == [("h", 1, False), ("o", 1, True)]
    assert {r.list_id[:1]: r["last"] for r in X.last_pages(lp).collect()} == {"h": 3, "n": 0, "o": 1}


def test_crawl_drops_pages_of_the_stored_table(spark):
    lp = X.list_pages(load(spark, SF_MID, "pages"))
    kept = X.crawl_pages(lp)
    assert 0 < kept.count() < lp.count() and kept.where("page_index > 1").count() > 0


@pytest.mark.parametrize("partitions", [16, 64])
def test_sliced_lead_equals_window_lead_under_skew(spark, partitions):
    """At sf0.1, on a wide frame, without exchange reuse, with a hot employee."""
    from pyspark.sql import functions as F
    r = review(spark, "/root/testdata/sf0.1")
    hot = r.withColumn("EmployeeID", F.when(F.col("ReviewID") % 3 == 0, F.lit(-1))
                       .otherwise(F.col("EmployeeID"))).withColumn("more", F.col("ReviewID") + 1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for df in (r, hot):
            a = W.lead_change(df, ["EmployeeID"], ["ReviewDate", "ReviewID"], "JobSatisfaction", "n", "c")
            b = W.lead_change_sliced(df, ["EmployeeID"], ["ReviewDate", "ReviewID"], "JobSatisfaction", "n", "c")
            key = ["EmployeeID", "ReviewID", "n", "c"]
            assert a.count() == b.count()
            assert a.select(*key).exceptAll(b.select(*key)).count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("descending", [True, False])
def test_rank_in_slices_equals_plain_window(spark, monkeypatch, descending):
    """A hot key with a third of the rows, ties, NULL values and a NULL key."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 1009 - 300).alias("v"), "id")
    o = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    w = Window.partitionBy("k").orderBy(o)
    want = df.select("*", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"))
    for small in (100_000, 0):  # at once, and in slices
        monkeypatch.setattr(W, "SMALL", small)
        got = W.rank_by(df, ["k"], "v", descending, "r", "d")
        assert got.count() == 3000 and got.exceptAll(want).count() == 0


def test_slices_of_a_skewed_key_are_of_one_depth(spark):
    """Salaries of one department, far from even: no slice holds more than four
    times the median."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("k"),
                                    F.exp(F.rand(7) * 12).alias("v"))
    df = W.stage_table(df, "skewed")
    n = sorted(r["count"] for r in W.sliced(df, ["k"], ["v"]).groupBy("_slice").count().collect())
    assert len(n) == 8 and n[-1] <= 4 * n[len(n) // 2]


def test_keep_first_equals_dedupe_first(spark):
    rows = [(1, 5, "a"), (1, 2, "b"), (None, 9, "c"), (None, 1, "d"), (2, 3, None)]
    df = spark.createDataFrame(rows, "k int, o int, t string")
    assert sorted(map(tuple, W.keep_first(df, ["k"], "o").collect()), key=repr) == sorted(
        map(tuple, W.dedupe_first(df, ["k"], "o").collect()), key=repr)


def test_ratio_of_large_sums(spark):
    from pyspark.sql import functions as F

    from arbor.operators import relational as R
    df = spark.createDataFrame([(9 * 10 ** 17 + 5, 4), (-7, 2), (1, 0)], "n long, d long")
    got = [r[0] for r in df.select(R.round_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [(9 * 10 ** 17 + 5) / 4, -3.5, None]


def test_basements_on_request(spark):
    texts = ["['50 m² built', 'Semi-basement']", "['50 m² built', 'Basement exterior']",
             "['50 m² built', 'Basement', 'Floor -2']", "['50 m² built', '3rd floor']", "['50 m² built']", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")

    def floors(**options):
        return [r.floor for r in TR.long_features(df, "k", "t", **options).orderBy("id").collect()]

    assert floors() == [0, 0, -2, 3, 0, 0]
    assert floors(basement=True) == [-1, -1, -2, 3, 0, 0]


def test_impute_keeps_rows_without_a_key_on_request(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 7.0), (None, None)], "k string, v double")

    def values(**options):
        return sorted(((r.k, r.v) for r in W.group_impute(df, "k", "v", **options).collect()), key=str)

    kept = [("a", 1.0), ("a", 2.0), ("a", 3.0)]
    assert values() == sorted([*kept, (None, None), (None, None)], key=str)
    assert values(keep_null_key=True) == sorted([*kept, (None, 7.0), (None, None)], key=str)
