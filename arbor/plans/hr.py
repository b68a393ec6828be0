"""People-analytics queries (survey 2.16, ``hr_*``), one function per
question, each ``(spark, sf_dir) -> DataFrame``.

Inputs are the aliased ``employee`` and ``review`` views. Every average is
taken in double (the reference casts to FLOAT first) and rounded where the
reference rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from arbor.operators import relational as R
from arbor.operators import stats as S
from arbor.operators import windows as W
from arbor.session import stage_table
from arbor.sources.fixtures import employee, review

SATISFACTION_PAIRS = [
    ("EnvironmentSatisfaction", "ManagerRating"),
    ("JobSatisfaction", "ManagerRating"),
    ("RelationshipSatisfaction", "ManagerRating"),
    ("SelfRating", "ManagerRating"),
]

# The age groups of the demographics table (inclusive ranges)
AGE_GROUPS = [(18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"), (50, 59, "50-59")]
AGE_OTHER = "60+"

DEMOGRAPHICS = StructType([
    StructField("EmployeeID", StringType()),
    StructField("Gender", StringType()),
    StructField("Ethnicity", StringType()),
    StructField("AgeGroup", StringType()),
    StructField("SelfRating", IntegerType()),
    StructField("ManagerRating", IntegerType()),
])

YEARS_AND_JOB = StructType([
    StructField("YearsSincePromotion", IntegerType()),
    StructField("AVGJobSatisfaction", DoubleType()),
])


def _er(spark, sf):
    return R.inner(review(spark, sf), employee(spark, sf), "EmployeeID")


def hr_pearson_satisfaction(spark: SparkSession, sf: str) -> DataFrame:
    return S.pearson(review(spark, sf), SATISFACTION_PAIRS, digits=S.DIGITS)


def hr_rating_by_dept(spark, sf):
    return _er(spark, sf).groupBy("Department").agg(
        R.avg_round("ManagerRating").alias("avg_manager_rating"),
        R.avg_round("SelfRating").alias("avg_self_rating"))


def hr_satisfaction_by_attrition(spark, sf):
    return _er(spark, sf).groupBy("Attrition").agg(
        R.avg_round("EnvironmentSatisfaction").alias("avg_environment_satisfaction"),
        R.avg_round("JobSatisfaction").alias("avg_job_satisfaction"),
        R.avg_round("RelationshipSatisfaction").alias("avg_relationship_satisfaction"))


def hr_satisfaction_trend(spark, sf):
    """Sum over employees of their mean change to the next review (Q16:
    the reference sums; the mean is returned too). The per-employee mean
    uses the telescoping aggregate (no window over a hot employee)."""
    per_emp = W.mean_change(_er(spark, sf), ["EmployeeID", "Attrition"],
                            ["ReviewDate", "ReviewID"], "JobSatisfaction",
                            "step", digits=2)
    return per_emp.groupBy("Attrition").agg(
        R.sum_fixed("step", 2).alias("TotalSatisfactionChange"),
        R.avg_round("step", 6, scale=2).alias("MeanSatisfactionChange"))


def win_lead_diff(spark, sf):
    """Per review: next job satisfaction of the same employee and the
    change to it (LEAD inside slices of equal depth, so that a hot
    employee is many window partitions)."""
    r = review(spark, sf).select("EmployeeID", "ReviewID", "ReviewDate", "JobSatisfaction")
    return W.lead_change_sliced(stage_table(r, "reviews"), ["EmployeeID"], ["ReviewDate", "ReviewID"],
                                "JobSatisfaction", "NextJobSatisfaction", "SatisfactionChange")


def hr_distance_by_attrition(spark, sf):
    d = F.col("DistanceFromHome_KM").cast("double")
    return employee(spark, sf).groupBy("Attrition").agg(
        R.avg_round(d).alias("AvgDistance"),
        F.round(F.min(d), 2).alias("MinDistance"),
        F.round(F.max(d), 2).alias("MaxDistance"),
        F.count(F.lit(1)).alias("EmployeeCount"))


def hr_tenure_by_attrition(spark, sf):
    y = F.col("YearsAtCompany").cast("double")
    r = F.col("YearsInMostRecentRole").cast("double")
    return employee(spark, sf).groupBy("Attrition").agg(
        R.avg_round(y).alias("AvgYearsAtCompany"),
        F.round(F.min(y), 2).alias("MinYearsAtCompany"),
        F.round(F.max(y), 2).alias("MaxYearsAtCompany"),
        R.avg_round(r).alias("AvgYearsInMostRecentRole"),
        F.round(F.min(r), 2).alias("MinYearsInMostRecentRole"),
        F.round(F.max(r), 2).alias("MaxYearsInMostRecentRole"),
        F.count(F.lit(1)).alias("EmployeeAmount"))


def hr_leaver_tenure_dist(spark, sf):
    leavers = employee(spark, sf).filter(F.col("Attrition"))
    return leavers.groupBy("YearsAtCompany").agg(F.count(F.lit(1)).alias("EmployeeAmount"))


def hr_attrition_by_training(spark, sf):
    att = F.col("Attrition")
    out = _er(spark, sf).groupBy("TrainingOpportunitiesTaken").agg(
        R.count_if(att).alias("AttritionCount"),
        R.count_if(~att).alias("NoAttritionCount"),
        F.count(F.lit(1)).alias("TotalEmployees"))
    return out.withColumn("AttritionRate",
                          R.rate_pct(F.col("AttritionCount"), F.col("TotalEmployees"))
                          ).orderBy("TrainingOpportunitiesTaken")


def hr_final_year_training(spark, sf):
    """Training engagement in the leaver's final review vs earlier ones.
    The final date per leaver is a partial aggregate joined back (the inner
    join keeps only leavers' reviews)."""
    r = review(spark, sf).select("EmployeeID", "ReviewDate", F.col("TrainingOpportunitiesTaken").cast("double").alias("taken"),
                                 F.col("TrainingOpportunitiesWithinYear").cast("double").alias("offered"))
    left = employee(spark, sf).filter(F.col("Attrition")).select("EmployeeID")
    last = R.inner(r, left, "EmployeeID").groupBy("EmployeeID").agg(F.max("ReviewDate").alias("last_day"))
    period = F.when(F.col("ReviewDate") == F.col("last_day"), "Final Year").otherwise("Previous Year")
    return R.inner(r, last, "EmployeeID").groupBy(period.alias("ReviewPeriod")).agg(
        F.avg("taken").alias("AvgTrainingOpportunitiesTaken"), F.avg("offered").alias("AvgTrainingOpportunitiesAvailable"),
        F.round(F.avg(F.try_divide("taken", "offered")), 6).alias("AvgTrainingTakenRatio"),
        F.avg(F.col("offered") - F.col("taken")).alias("AvgMissedOpportunities"))


def hr_rating_by_training(spark, sf):
    return (review(spark, sf).groupBy("TrainingOpportunitiesTaken")
            .agg(R.avg_double("ManagerRating").alias("AvgManagerRating"),
                 F.count(F.lit(1)).alias("EmployeeCount"))
            .orderBy("TrainingOpportunitiesTaken"))


def hr_training_by_dept(spark, sf):
    return (_er(spark, sf).groupBy("Department")
            .agg(R.avg_round("TrainingOpportunitiesTaken").alias("AVGTrainingOpportunitiesTaken"),
                 F.sum("TrainingOpportunitiesTaken").cast("bigint")
                  .alias("TotalTrainingOpportunitiesTaken"),
                 F.count("EmployeeID").alias("EmployeeCount"))
            .orderBy("AVGTrainingOpportunitiesTaken"))


def hr_wlb_by_dept_overtime(spark, sf):
    return (_er(spark, sf).groupBy("Department", "OverTime")
            .agg(R.avg_round("WorkLifeBalance").alias("AVGWorkLifeBalance"),
                 F.count("EmployeeID").alias("EmployeeCount"))
            .orderBy("Department", "OverTime"))


def hr_wlb_by_attrition(spark, sf):
    return (_er(spark, sf).groupBy("Attrition")
            .agg(R.avg_round("WorkLifeBalance").alias("AVGWorkLifeBalance"),
                 F.count("EmployeeID").alias("EmployeeCount"))
            .orderBy("Attrition"))


def demographics(spark, sf, view: str | None = None) -> DataFrame:
    """``hr_demographics``: the typed #demographics table, filled by
    position."""
    q = _er(spark, sf).select(
        "EmployeeID", "Gender", "Ethnicity",
        R.bucket("Age", AGE_GROUPS, AGE_OTHER).alias("AgeGroup"),
        "SelfRating", "ManagerRating")
    return R.typed_table(spark, q, DEMOGRAPHICS, view)


def hr_demographics(spark, sf):
    return demographics(spark, sf)


def _ratings_by(spark, sf, key):
    return (demographics(spark, sf).groupBy(key)
            .agg(R.avg_round("SelfRating").alias("AvgSelfRating"),
                 R.avg_round("ManagerRating").alias("AvgManagerRating"),
                 F.count("EmployeeID").alias("EmployeeCount")))


def hr_rating_by_gender(spark, sf):
    return _ratings_by(spark, sf, "Gender").orderBy("AvgManagerRating")


def hr_rating_by_age(spark, sf):
    return _ratings_by(spark, sf, "AgeGroup").orderBy("AgeGroup")


def hr_rating_by_ethnicity(spark, sf):
    return _ratings_by(spark, sf, "Ethnicity").orderBy("AvgManagerRating")


def _salary_by(spark, sf, key):
    return (employee(spark, sf).groupBy(key)
            .agg(R.avg_round("Salary", scale=2).alias("AvgSalary"),
                 F.count(F.lit(1)).alias("Total"))
            .orderBy("AvgSalary"))


def hr_salary_by_ethnicity(spark, sf):
    return _salary_by(spark, sf, "Ethnicity")


def hr_salary_by_gender(spark, sf):
    return _salary_by(spark, sf, "Gender")


def hr_promotion_frequency(spark, sf):
    """The PromotionFrequency view (Q19: TotalPromotions counts rows per
    employee, as defined)."""
    e = employee(spark, sf).select("EmployeeID", "FirstName", "LastName",
                                   "YearsAtCompany", "YearsSinceLastPromotion")
    e = W.count_per_key(e, ["EmployeeID"], "_rows")
    ys = F.col("YearsSinceLastPromotion")
    return e.select(
        "EmployeeID", "FirstName", "LastName", "YearsAtCompany", "YearsSinceLastPromotion",
        F.when(ys == F.col("YearsAtCompany"), F.lit(0).cast("bigint"))
         .otherwise(F.col("_rows")).alias("TotalPromotions"),
        F.when(ys < 1, "Recent Promotion").when(ys.between(1, 3), "Moderate")
         .otherwise("Long Time Since Promotion").alias("PromotionCategory"))


def years_and_job(spark, sf, view: str | None = None) -> DataFrame:
    """The typed table of years and satisfaction (no ORDER BY: tables have no order)."""
    q = (_er(spark, sf).groupBy("YearsSinceLastPromotion")
         .agg(R.avg_round("JobSatisfaction").alias("avgJobSatisfaction")))
    return R.typed_table(spark, q, YEARS_AND_JOB, view)


def hr_promo_vs_satisfaction(spark, sf):
    return S.pearson(years_and_job(spark, sf),
                     [("YearsSincePromotion", "AVGJobSatisfaction")], digits=S.DIGITS)


def hr_dept_performance(spark, sf):
    return (_er(spark, sf).groupBy("Department")
            .agg(R.avg_round("ManagerRating").alias("avgManagerRating"),
                 R.avg_round("EnvironmentSatisfaction").alias("avgEnvironmentSatisfaction"),
                 R.avg_round("JobSatisfaction").alias("avgJobSatisfaction"),
                 R.avg_round("RelationshipSatisfaction").alias("avgRelationshipSatisfaction"))
            .orderBy("avgManagerRating"))


def hr_salary_tenure_rank(spark, sf):
    """The SalaryTenureDepartment view: RANK by salary and DENSE_RANK by
    tenure within a department, from counts per distinct value. The employees are staged: customer is read once."""
    e = stage_table(employee(spark, sf).select("Department", "EmployeeID", "Salary", "YearsAtCompany"), "employee")
    e = W.rank_by(e, ["Department"], "Salary", True, rank_name="SalaryRank")
    e = W.rank_by(e, ["Department"], "YearsAtCompany", True, rank_name=None,
                  dense_name="TenureRank")
    return e


def hr_attrition_by_travel(spark, sf):
    s = F.sum(F.col("Attrition").cast("int")).cast("bigint")
    return employee(spark, sf).groupBy("BusinessTravel").agg(
        F.count("EmployeeID").alias("TotalEmployees"),
        s.alias("AttritionCount"),
        R.round_ratio(s * 100, F.count("EmployeeID"), 2).alias("AttritionRate"))


def hr_rating_by_travel(spark, sf):
    return _er(spark, sf).groupBy("BusinessTravel").agg(
        R.avg_round("ManagerRating").alias("avgManagerRating"),
        F.count("EmployeeID").alias("EmployeeCount"))


QUERIES = {
    "hr_pearson_satisfaction": hr_pearson_satisfaction,
    "hr_rating_by_dept": hr_rating_by_dept,
    "hr_satisfaction_by_attrition": hr_satisfaction_by_attrition,
    "hr_satisfaction_trend": hr_satisfaction_trend,
    "win_lead_diff": win_lead_diff,
    "hr_distance_by_attrition": hr_distance_by_attrition,
    "hr_tenure_by_attrition": hr_tenure_by_attrition,
    "hr_leaver_tenure_dist": hr_leaver_tenure_dist,
    "hr_attrition_by_training": hr_attrition_by_training,
    "hr_final_year_training": hr_final_year_training,
    "hr_rating_by_training": hr_rating_by_training,
    "hr_training_by_dept": hr_training_by_dept,
    "hr_wlb_by_dept_overtime": hr_wlb_by_dept_overtime,
    "hr_wlb_by_attrition": hr_wlb_by_attrition,
    "hr_demographics": hr_demographics,
    "hr_rating_by_gender": hr_rating_by_gender,
    "hr_rating_by_age": hr_rating_by_age,
    "hr_rating_by_ethnicity": hr_rating_by_ethnicity,
    "hr_salary_by_ethnicity": hr_salary_by_ethnicity,
    "hr_salary_by_gender": hr_salary_by_gender,
    "hr_promotion_frequency": hr_promotion_frequency,
    "hr_promo_vs_satisfaction": hr_promo_vs_satisfaction,
    "hr_dept_performance": hr_dept_performance,
    "hr_salary_tenure_rank": hr_salary_tenure_rank,
    "hr_attrition_by_travel": hr_attrition_by_travel,
    "hr_rating_by_travel": hr_rating_by_travel,
}
