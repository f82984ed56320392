"""Counts and values recorded in FIXTURES.md for sf0.01 (observed there in Spark and DuckDB)."""

from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import analysis as A
from fundscope.operators import cleaning as CL
from fundscope.operators import explore as X
from fundscope.operators import views as V
from fundscope.plans.workload import driver_tables


def test_sf001_anchors(spark):
    t = driver_tables(spark, SF01)
    pi, pl, en = t.project_info, t.pledge, t.enriched
    assert (pi.count(), pl.count(), en.count()) == (15087, 14997, 14942)
    assert pl.select("state").distinct().count() == 6
    assert pi.select("main_category").distinct().count() == 25
    assert pi.select("category").distinct().count() == 101
    assert en.select("country").distinct().count() == 25
    assert pl.select("currency").distinct().count() == 22
    corrupt = pi.where(F.col("country") == '"N')
    assert corrupt.count() == 302
    fixed = CL.repair_country(pi, pl).join(corrupt.select("ID"), "ID", "left_semi")
    assert fixed.where(F.col("country") == "Unknown").count() == 58
    assert X.suspicious_rows(pi).count() == 152
    assert X.country_currency_counts(CL.repair_country(pi, pl), pl).count() == 51
    assert A.top_categories_per_country(en).count() == 268
    assert A.avg_project_length(en).count() == 52
    assert A.goal_vs_pledged_summary(en, by="country").count() == 52
    rates = V.success_rate(en, ordered=False)
    full = V.success_rate_full(en)
    assert rates.count() == 5819
    assert full.count() == 8306
    assert full.where(F.col("test").isNull()).count() == 2208
    assert round(A.avg_success_rate(full).collect()[0][0], 2) == 46.34
    over_rates = rates.where(F.col("state_merged") == "successful").agg(F.avg("percentage")).collect()[0][0]
    assert round(over_rates, 2) == 66.16
    assert V.goal_vs_pledge(en).count() == 9875
    assert A.category_leaderboard(rates).count() == 25
