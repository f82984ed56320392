"""Invariants of the rates and the repair on the generated tables."""

from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import cleaning as CL
from fundscope.operators import views as V
from fundscope.plans.workload import driver_tables


def test_cell_percentages_sum_to_100(spark):
    t = driver_tables(spark, SF01)
    sums = (V.success_rate(t.enriched, ordered=False)
            .groupBy("country", "year", "main_category").agg(F.sum("percentage").alias("s")))
    assert sums.where(F.abs(F.col("s") - 100) > 0.021).count() == 0


def test_full_has_two_rows_per_cell_and_test_marks_filled(spark):
    t = driver_tables(spark, SF01)
    full = V.success_rate_full(t.enriched)
    per_cell = full.where("country <> 'TWIN NATIONS'").groupBy("country", "year", "main_category").count()
    assert per_cell.where(F.col("count") != 2).count() == 0
    full = full.where("country <> 'TWIN NATIONS'")  # a name of two codes shows each measure twice
    keyed = full.where(F.col("year").isNotNull())
    assert keyed.where(F.col("test").isNull() != (F.col("total_no") == 0)).count() == 0
    rates = V.success_rate(t.enriched, ordered=False).where("country <> 'TWIN NATIONS'")
    assert full.where(F.col("test").isNotNull()).count() == rates.where(F.col("year").isNotNull()).count()


def test_repair_leaves_no_missing_country_with_a_pledge(spark):
    t = driver_tables(spark, SF01)
    fixed = CL.repair_country(t.project_info, t.pledge)
    with_pledge = fixed.join(t.pledge.select("ID"), "ID", "left_semi")
    assert with_pledge.where(F.col("country").isNull()).count() == 0
    assert fixed.count() == t.project_info.count()  # a project without a pledge keeps its gap
    assert fixed.where(F.col("country") == '"N').count() == 0


def test_lazy_pipeline_equals_stored_pipeline(spark):
    stored = driver_tables(spark, SF01)
    lazy = driver_tables(spark, SF01, stored=False)
    assert lazy.enriched.count() == stored.enriched.count()
    assert lazy.enriched.exceptAll(stored.enriched.select(*lazy.enriched.columns)).count() == 0
    a = V.success_rate_full(lazy.enriched)
    b = V.success_rate_full(stored.enriched)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
