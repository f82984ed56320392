"""The SQL surface: analyses written as SQL against the registered views give the operators' results."""

from decimal import Decimal

from conftest import SF01
from fundscope.operators import analysis as A
from fundscope.operators import explore as X
from fundscope.operators import views as V
from fundscope.plans.workload import driver_tables, register_workload


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sql_over_registered_views(spark):
    t = driver_tables(spark, SF01)
    n = register_workload(spark, t, prefix="sqlt_")
    freq = spark.sql(f"SELECT state, COUNT(state) AS project_count FROM {n['pledge']} GROUP BY state")
    assert _rows(freq) == _rows(X.value_frequency(t.pledge, "state"))
    per_country = spark.sql(f"SELECT country, count(ID) AS n FROM {n['enriched']} "
                            "WHERE state_merged = 'successful' GROUP BY country")
    all_ranks = A.top_categories_per_country(t.enriched, k=10**6).groupBy("country").agg({"no_of_projects": "sum"})
    assert _rows(per_country) == _rows(all_ranks)
    full = spark.sql(f"SELECT COUNT(*) AS n, SUM(total_no) AS s FROM {n['success_rate_full']}").collect()[0]
    ref = V.success_rate_full(t.enriched)
    assert full.n == ref.count()
    g = spark.sql(f"SELECT {n['growth_rate']}('BUILDING/1', '1995', '2000') AS g").collect()[0].g
    assert g == A.growth_rate(t.enriched, "BUILDING/1", 1995, 2000).collect()[0][0]
    assert isinstance(g, Decimal)
    gv = spark.sql(f"SELECT COUNT(*) AS n FROM {n['goal_vs_pledge']}").collect()[0].n
    assert gv == V.goal_vs_pledge(t.enriched).count()
