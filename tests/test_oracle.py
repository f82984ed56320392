"""Every registered query against its DuckDB statement at sf0.01 (the driver's check)."""

import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from oracle_compare import compare, duck

_CON = {}


def _con(sf):
    if sf not in _CON:
        _CON[sf] = duck(sf)
    return _CON[sf]


def test_every_query_has_an_oracle():
    # the training-data queries have tests of their own where SQL can't say what they do
    own = {n for n in E.queries() if n == "pipeline" or n.startswith("op")}
    assert set(E.queries()) - own == {n for n in E.oracle_sql() if n not in own}


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith("op")))
def test_query_matches_oracle(spark, name):
    r = compare(spark, SF01, name, _con(SF01))
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["country", "main_category", "no_of_projects", "state_merged", "top_no"]
    assert compare(spark, SF001, "top_categories_per_country", _con(SF001))["ok"]


def test_queries_work_in_a_new_session_of_the_same_application(spark):
    other = spark.newSession()
    df = E.queries()["category_leaderboard_sql"](other, SF01)
    assert df.count() == 25
    assert E.queries()["growth_rate_sql_function"](other, SF01).count() == 1
