"""Growth as a table function, texts compared without case, counts and bounds from file footers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import analysis as A
from fundscope.operators import cleaning as CL
from fundscope.operators import explore as X
from fundscope.operators import views as V
from fundscope.plans.workload import build, driver_tables
from fundscope.schemas import COUNTRY, IGNORE_CASE, PLEDGE_RAW, PROJECT_INFO_RAW, ignoring_case
from fundscope.sources.statistics import file_bounds, footer_session, read_with_bounds, write_with_bounds


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- table function ------------------------------------------------------------------------

def test_table_function_equals_the_set_form(spark):
    t = driver_tables(spark, SF01)
    t.enriched.createOrReplaceTempView("tf_enriched")
    A.register_growth_rates_table_function(spark, "tf_enriched", "tf_growth")
    assert _rows(spark.sql("SELECT * FROM tf_growth('1995', '2000')")) == _rows(A.growth_rates(t.enriched, 1995, 2000))
    pairs = spark.sql("SELECT a, b, g.* FROM VALUES (1995, 2000), (1998, 1993), (1996, 1996), (1, 2) y(a, b), "
                      "LATERAL tf_growth(CAST(a AS STRING), CAST(b AS STRING)) g")
    want = [(a, b, *r) for a, b in ((1995, 2000), (1998, 1993), (1996, 1996)) for r in A.growth_rates(t.enriched, a, b).collect()]
    assert _rows(pairs) == sorted(want, key=str)
    p = _plan(pairs)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_table_function_null_category_missing_and_placeholder_years(spark):
    rows = [("a", 2001), ("a", 2002), ("a", 2002), (None, 2001), (None, 2002), ("b", 2002), ("c", 1970), ("d", None)]
    spark.createDataFrame(rows, "main_category string, launch_year int").createOrReplaceTempView("tf_small")
    A.register_growth_rates_table_function(spark, "tf_small", "tf_small_growth")
    got = {r.main_category: tuple(r)[1:] for r in spark.sql("SELECT * FROM tf_small_growth('2001', '2002')").collect()}
    assert got == {"a": (1, 2, Decimal("1.00")), None: (1, 1, Decimal("0.00")), "b": (0, 1, None)}
    # a year without projects counts 0; the placeholder year has none; a NULL year neither
    assert {r.main_category: (r.start_no, r.end_no) for r in spark.sql("SELECT * FROM tf_small_growth('2002', '1970')").collect()} == \
        {"a": (2, 0), None: (1, 0), "b": (1, 0)}
    assert spark.sql("SELECT * FROM tf_small_growth('1970', NULL)").count() == 0


# -- texts compared without case --------------------------------------------------------------

def _mixed(spark, ignore):
    schema = ignoring_case if ignore else (lambda s, c=None: s)
    pi = spark.createDataFrame([(1, "x", "Rock", "Music", "02/03/2015", "01/01/2015 10:00", "GB"),
                                (2, "x", "rock", "MUSIC", "02/03/2015", "01/01/2015 10:00", "gb"),
                                (3, "x", "Jazz", "music", "02/03/2015", "01/01/2015 10:00", '"n'),
                                (4, "x", "Jazz", None, "02/03/2015", "01/01/2015 10:00", "Us")],
                               schema(PROJECT_INFO_RAW, ("category", "main_category", "country")))
    pl = spark.createDataFrame([(1, "Successful", "GBP", Decimal(1), Decimal(2)), (2, "FAILED", "gbp", Decimal(1), Decimal(2)),
                                (3, "Canceled", "eur", Decimal(1), Decimal(2)), (4, "LIVE", "USD", Decimal(1), Decimal(2))],
                               schema(PLEDGE_RAW))
    country = spark.createDataFrame([("C1", "United Kingdom", "gb"), ("C2", "United States", "US")], schema(COUNTRY))
    return build(pi, pl, country)


def test_joins_groups_and_windows_ignore_case(spark):
    t = _mixed(spark, True)
    assert t.enriched.schema["main_category"].dataType.collation == IGNORE_CASE
    e = {r.ID: (r.country, r.state_merged) for r in CL.fold_case(t.enriched).collect()}
    # the lookup's "gb" names GB, the sentinel and EUR are found in any spelling, states are merged in any spelling
    assert e == {1: ("united kingdom", "successful"), 2: ("united kingdom", "failed"), 3: ("unknown", "failed"), 4: ("united states", "other")}
    rates = _rows(CL.fold_case(V.success_rate(t.enriched)))
    assert rates == [("united kingdom", 2015, "music", "failed", 1, 2, 50.0), ("united kingdom", 2015, "music", "successful", 1, 2, 50.0),
                     ("unknown", 2015, "music", "failed", 1, 1, 100.0)]
    assert _rows(CL.fold_case(V.success_rate(t.enriched, by_window=True))) == rates
    assert _rows(CL.fold_case(V.success_rate_full(t.enriched))) == _rows(CL.fold_case(V.success_rate_full(t.enriched, by_join=True)))
    assert _rows(CL.fold_case(X.value_frequency(t.pledge, "currency"))) == [("eur", 1), ("gbp", 2), ("usd", 1)]
    assert X.distinct_count(t.project_info, "category").collect()[0][0] == 2
    top = CL.fold_case(A.top_categories_per_country(t.enriched, k=1)).collect()
    assert [(r.country, r.main_category, r.no_of_projects) for r in top] == [("united kingdom", "music", 1)]
    p = _plan(V.success_rate_full(t.enriched, by_join=True))
    assert "Cartesian" not in p and "NestedLoop" not in p


def test_binary_comparison_stays_the_default(spark):
    t = _mixed(spark, False)
    assert X.distinct_count(t.project_info, "category").collect()[0][0] == 3
    assert {r.ID: r.state_merged for r in t.enriched.collect()} == {1: "Successful", 2: "FAILED", 3: "Canceled", 4: "LIVE"}


def test_collation_survives_storing(spark, scratch):
    CL.ignore_case(spark.createDataFrame([("A", 1), ("a", 2), (None, 3), ("", 4)], "t string, n int")).write.parquet(f"{scratch}/c")
    back = spark.read.parquet(f"{scratch}/c")
    assert back.where("t = 'A'").count() == 2
    assert _rows(CL.fold_case(back.groupBy("t").count())) == sorted([("a", 2), (None, 1), ("", 1)], key=str)


# -- bounds from footers ------------------------------------------------------------------------

def _pushed(df):
    p = _plan(df)
    return "BatchScan" in p and "PushedAggregation: [COUNT" in p


def test_bounds_are_read_from_footers(spark, scratch):
    t = driver_tables(spark, SF01)
    write_with_bounds(t.pledge, f"{scratch}/pledge", ["usd_goal_real"])
    write_with_bounds(t.project_info, f"{scratch}/pi", ["launched", "launched_date", "ID"])
    s = footer_session(spark)
    goal, dates = file_bounds(s, f"{scratch}/pledge", ["usd_goal_real"]), file_bounds(s, f"{scratch}/pi", ["launched", "launched_date", "ID"])
    assert _pushed(goal) and _pushed(dates)
    assert tuple(goal.collect()[0]) == tuple(t.pledge.agg(F.count(F.lit(1)), F.count("usd_goal_real"), F.min("usd_goal_real"), F.max("usd_goal_real")).collect()[0])
    want = t.project_info.agg(F.count(F.lit(1)), *[f(c) for c in ("launched", "launched_date", "ID") for f in (F.count, F.min, F.max)])
    assert tuple(dates.collect()[0]) == tuple(want.collect()[0])
    assert [f.dataType for f in dates.schema.fields] == [f.dataType for f in want.schema.fields]
    assert sorted(map(str, read_with_bounds(spark, f"{scratch}/pledge").collect())) == sorted(map(str, t.pledge.collect()))
    # the caller's session keeps its settings
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_bounds_of_null_only_columns_empty_tables_and_extremes(spark, scratch):
    s, schema = footer_session(spark), "d date, t timestamp_ntz, m decimal(18,4), n bigint"
    lo, hi = -(1 << 63), (1 << 63) - 1
    rows = [(None, None, None, None), (dt.date(1, 1, 1), dt.datetime(1, 1, 1, 0, 0, 0, 1), Decimal("-99999999999999.9999"), lo),
            (dt.date(9999, 12, 31), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), Decimal("99999999999999.9999"), hi),
            (None, dt.datetime(1969, 12, 31, 23, 59, 59), Decimal("0.0001"), None)]
    # one file holds NULL only, so one row group has no statistics of its own
    for name, got in (("some", rows), ("none", rows[:1] * 3), ("empty", [])):
        spark.createDataFrame(got, schema).repartition(1).write.parquet(f"{scratch}/{name}_plain")
        df = spark.read.parquet(f"{scratch}/{name}_plain")
        df = df.where("m is null").coalesce(1).union(df.where("m is not null").coalesce(1))
        write_with_bounds(df, f"{scratch}/{name}", list("dtmn"))
        out = file_bounds(s, f"{scratch}/{name}", list("dtmn"))
        assert _pushed(out)
        want = spark.createDataFrame(got, schema).agg(F.count(F.lit(1)), *[f(c) for c in "dtmn" for f in (F.count, F.min, F.max)])
        assert tuple(out.collect()[0]) == tuple(want.collect()[0]), name


def test_bounds_do_not_depend_on_the_time_zone(spark, scratch):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = [(dt.datetime(2015, 3, 29, 2, 30),), (dt.datetime(2015, 10, 25, 2, 30, 0, 5),)]
    try:
        for zone in ("Europe/Berlin", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            write_with_bounds(spark.createDataFrame(rows, "t timestamp_ntz"), f"{scratch}/tz", ["t"])
            s = footer_session(spark)
            s.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(file_bounds(s, f"{scratch}/tz", ["t"]).collect()[0])[2:] == (rows[0][0], rows[1][0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_texts_have_no_bounds_until_parsed(spark, scratch):
    raw = spark.createDataFrame([("31/12/2015",), ("bad",), (None,)], "deadline string")
    with pytest.raises(ValueError, match="deadline"):
        write_with_bounds(raw, f"{scratch}/text", ["deadline"])
    parsed = CL.parse_dates(raw.withColumn("launched", F.lit(None).cast("string")))
    write_with_bounds(parsed, f"{scratch}/parsed", ["deadline", "launched"])
    got = file_bounds(footer_session(spark), f"{scratch}/parsed", ["deadline", "launched"]).collect()[0]
    assert tuple(got) == (3, 1, dt.date(2015, 12, 31), dt.date(2015, 12, 31), 0, None, None)
