"""Tiny literal inputs for what the generated tables cannot show."""

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from fundscope import schemas
from fundscope.operators import analysis as A
from fundscope.operators import cleaning as CL
from fundscope.operators import explore as X
from fundscope.operators import integrity as I
from fundscope.operators import views as V
from fundscope.sources.country import country_dim
from fundscope.sources.delimited import read_delimited, read_pledge, read_project_info

PI_HEADER = "ID,name,category,main_category,deadline,launched,country"


def _write(path, lines):
    with open(path, "w", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")


def test_unquoted_read_keeps_sentinel_and_shifts_on_commas(spark, scratch):
    p = os.path.join(scratch, "project_info.csv")
    _write(p, [PI_HEADER,
               '1,A,Art,Art,01/02/2015,01/01/2015 10:00,GB',
               '2,"B, c",Games,Games,01/02/2015,01/01/2015 10:00,US',
               '3,C,Art,Art,01/02/2015,01/01/2015 10:00,"N,0'])
    rows = {r.ID: r for r in read_project_info(spark, p).collect()}
    assert rows[1].country == "GB"
    assert rows[3].country == '"N'          # last column is the sentinel, the rest dropped
    assert rows[2].name == '"B'             # comma inside quotes splits the field
    assert rows[2].category == ' c"'


def test_pledge_read_money(spark, scratch):
    p = os.path.join(scratch, "pledge.csv")
    _write(p, ["ID,state,currency,usd_goal_real,usd_pledged_real", "1,failed,GBP,1000.5,12.25",
               "2,live,\\N,bad,3"])
    rows = {r.ID: r for r in read_pledge(spark, p).collect()}
    assert rows[1].usd_goal_real == 1000.5
    assert rows[2].currency is None and rows[2].usd_goal_real is None


def test_lenient_and_bad_dates(spark):
    df = spark.createDataFrame(
        [(1, "1/2/2015 19:05", "1/2/2015"), (2, "01/02/2015 9:05", "01/02/2015"),
         (3, "31/04/2015 10:00", "31/04/2015"), (4, "bad", "bad"), (5, None, None)],
        "ID long, launched string, deadline string")
    out = {r.ID: r for r in CL.load_project_info(df).collect()}
    assert out[1].launched == dt.datetime(2015, 2, 1, 19, 5) and out[1].deadline == dt.date(2015, 2, 1)
    assert out[2].launched == dt.datetime(2015, 2, 1, 9, 5) and out[2].launched_date == dt.date(2015, 2, 1)
    assert out[3].launched is None and out[3].deadline is None
    assert out[4].launched is None and out[5].launched is None
    bad = CL.unparseable_dates(df).collect()[0]
    assert (bad.bad_launched, bad.bad_deadline) == (2, 2)
    assert dict(CL.load_project_info(df).dtypes)["launched"] == "timestamp_ntz"


def _pi(spark, rows):
    return spark.createDataFrame(rows, "ID long, main_category string, category string, launched timestamp_ntz, "
                                       "deadline date, country string, launched_date date")


def _pl(spark, rows):
    return spark.createDataFrame(rows, "ID long, state string, currency string, usd_goal_real double, "
                                       "usd_pledged_real double")


def test_country_repair_cases(spark):
    t = dt.datetime(2015, 1, 1)
    d = dt.date(2015, 1, 1)
    pi = _pi(spark, [(1, "A", "a", t, d, '"N', d), (2, "A", "a", t, d, '"N', d), (3, "A", "a", t, d, '"N', d),
                     (4, "A", "a", t, d, "DE", d), (5, "A", "a", t, d, '"N', d)])
    pl = _pl(spark, [(1, "failed", "GBP", 1.0, 1.0), (2, "failed", "EUR", 1.0, 1.0),
                     (3, "failed", None, 1.0, 1.0), (4, "failed", "EUR", 1.0, 1.0)])
    fixed = {r.ID: r.country for r in CL.repair_country(pi, pl).collect()}
    assert fixed == {1: "GB", 2: "Unknown", 3: "Unknown", 4: "DE", 5: None}
    prev = {(r.currency, r.country_new) for r in CL.country_repair_preview(pi, pl).collect()}
    assert ("EUR", "EU") in prev and ("GBP", "GB") in prev and (None, None) in prev
    co = spark.createDataFrame([("GBR", "United Kingdom", "GB")], "countrycode string, countryname string, code string")
    en = {r.ID: r for r in CL.enrich(pi, pl, co).collect()}
    assert en[1].country == "United Kingdom" and en[1].country_code == "GB"
    assert en[2].country == "Unknown" and en[4].country == "DE"   # unmatched lookup keeps the code
    assert 5 not in en


def test_merge_state_passes_unlisted_through(spark):
    pl = _pl(spark, [(1, "canceled", "X", None, None), (2, "paused", "X", None, None), (3, None, "X", None, None),
                     (4, "live", "X", None, None), (5, "successful", "X", None, None)])
    m = {r.ID: r.state_merged for r in CL.merge_state(pl).collect()}
    assert m == {1: "failed", 2: "paused", 3: None, 4: "other", 5: "successful"}


def test_frequency_null_group_counts_zero(spark):
    df = spark.createDataFrame([(None,), (None,), (None,), ("a",)], "category string")
    got = {r.category: r.project_count for r in X.value_frequency(df, "category").collect()}
    assert got == {None: 0, "a": 1}
    assert X.distinct_count(df, "category").collect()[0][0] == 1


def _en(spark, rows):
    """rows: (ID, country, main_category, state_merged, launched_date)"""
    df = spark.createDataFrame(rows, "ID long, country string, main_category string, state_merged string, "
                                     "launched_date date")
    return (df.withColumn("country_code", F.col("country")).withColumn("launch_year", F.year("launched_date"))
              .withColumn("deadline", F.date_add("launched_date", 30))
              .withColumn("usd_goal_real", F.lit(10.0))
              .withColumn("usd_pledged_real", F.lit(5.0)))


def test_dense_rank_ties_kept(spark):
    counts = [9, 9, 7, 5, 4, 3, 2]
    rows, i = [], 0
    for c, n in enumerate(counts):
        for _ in range(n):
            rows.append((i, "X", f"cat{c}", "successful", dt.date(2015, 1, 1)))
            i += 1
    out = A.top_categories_per_country(_en(spark, rows), k=5).collect()
    assert [r.top_no for r in out] == [1, 1, 2, 3, 4, 5]


def test_one_sided_cell_and_thirds(spark):
    d = dt.date(2015, 3, 1)
    rows = [(i, "X", "A", "successful", d) for i in range(4)]                       # 4 successful, 0 failed
    rows += [(10, "X", "B", "failed", d), (11, "X", "B", "successful", d), (12, "X", "B", "successful", d)]
    rows += [(20, "X", "C", "paused", d)]                                            # only an unlisted state
    rows += [(30, "X", "D", "failed", None)]                                         # NULL year
    en = _en(spark, rows)
    rates = {(r.main_category, r.state_merged): r for r in V.success_rate(en).collect()}
    assert rates[("A", "successful")].percentage == 100.0 and ("A", "failed") not in rates
    assert rates[("B", "failed")].percentage == 33.33 and rates[("B", "successful")].percentage == 66.67
    assert rates[("B", "failed")].total_no == 3
    full = {(r.main_category, r.state): r for r in V.success_rate_full(en).collect()}
    assert len(full) == 8
    fa = full[("A", "failed")]
    assert (fa.total_no, fa.percentage, fa.test) == (0, 0.0, None)
    assert full[("A", "successful")].test == 2015
    assert all(full[("C", s)].total_no == 0 for s in ("successful", "failed"))
    assert all(full[("D", s)].test is None and full[("D", s)].total_no == 0 for s in ("successful", "failed"))
    by_join = {(r.main_category, r.state): (r.total_no, r.percentage, r.test)
               for r in V.success_rate_full(en, by_join=True).collect()}
    assert by_join == {k: (r.total_no, r.percentage, r.test) for k, r in full.items()}
    by_window = {(r.main_category, r.state_merged, r.total_no, r.percentage)
                 for r in V.success_rate(en, by_window=True).collect()}
    assert by_window == {(r.main_category, r.state_merged, r.total_no, r.percentage) for r in rates.values()}


def test_growth_rate_cases(spark):
    rows = [(i, "X", "G", "failed", dt.date(2010, 1, 1)) for i in range(2)]
    rows += [(10 + i, "X", "G", "successful", dt.date(2012, 1, 1)) for i in range(5)]
    rows += [(20, "X", "H", "failed", dt.date(2010, 1, 1))]
    rows += [(30, "X", "G", "failed", dt.date(1970, 1, 1))]
    en = _en(spark, rows)
    assert A.growth_rate(en, "G", "2010", "2012").collect()[0][0] == Decimal("1.50")
    assert A.growth_rate(en, "H", 2010, 2012).collect()[0][0] is None     # end year absent
    assert A.growth_rate(en, "G", 1970, 2012).collect()[0][0] is None     # placeholder year
    assert A.growth_rate(en, "nope", 2010, 2012).collect()[0][0] is None
    assert A.growth_rate(en, "g", 2010, 2012).collect()[0][0] is None                    # binary by default
    assert A.growth_rate(en, "g", 2010, 2012, case_insensitive=True).collect()[0][0] == Decimal("1.50")
    g = {r.main_category: r.growth_rate for r in A.growth_rates(en, 2010, 2012).collect()}
    assert g == {"G": Decimal("1.50"), "H": None}
    en.createOrReplaceTempView("t_growth_en")
    A.register_growth_rate_function(spark, "t_growth_en", "t_growth_rate")
    assert spark.sql("SELECT t_growth_rate('G', '2010', '2012') AS g").collect()[0].g == Decimal("1.50")
    assert spark.sql("SELECT t_growth_rate('H', '2010', '2012') AS g").collect()[0].g is None


def test_keys_and_cascade(spark):
    pi = spark.createDataFrame([(1,), (2,), (2,), (None,)], "ID long")
    bad = {r.ID: r.row_count for r in I.check_primary_key(pi, "ID").collect()}
    assert bad == {2: 2, None: 1}
    pl = spark.createDataFrame([(1, "a"), (99, "b"), (None, "c")], "ID long, state string")
    orphans = [r.ID for r in I.check_foreign_key(pl, pi, "ID").collect()]
    assert orphans == [99]
    removed = spark.createDataFrame([(1,)], "ID long")
    left = sorted((r.ID is None, r.ID) for r in I.cascade_delete(pl, removed, "ID").collect())
    assert left == [(False, 99), (True, None)]
    counts = {r.table_name: r.row_count for r in I.row_counts({"a": pi, "b": pl}).collect()}
    assert counts == {"a": 4, "b": 3}


def test_means_are_exact_half_up(spark):
    # 1.005 is a tie at 2 decimals: binary doubles would round it either way
    pl = _pl(spark, [(1, "failed", "X", 1.00, 1.00), (2, "failed", "X", 1.01, 1.01)])
    r = A.goal_vs_pledged_summary(CL.merge_state(pl)).collect()[0]
    assert r.avg_goal_usd == 1.01
    g = X.goal_range(pl).collect()[0]
    assert (g.min_goal_usd, g.avg_goal_usd, g.max_goal_usd) == (1.0, 1.005, 1.01)


def test_country_dim_from_csv(spark, scratch):
    p = os.path.join(scratch, "country.csv")
    _write(p, ["countrycode,countryname,code", 'GBR,United Kingdom,GB', '"BES","Bonaire, Sint Eustatius and Saba","BQ"'])
    rows = {r.countrycode: r for r in country_dim(spark, p).collect()}
    assert rows["BES"].countryname == "Bonaire, Sint Eustatius and Saba" and rows["GBR"].code == "GB"
    assert [f.name for f in country_dim(spark, p).schema] == [f.name for f in schemas.COUNTRY]


def test_repair_with_several_pledges_keeps_one_row_per_project(spark):
    t = dt.datetime(2015, 1, 1)
    d = dt.date(2015, 1, 1)
    pi = _pi(spark, [(1, "A", "a", t, d, '"N', d), (2, "A", "a", t, d, "DE", d)])
    pl = _pl(spark, [(1, "failed", "USD", 1.0, 1.0), (1, "failed", "GBP", 1.0, 1.0), (2, "failed", "EUR", 1.0, 1.0),
                     (2, "successful", "EUR", 1.0, 1.0)])
    fixed = CL.repair_country(pi, pl).collect()
    assert sorted((r.ID, r.country) for r in fixed) == [(1, "GB"), (2, "DE")]   # smallest currency wins
    assert I.check_primary_key(pl, "ID").count() == 2                              # the check flags both IDs


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    from fundscope.functions import columns as C
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")   # clocks jumped 00:00 -> 01:00 that day
    try:
        df = spark.createDataFrame([("04/11/2018 00:30", "04/11/2018")], "l string, d string")
        r = df.select(C.parse_day_first_timestamp("l").alias("ts"), C.parse_day_first_date("d").alias("dd")).collect()[0]
        assert r.ts == dt.datetime(2018, 11, 4, 0, 30) and r.dd == dt.date(2018, 11, 4)
        back = df.select(C.format_day_first(C.parse_day_first_timestamp("l")).alias("t")).collect()[0].t
        assert back == "04/11/2018 00:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dates_need_their_separators(spark):
    texts = ["01:02:2015 19:05", "01/02/2015/19/05", "01 02 2015 19 05", "01/02/15 19:05", "01-02-2015 19:05", "", " 1/2/2015  9:05 "]
    df = spark.createDataFrame([(t, t[:10]) for t in texts], "launched string, deadline string")
    assert [r.launched is not None for r in CL.parse_dates(df).collect()] == [False] * 6 + [True]
    assert CL.unparseable_dates(df).first().bad_launched == 6


def test_a_project_has_one_country_in_the_base_too(spark):
    t = dt.datetime(2015, 1, 1)
    d = dt.date(2015, 1, 1)
    pi = _pi(spark, [(1, "A", "a", t, d, '"N', d), (2, "A", "a", t, d, "DE", d), (3, "A", "a", t, d, '"N', d)])
    pl = _pl(spark, [(1, "failed", "USD", 1.0, 1.0), (1, "failed", "GBP", 1.0, 1.0), (2, "failed", "EUR", 1.0, 1.0), (3, "failed", None, 1.0, 1.0)])
    co = spark.createDataFrame([], "countrycode string, countryname string, code string")
    assert sorted((r.ID, r.country_code) for r in CL.enrich(pi, pl, co).collect()) == [(1, "GB"), (1, "GB"), (2, "DE"), (3, "Unknown")]
    counts = {(r.country, r.currency): r.project_count for r in X.country_currency_counts(pi, pl, repair=True).collect()}
    assert counts == {(r.country, r.currency): r.project_count
                      for r in X.country_currency_counts(CL.repair_country(pi, pl), pl).collect()}


def test_totals_are_of_the_shown_name(spark):
    d = dt.date(2015, 3, 1)
    en = _en(spark, [(1, "Same", "A", "successful", d), (2, "Same", "A", "failed", d), (3, "Same", "A", "successful", d), (4, "Same", "A", "successful", d)])
    en = en.withColumn("country_code", F.when(F.col("ID") <= 2, "X").otherwise("Y"))
    for by_window in (False, True):
        got = sorted((r.state_merged, r.no_of_projects, r.total_no, r.percentage) for r in V.success_rate(en, by_window=by_window).collect())
        assert got == [("failed", 1, 4, 25.0), ("successful", 1, 4, 25.0), ("successful", 2, 4, 50.0)]
    full = [sorted((r.state, r.total_no, r.percentage) for r in V.success_rate_full(en, by_join=j).collect()) for j in (False, True)]
    assert full[0] == full[1] and len(full[0]) == 6


def test_means_keep_parts_of_cents(spark):
    pl = _pl(spark, [(i, "failed", "X", 0.004, 0.004) for i in range(3)])
    assert X.goal_range(pl).first().avg_goal_usd == 0.004
    exact = pl.withColumn("usd_goal_real", F.col("usd_goal_real").cast("decimal(18,4)"))
    assert X.goal_range(exact).first().avg_goal_usd == 0.004
