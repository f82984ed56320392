"""Analyses over the enriched base: rankings, lengths, goal vs pledged, growth, leaderboards.

Grouping follows the original workload: groups are formed on the repaired
country *code* (``country_code``) and shown with the display name (``country``);
the name is a function of the code, so adding it to the key changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def top_categories_per_country(enriched: DataFrame, k: int = 5, state: str = C.SUCCESS,
                               ordered: bool = True) -> DataFrame:
    """Main categories ranked by number of projects in ``state`` within each country;
    the k best ranks are kept, ties included (dense rank)."""
    counts = (enriched.where(F.col("state_merged") == F.lit(state))
              .groupBy("country_code", "country", "main_category", "state_merged")
              .agg(F.count(F.col("ID")).alias("no_of_projects")))
    rank = F.dense_rank().over(Window.partitionBy("country").orderBy(F.col("no_of_projects").desc()))
    # ``<= k`` (not IN (1..k)) lets Spark put a WindowGroupLimit under the window
    out = (counts.withColumn("top_no", rank).where(F.col("top_no") <= k)
           .select("country", "main_category", "no_of_projects", "state_merged", "top_no"))
    return out.orderBy("country", "top_no") if ordered else out


def avg_project_length(enriched: DataFrame, skip_year: int = C.PLACEHOLDER_YEAR, ordered: bool = True) -> DataFrame:
    """Mean days from launch to deadline per country and merged state (4 decimals, exact),
    without placeholder-year rows and without state 'other'."""
    days = F.datediff(F.col("deadline"), F.col("launched_date"))
    f = enriched.where((F.col("launch_year") != F.lit(skip_year))
                       & (F.col("state_merged") != F.lit(C.OTHER)))
    out = (f.groupBy("country_code", "country", "state_merged")
           .agg(C.half_up_div(F.sum(days), F.count(days), 4).alias("avg_project_length"))
           .select("country", "avg_project_length", "state_merged"))
    return out.orderBy("country", "state_merged") if ordered else out


def goal_vs_pledged_summary(df: DataFrame, by: str | None = None, ordered: bool = True) -> DataFrame:
    """Mean goal and mean pledged money (2 decimals, exact) per merged state.

    ``by=None``: over the pledge table (with ``state_merged``) alone.
    ``by="country"``: over the enriched base, per country and state, highest mean goal first.
    """
    f = df.where(F.col("state_merged") != F.lit(C.OTHER))
    aggs = [C.money_avg_half_up("usd_goal_real", 2).alias("avg_goal_usd"),
            C.money_avg_half_up("usd_pledged_real", 2).alias("avg_pledged_usd")]
    if by is None:
        return f.groupBy("state_merged").agg(*aggs)
    if by != "country":
        raise ValueError("by must be None or 'country'")
    out = (f.groupBy("country_code", "country", "state_merged").agg(*aggs)
           .select("country", "state_merged", "avg_goal_usd", "avg_pledged_usd"))
    return out.orderBy(F.col("avg_goal_usd").desc()) if ordered else out


def _growth(start_no, end_no) -> F.Column:
    """(end - start) / start as DECIMAL(10,2): division result kept to 4 decimals,
    then stored with 2 (both steps half-up). NULL when a year has no projects."""
    r4 = C.half_up_scaled(end_no - start_no, start_no, 4)
    r2 = C.half_up_scaled(r4, F.lit(100), 0)
    ok = (start_no > 0) & (end_no > 0)
    return F.when(ok, (r2.cast("decimal(20,0)") / F.lit(100)).cast("decimal(10,2)"))


def growth_rates(enriched: DataFrame, start_year: int | str, end_year: int | str,
                 skip_year: int = C.PLACEHOLDER_YEAR) -> DataFrame:
    """Growth in number of projects (all states) from ``start_year`` to ``end_year``, per main category.

    One pass: only the two years are read, both counts come from one conditional
    aggregation. Categories with projects in neither year are absent.
    """
    s, e = int(start_year), int(end_year)
    y = F.col("launch_year")
    f = enriched.where(y.isin(s, e) & (y != F.lit(skip_year)))
    g = f.groupBy("main_category").agg(F.count(F.when(y == s, 1)).alias("start_no"),
                                       F.count(F.when(y == e, 1)).alias("end_no"))
    return g.select("main_category", "start_no", "end_no",
                    _growth(F.col("start_no"), F.col("end_no")).alias("growth_rate"))


def growth_rate(enriched: DataFrame, category: str, start_year: int | str, end_year: int | str,
                skip_year: int = C.PLACEHOLDER_YEAR, case_insensitive: bool = False) -> DataFrame:
    """The scalar form: one row, ``growth_rate`` of one main category (NULL when a year is absent).
    ``case_insensitive`` compares the category under the UTF8_LCASE collation."""
    s, e = int(start_year), int(end_year)
    y = F.col("launch_year")
    f = enriched.where(C.text_equals("main_category", category, case_insensitive)
                       & y.isin(s, e) & (y != F.lit(skip_year)))
    g = f.agg(F.count(F.when(y == s, 1)).alias("start_no"), F.count(F.when(y == e, 1)).alias("end_no"))
    return g.select(_growth(F.col("start_no"), F.col("end_no")).alias("growth_rate"))


def register_growth_rate_function(spark: SparkSession, view: str, name: str = "growth_rate") -> None:
    """SQL form: ``growth_rate(category, start_year, end_year)`` over the enriched view ``view``.

    The two counts are scalar subqueries with the parameters only in their WHERE
    clauses, passed once each to a helper function (``<name>_of``) that does the
    arithmetic, so each count is evaluated once. Spark decorrelates each count into
    a join of the one calling row with a per-(category, year) aggregate of the
    filtered view: a nested-loop join whose sides are bounded by the number of
    launch years. Years may be given as strings ('2009'). The set form
    ``growth_rates`` is the scalable way to compare all categories.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(s BIGINT, e BIGINT)
        RETURNS DECIMAL(10,2)
        RETURN CASE WHEN s > 0 AND e > 0
                    THEN CAST(ROUND(ROUND(CAST(e - s AS DECIMAL(20,0)) / s, 4), 2) AS DECIMAL(10,2))
               END
    """)

    def count_sql(param: str) -> str:
        return (f"(SELECT count(1) FROM {view} v WHERE v.main_category = p_category "
                f"AND v.launch_year = CAST({param} AS INT) AND v.launch_year <> {C.PLACEHOLDER_YEAR})")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_category STRING, p_start_year STRING, p_end_year STRING)
        RETURNS DECIMAL(10,2)
        RETURN {name}_of({count_sql("p_start_year")}, {count_sql("p_end_year")})
    """)


def register_growth_rates_table_function(spark: SparkSession, view: str, name: str = "growth_rates") -> None:
    """Table function ``growth_rates(start_year, end_year)`` over the enriched view ``view``: the rows of
    ``growth_rates`` for two years, given as strings or numbers. A year without projects counts 0.

    ``<name>_counts(year)`` is the map from main category to count of one year (as many entries as
    categories), looked up by the year. Called with two literals, each year's partition is read and counted
    once, and one row meets one row. Called laterally for a list of year pairs, the list is hash-joined to the
    per-year maps, so the base is counted once for all pairs and no nested loop is planned. A NULL category is
    a category (the map's keys are structs, which may hold a NULL).
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(s BIGINT, e BIGINT)
        RETURNS DECIMAL(10,2)
        RETURN CASE WHEN s > 0 AND e > 0
                    THEN CAST(ROUND(ROUND(CAST(e - s AS DECIMAL(20,0)) / s, 4), 2) AS DECIMAL(10,2))
               END
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_counts(p_year INT)
        RETURNS MAP<STRUCT<main_category: STRING>, BIGINT>
        RETURN (SELECT map_from_entries(collect_list(struct(struct(c.main_category), c.n)))
                FROM (SELECT launch_year, main_category, count(1) AS n FROM {view}
                      WHERE launch_year <> {C.PLACEHOLDER_YEAR} GROUP BY launch_year, main_category) c
                WHERE c.launch_year = p_year)
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_start_year STRING, p_end_year STRING)
        RETURNS TABLE(main_category STRING, start_no BIGINT, end_no BIGINT, growth_rate DECIMAL(10,2))
        RETURN SELECT main_category, s, e, {name}_of(s, e) FROM (
            SELECT k.main_category, coalesce(try_element_at(sm, k), 0L) AS s, coalesce(try_element_at(em, k), 0L) AS e
            FROM (SELECT sm, em, explode(array_union(map_keys(sm), map_keys(em))) AS k
                  FROM (SELECT coalesce({name}_counts(CAST(p_start_year AS INT)), map()) AS sm,
                               coalesce({name}_counts(CAST(p_end_year AS INT)), map()) AS em)))
    """)


def avg_success_rate(full: DataFrame, state: str = C.SUCCESS) -> DataFrame:
    """Unweighted mean of the ``state`` percentage over all densified cells (6 decimals, exact)."""
    hundredths = F.round(F.col("percentage") * 100).cast("long")
    f = full.where(F.col("state") == F.lit(state))
    return f.agg(C.half_up_div(F.sum(hundredths), F.count(hundredths) * 100, 6).alias("avg_success_rate"))


def category_leaderboard(rates: DataFrame, country: str | None = None, year: int | None = None,
                         skip_years: Sequence[int] = (C.PLACEHOLDER_YEAR, 2018),
                         state: str = C.SUCCESS, case_insensitive: bool = False,
                         ordered: bool = True) -> DataFrame:
    """Per main category: mean success percentage over cells and the sum of cell totals.

    ``rates`` is ``success_rate``. Optional drill-down on one country and/or year;
    both filters are on window/partition keys, so they can be pushed below it.
    """
    f = rates.where(F.col("state_merged") == F.lit(state))
    for y in skip_years:
        f = f.where(F.col("year") != F.lit(y))
    if country is not None:
        f = f.where(C.text_equals("country", country, case_insensitive))
    if year is not None:
        f = f.where(F.col("year") == F.lit(int(year)))
    out = (f.groupBy("main_category", "state_merged")
           .agg(F.avg(F.col("percentage").cast("float")).alias("avg_success_rate"),
                F.sum(F.col("total_no").cast("float")).alias("project_count")))
    return out.orderBy(F.col("avg_success_rate").desc()) if ordered else out
