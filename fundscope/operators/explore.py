"""Profiling: frequencies, distinct counts, ranges, and the small data checks.

All aggregates are two-phase (partial aggregation before the shuffle), so a value
that holds a third of all rows costs one row per map task, not one task's worth
of rows. Final sorts run on aggregated results only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import global_row_number
from .cleaning import repair_currencies


def preview(df: DataFrame, n: int | None = None) -> DataFrame:
    """``SELECT *``; with ``n`` only the first n rows (for display)."""
    return df if n is None else df.limit(n)


def value_frequency(df: DataFrame, column: str, alias: str = "project_count", desc: bool = False,
                    ordered: bool = True) -> DataFrame:
    """Each value of ``column`` with ``COUNT(column)`` (the NULL group counts 0), sorted by the count."""
    out = df.groupBy(column).agg(F.count(F.col(column)).alias(alias))
    return out.orderBy(F.col(alias).desc() if desc else F.col(alias).asc()) if ordered else out


def distinct_count(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """``COUNT(DISTINCT column)`` (NULL not counted), exact."""
    return df.agg(F.count_distinct(F.col(column)).alias(alias or f"{column}_count"))


def date_range(project_info: DataFrame, column: str = "launched") -> DataFrame:
    """First and last launch."""
    return project_info.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"))


def launch_years(project_info: DataFrame, column: str = "launched", ordered: bool = True) -> DataFrame:
    """Distinct launch years, ascending."""
    out = project_info.select(F.year(F.col(column).cast("date")).alias("year")).distinct()
    return out.orderBy("year") if ordered else out


def suspicious_rows(project_info: DataFrame, year: int = C.PLACEHOLDER_YEAR,
                    column: str = "launched_date") -> DataFrame:
    """All rows whose launch year is the placeholder year (a date range, so the scan can skip files)."""
    first, last = (F.lit(dt.date(year, m, d)) for m, d in ((1, 1), (12, 31)))
    return project_info.where(F.col(column).between(first, last))


def live_by_year(project_info: DataFrame, pledge: DataFrame, state: str = "live") -> DataFrame:
    """Projects in ``state``: counts by launch year and deadline year."""
    pl = pledge.where(F.col("state") == F.lit(state)).select("ID")
    pi = project_info.select("ID", "launched_date", "deadline")
    j = pi.join(pl, "ID")
    return (j.groupBy(F.year("launched_date").alias("year_launched"),
                      F.year("deadline").alias("year_deadline"))
             .agg(F.count(F.lit(1)).alias("project_count")))


def currency_list(pledge: DataFrame) -> DataFrame:
    """Distinct currencies numbered in ascending order (``currency_count``)."""
    cur = pledge.select("currency").distinct()
    return global_row_number(cur, ["currency"], name="currency_count").orderBy("currency")


def countries_per_currency(project_info: DataFrame, pledge: DataFrame, ordered: bool = True) -> DataFrame:
    """How many distinct countries use each currency (which currencies identify one country)."""
    j = pledge.select("ID", "currency").join(project_info.select("ID", "country"), "ID")
    out = j.groupBy("currency").agg(F.count_distinct("country").alias("countries_per_currency"))
    return out.orderBy("currency") if ordered else out


def goal_range(pledge: DataFrame, column: str = "usd_goal_real") -> DataFrame:
    """Min, mean and max goal. The mean is exact to 6 decimals (decimal average)."""
    return pledge.agg(
        F.min(column).cast("double").alias("min_goal_usd"),
        C.money_avg_half_up(column, 6).alias("avg_goal_usd"),
        F.max(column).cast("double").alias("max_goal_usd"),
    )


def country_currency_counts(project_info: DataFrame, pledge: DataFrame, repair: bool = False) -> DataFrame:
    """Cross-tabulation of country and currency (run after the repair, or with ``repair=True`` on
    the unrepaired table: the repair is then part of the one join)."""
    j = project_info.select("ID", "country").join(pledge.select("ID", "currency"), "ID")
    if repair:
        j = j.join(repair_currencies(project_info, pledge), "ID", "left").withColumn(
            "country", C.repaired_country("country", "__currency"))
    return j.groupBy("country", "currency").agg(F.count(F.lit(1)).alias("project_count"))
