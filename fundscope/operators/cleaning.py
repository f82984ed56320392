"""Cleaning: date parsing, the country repair, state merge, and the enriched base.

Every function returns a new DataFrame; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..plans.joins import lookup_join
from ..schemas import IGNORE_CASE, ignoring_case


def parse_dates(project_info: DataFrame, launched: str = "launched", deadline: str = "deadline") -> DataFrame:
    """Day-first text dates -> ``launched`` TIMESTAMP_NTZ and ``deadline`` DATE (NULL when unparseable)."""
    return (project_info
            .withColumn(launched, C.parse_day_first_timestamp(launched))
            .withColumn(deadline, C.parse_day_first_date(deadline)))


def unparseable_dates(raw_project_info: DataFrame, launched: str = "launched", deadline: str = "deadline") -> DataFrame:
    """One row: how many non-empty launched / deadline texts do not parse."""
    lt, dl = F.col(launched), F.col(deadline)
    return raw_project_info.agg(
        F.count(F.when(lt.isNotNull() & C.parse_day_first_timestamp(lt).isNull(), 1)).alias("bad_launched"),
        F.count(F.when(dl.isNotNull() & C.parse_day_first_date(dl).isNull(), 1)).alias("bad_deadline"),
    )


def derive_launched_date(project_info: DataFrame, launched: str = "launched") -> DataFrame:
    """``launched_date`` = the date part of ``launched`` (a full date, used later with DATEDIFF)."""
    return project_info.withColumn("launched_date", F.col(launched).cast("date"))


def load_project_info(raw_project_info: DataFrame) -> DataFrame:
    """Set-up state of project_info: dates parsed and ``launched_date`` added."""
    return derive_launched_date(parse_dates(raw_project_info))


def null_sentinel(project_info: DataFrame, column: str = "country", sentinel: str = C.COUNTRY_SENTINEL) -> DataFrame:
    """The corrupt value becomes NULL."""
    return project_info.withColumn(column, C.country_or_null(column, sentinel))


def country_repair_preview(project_info: DataFrame, pledge: DataFrame,
                           sentinel: str = C.COUNTRY_SENTINEL) -> DataFrame:
    """Rows whose country is missing, with the code guessed from the currency (EUR gives ``EU`` here)."""
    pi = project_info.select("ID", C.country_or_null("country", sentinel).alias("country"))
    missing = pi.where(F.col("country").isNull())
    j = missing.join(pledge.select("ID", "currency"), "ID")
    return j.select("country", "currency",
                    F.coalesce(F.col("country"), F.substring("currency", 1, 2)).alias("country_new"))


def repair_country(project_info: DataFrame, pledge: DataFrame, sentinel: str = C.COUNTRY_SENTINEL) -> DataFrame:
    """project_info with the missing country filled in from the pledge currency.

    Only rows whose country is missing take part in the joins; the others pass
    through without a shuffle. The missing rows are joined to their pledges
    first and aggregated after, so the pledge table is never aggregated as a
    whole. A project with several pledge rows takes the smallest currency (one
    row per project is kept). A project without a pledge row keeps a NULL country.
    """
    pi = null_sentinel(project_info, "country", sentinel)
    cols = pi.columns
    present = pi.where(F.col("country").isNotNull())
    missing = pi.where(F.col("country").isNull())
    pledged = (missing.select("ID").join(pledge.select("ID", "currency"), "ID")
               .groupBy("ID").agg(F.min("currency").alias("__currency"), F.count(F.lit(1)).alias("__n")))
    fixed = (missing.join(pledged, "ID", "left")
                    .withColumn("country", F.when(F.col("__n").isNotNull(),
                                                  C.country_from_currency("__currency")))
                    .select(*cols))
    return present.unionByName(fixed)


def repair_currencies(project_info: DataFrame, pledge: DataFrame, sentinel: str = C.COUNTRY_SENTINEL) -> DataFrame:
    """``ID`` and ``__currency``: the smallest currency of each pledged project without a country."""
    missing = project_info.where(C.country_or_null("country", sentinel).isNull()).select("ID")
    return pledge.select("ID", "currency").join(missing, "ID", "left_semi").groupBy("ID").agg(F.min("currency").alias("__currency"))


def ignore_case(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``columns`` (default: all texts) compared without case from here on (see ``schemas.ignoring_case``)."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in ignoring_case(df.schema, columns).fields])


def fold_case(df: DataFrame) -> DataFrame:
    """Texts compared without case become plain lower-case texts. A group of spellings shows one of them, which
    one depends on the order of the rows; folded, the result is the same on every run."""
    return df.select(*[F.lower(f.name).cast("string").alias(f.name)
                       if isinstance(f.dataType, T.StringType) and f.dataType.collation == IGNORE_CASE else F.col(f.name)
                       for f in df.schema.fields])


def merge_state(pledge: DataFrame) -> DataFrame:
    """Adds ``state_merged``: failed / other / successful (unlisted states kept as they are)."""
    return pledge.withColumn("state_merged", C.merged_state("state"))


def enrich(project_info: DataFrame, pledge: DataFrame, country: DataFrame,
           sentinel: str = C.COUNTRY_SENTINEL) -> DataFrame:
    """The shared analysis base: one row per matching project and pledge.

    ``project_info`` is the loaded table (dates parsed, ``launched_date`` present),
    ``pledge`` the raw pledge table. The country repair is applied inside the one
    project-pledge join: like ``repair_country``, a project has one country, from the smallest
    currency of its pledges. That is aggregated for projects without a country only, so an ID that is
    repeated on many pledges is never gathered.
    ``country_code`` is the repaired code and ``country`` the display name (lookup name, else the
    code).
    """
    pi = project_info.select("ID", "main_category", "category", "launched", "launched_date",
                             "deadline", F.col("country").alias("__raw_country"))
    pl = pledge.select("ID", "state", "currency", "usd_goal_real", "usd_pledged_real")
    j = (pi.join(pl, "ID").join(repair_currencies(project_info, pl, sentinel), "ID", "left")
         .withColumn("country_code", C.repaired_country("__raw_country", "__currency", sentinel)).drop("__currency"))
    lk = country.select(F.col("code").alias("__code"), F.col("countryname").alias("__name"))
    j = lookup_join(j, lk, "country_code", "__code", "left")
    return j.select(
        "ID", "main_category", "category", "launched", "launched_date",
        F.year("launched_date").alias("launch_year"), "deadline",
        "country_code", F.coalesce(F.col("__name"), F.col("country_code")).alias("country"),
        "currency", "state", C.merged_state("state").alias("state_merged"),
        "usd_goal_real", "usd_pledged_real",
    )
