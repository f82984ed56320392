"""The three dashboard views: success rates, densified success rates, goal vs pledge.

``success_rate`` and ``success_rate_full`` are built from one conditional aggregation per country
code, year and main category (the successful and failed counts side by side). A second aggregation
puts the codes shown under one country name together: rates are of the total of the shown cell, and
its list of codes is at most as long as the codes that share a name. No window, no cross join and no
outer join is needed; ``by_window=True`` and ``by_join=True`` build the same rows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

_CELL = ["country", "year", "main_category"]


def _cells(enriched: DataFrame) -> DataFrame:
    """Per shown cell (country name, launch year, main category) among rows whose merged state is not
    'other': the total, and for each repaired code its successful and failed counts."""
    sm = F.col("state_merged")
    return (enriched.where(sm != F.lit(C.OTHER))
            .groupBy("country_code", "country", F.col("launch_year").alias("year"), "main_category")
            .agg(F.count(F.when(sm == F.lit(C.SUCCESS), 1)).alias("succ"),
                 F.count(F.when(sm == F.lit(C.FAILED), 1)).alias("fail"))
            .groupBy(*_CELL)
            .agg(F.sum(F.col("succ") + F.col("fail")).alias("total_no"),
                 F.collect_list(F.struct("succ", "fail")).alias("codes")))


def _cells_of_counts(cells: DataFrame) -> DataFrame:
    """The same from stored counts per cell and merged state (``streaming.cells``)."""
    sm, n = F.col("state_merged"), F.col("n")
    return (cells.groupBy("country_code", "country", F.col("launch_year").alias("year"), "main_category")
            .agg(F.sum(F.when(sm == F.lit(C.SUCCESS), n).otherwise(0)).alias("succ"),
                 F.sum(F.when(sm == F.lit(C.FAILED), n).otherwise(0)).alias("fail"))
            .groupBy(*_CELL)
            .agg(F.sum(F.col("succ") + F.col("fail")).alias("total_no"),
                 F.collect_list(F.struct("succ", "fail")).alias("codes")))


def success_rate_of_cells(cells: DataFrame) -> DataFrame:
    """``success_rate`` from maintained cell counts."""
    return _rates(_cells_of_counts(cells))


def success_rate_full_of_cells(cells: DataFrame) -> DataFrame:
    """``success_rate_full`` from maintained cell counts."""
    return _full(_cells_of_counts(cells))


def _count(code: F.Column, state: F.Column) -> F.Column:
    return F.when(state == F.lit(C.SUCCESS), code["succ"]).otherwise(code["fail"])


def _states() -> F.Column:
    return F.explode(F.array(F.lit(C.SUCCESS), F.lit(C.FAILED)))


def success_rate(enriched: DataFrame, by_window: bool = False, ordered: bool = True) -> DataFrame:
    """Per country, launch year, main category and state (successful / failed):
    ``no_of_projects``, cell ``total_no`` and ``percentage`` (exact, 2 decimals)."""
    if by_window:
        out = _success_rate_window(enriched)
    else:
        out = _rates(_cells(enriched))
    return out.orderBy(*_CELL, "state_merged") if ordered else out


def _rates(cells: DataFrame) -> DataFrame:
    one = cells.select(*_CELL, "total_no", F.explode("codes").alias("code"))
    return (one.select(*_CELL, "total_no", "code", _states().alias("state_merged"))
            .withColumn("no_of_projects", _count(F.col("code"), F.col("state_merged")))
            .where(F.col("no_of_projects") > 0)
            .withColumn("percentage", C.half_up_div(F.col("no_of_projects") * 100, F.col("total_no"), 2))
            .select(*_CELL, "state_merged", "no_of_projects", "total_no", "percentage"))


def _success_rate_window(enriched: DataFrame) -> DataFrame:
    sm = F.col("state_merged")
    counts = (enriched.where(sm.isin(C.SUCCESS, C.FAILED))
              .groupBy("country_code", "country", F.col("launch_year").alias("year"), "main_category",
                       "state_merged")
              .agg(F.count(F.lit(1)).alias("no_of_projects")))
    total = F.sum("no_of_projects").over(Window.partitionBy(*_CELL))
    return (counts.withColumn("total_no", total)
            .withColumn("percentage", C.half_up_div(F.col("no_of_projects") * 100, F.col("total_no"), 2))
            .select(*_CELL, "state_merged", "no_of_projects", "total_no", "percentage"))


def success_rate_full(enriched: DataFrame, ordered: bool = False, by_join: bool = False) -> DataFrame:
    """``success_rate`` densified: every cell has a successful and a failed row.

    A missing state gets ``total_no`` 0 and ``percentage`` 0; ``test`` (the
    matched row's year) is NULL exactly on the filled rows. Cells with a NULL key
    can never match a measure row (plain equality), so they are all filled.
    Cells whose rows have only unlisted states are present and filled too.
    The scaffold has a row per code and state and is matched to the measures by the
    shown name: under a name shared by several codes, each of its rows shows all
    measures of the name.
    ``by_join=True`` builds it as a scaffold (distinct cells x the two states)
    right-outer-joined to the measures (same result, one more join).
    """
    if by_join:
        out = _success_rate_full_join(enriched)
        return out.orderBy(*_CELL, "state") if ordered else out
    out = _full(_cells(enriched))
    return out.orderBy(*_CELL, "state") if ordered else out


def _full(cells: DataFrame) -> DataFrame:
    scaffold = (cells.select(*_CELL, "total_no", "codes", F.explode("codes"))
                .select(*_CELL, "total_no", "codes", _states().alias("state")))
    keyed = F.col("country").isNotNull() & F.col("year").isNotNull() & F.col("main_category").isNotNull()
    counts = F.filter(F.transform("codes", lambda c: _count(c, F.col("state"))), lambda n: (n > 0) & keyed)
    rows = scaffold.select(*_CELL, "state", "total_no", F.explode_outer(counts).alias("n"))
    matched = F.col("n").isNotNull()
    return rows.select(
        *_CELL, "state",
        F.when(matched, F.col("total_no")).otherwise(F.lit(0).cast("long")).alias("total_no"),
        F.when(matched, C.half_up_div(F.col("n") * 100, F.col("total_no"), 2)).otherwise(F.lit(0.0)).alias("percentage"),
        F.when(matched, F.col("year")).alias("test"),
    )


def _success_rate_full_join(enriched: DataFrame) -> DataFrame:
    measures = success_rate(enriched, ordered=False).alias("m")
    states = F.array(F.lit(C.SUCCESS), F.lit(C.FAILED))
    scaffold = (enriched.where(F.col("state_merged") != F.lit(C.OTHER))
                .select("country_code", "country", F.col("launch_year").alias("year"), "main_category")
                .distinct()
                .select("country", "year", "main_category", F.explode(states).alias("state"))
                .alias("s"))
    on = [F.col(f"m.{k}") == F.col(f"s.{k}") for k in _CELL] + [F.col("m.state_merged") == F.col("s.state")]
    j = measures.join(scaffold, on, "right")
    return j.select(*[F.col(f"s.{k}").alias(k) for k in _CELL], F.col("s.state").alias("state"),
                    F.coalesce(F.col("m.total_no"), F.lit(0).cast("long")).alias("total_no"),
                    F.coalesce(F.col("m.percentage"), F.lit(0.0)).alias("percentage"),
                    F.col("m.year").alias("test"))


def goal_vs_pledge(enriched: DataFrame, ordered: bool = False) -> DataFrame:
    """Per-project extract: goal and pledged money with country, category, state and launch date."""
    out = (enriched.where(F.col("state_merged") != F.lit(C.OTHER))
           .select("ID", "country", "main_category", "state_merged", "launched_date",
                   "usd_goal_real", "usd_pledged_real"))
    return out.orderBy("country", "main_category", "state_merged", "launched_date") if ordered else out


def register_views(spark: SparkSession, enriched: DataFrame, prefix: str = "") -> dict[str, str]:
    """Register the three views (and the base) as temp views; returns name -> view name."""
    names = {
        "enriched": f"{prefix}enriched",
        "v_success_rate": f"{prefix}v_success_rate",
        "success_rate_full": f"{prefix}success_rate_full",
        "goal_vs_pledge": f"{prefix}goal_vs_pledge",
    }
    enriched.createOrReplaceTempView(names["enriched"])
    success_rate(enriched, ordered=False).createOrReplaceTempView(names["v_success_rate"])
    success_rate_full(enriched).createOrReplaceTempView(names["success_rate_full"])
    goal_vs_pledge(enriched).createOrReplaceTempView(names["goal_vs_pledge"])
    return names


def _percentage_sql(n: str, d: str) -> str:
    """``round(100 * n / d, 2)`` of counts, ties away from zero, in whole numbers (see ``functions.columns``)."""
    return f"CAST((20000 * {n} + {d}) DIV (2 * {d}) AS DOUBLE) / 100.0D"


def create_views(spark: SparkSession, enriched_table: str, database: str) -> dict[str, str]:
    """The three views as persistent ones of ``database`` (``CREATE OR REPLACE VIEW``) over the catalog table
    ``enriched_table``. They hold text, not plans: any session of the catalog reads them, with pruned scans.
    Returns name -> qualified name."""
    cell = "country, launch_year AS year, main_category"
    one = f"SELECT country_code, {cell}, {{}} FROM {enriched_table} WHERE state_merged <> '{C.OTHER}' GROUP BY country_code, country, launch_year, main_category"
    states = f"count_if(state_merged = '{C.SUCCESS}') AS succ, count_if(state_merged = '{C.FAILED}') AS fail"
    total = f"SELECT *, sum(succ + fail) OVER (PARTITION BY country, year, main_category) AS total_no FROM ({one.format(states)})"
    rates = (f"SELECT country, year, main_category, state_merged, no_of_projects, total_no, {_percentage_sql('no_of_projects', 'total_no')} AS percentage "
             f"FROM ({total}) LATERAL VIEW stack(2, '{C.SUCCESS}', succ, '{C.FAILED}', fail) s AS state_merged, no_of_projects WHERE no_of_projects > 0")
    names = {n: f"`{database}`.`{n}`" for n in ("v_success_rate", "success_rate_full", "goal_vs_pledge")}
    scaffold = f"SELECT country, year, main_category, state FROM ({one.format('1 AS one')}) LATERAL VIEW explode(array('{C.SUCCESS}', '{C.FAILED}')) e AS state"
    full = ("SELECT s.country, s.year, s.main_category, s.state, coalesce(m.total_no, 0L) AS total_no, coalesce(m.percentage, 0.0D) AS percentage, m.year AS test "
            f"FROM ({scaffold}) s LEFT JOIN {names['v_success_rate']} m ON m.country = s.country AND m.year = s.year AND m.main_category = s.main_category "
            "AND m.state_merged = s.state")
    pledged = f"SELECT ID, country, main_category, state_merged, launched_date, usd_goal_real, usd_pledged_real FROM {enriched_table} WHERE state_merged <> '{C.OTHER}'"
    for name, text in zip(names, (rates, full, pledged)):
        spark.sql(f"CREATE OR REPLACE VIEW {names[name]} AS {text}")
    return names
