"""

Every query reads the driver's tables in ``sf_dir`` through the adapter in
``fundscope.sources.fixtures`` (project_info, pledge and country are derived
from orders, lineitem, customer, nation and region), loads and cleans them once
per session into the shared checkpoint folder, and runs one operator over the
whole tables. ``oracle_sql`` holds the DuckDB statement for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundscope import oracle
from fundscope.functions import columns as C
from fundscope.operators import analysis as A
from fundscope.operators import cleaning as CL
from fundscope.operators import distinct as D
from fundscope.operators import explore as X
from fundscope.operators import integrity as I
from fundscope.operators import views as V
from fundscope.plans.workload import Tables, driver_database, driver_files, driver_tables, stored
from fundscope.schemas import PLEDGE_RAW, ignoring_case
from fundscope.sources.delimited import read_pledge, read_project_info, unreadable_numbers, write_delimited
from fundscope.sources.country import save_country_dim
from fundscope.sources.extract import read_extract, write_extract
from fundscope.sources.fixtures import RAW_PROJECT_INFO_FILE, mixed_case
from fundscope.sources.loads import Loaded, load_checked, load_counts
from fundscope.sources.published import publish, read_published, row_changes
from fundscope.sources.statistics import file_bounds, footer_session, write_with_bounds
from fundscope.sources.stored import apply_changes
from fundscope.streaming.cells import add_batch, stored_cells
from fundscope.streaming.incremental import load_available

try:  # the training-data operators live in a subpackage that may be left out
    import corpus_pipeline
    from fundscope.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return driver_tables(spark, sf_dir, stored=True)


def _raw_project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_info as read from the file: text dates, corrupt country still present."""
    return _t(spark, sf_dir).raw_project_info


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top 5 main categories of successful projects per country, at sf0.001."""
    return A.top_categories_per_country(_t(spark, SMOKE_DIR).enriched, k=5)


def _success_rate(t: Tables) -> DataFrame:
    return V.success_rate(t.enriched, ordered=False)


def _views(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """Temp views over this data folder's stored base (names unique per store)."""
    t = _t(spark, sf_dir)
    prefix = f"fs_{t.root.rpartition('-')[2]}_"  # the store's own id
    return prefix, V.register_views(spark, t.enriched, prefix)


def _load_project_info_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_project_info(spark, driver_files(spark, sf_dir)["project_info"], schema=RAW_PROJECT_INFO_FILE)
    return CL.load_project_info(raw)


def _stream_load_project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental (streaming, available-now) load of the delimited files into the store's one stream
    table: a second call finds nothing new to load."""
    files = driver_files(spark, sf_dir)
    run = f"{_t(spark, sf_dir).root}/stream"
    return load_available(spark, files["project_info"], RAW_PROJECT_INFO_FILE, f"{run}/table",
                          f"{run}/checkpoint", transform=CL.load_project_info)


def _extract_success_rate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-32: the dashboard extract of the densified rates, written as CSV and read back."""
    t = _t(spark, sf_dir)
    df = V.success_rate_full(t.enriched)
    path = f"{t.root}/extracts/success_rate_full"
    write_extract(df, path, "csv")
    return read_extract(spark, path, df.schema)


def _category_leaderboard_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard over the registered view instead of the stored base."""
    _, v = _views(spark, sf_dir)
    return A.category_leaderboard(spark.table(v["v_success_rate"]))


def _growth_rate_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, v = _views(spark, sf_dir)
    A.register_growth_rate_function(spark, v["enriched"], name=f"{prefix}growth_rate")
    return spark.sql(f"SELECT {prefix}growth_rate('BUILDING/1', '1995', '2000') AS growth_rate")


def _growth_table_function(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Names of the registered table function and of the enriched view under it."""
    prefix, v = _views(spark, sf_dir)
    A.register_growth_rates_table_function(spark, v["enriched"], name=f"{prefix}growth_rates")
    return f"{prefix}growth_rates", v["enriched"]


def _growth_rates_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, _ = _growth_table_function(spark, sf_dir)
    return spark.sql(f"SELECT * FROM {name}('1995', '2000')")


def _growth_rates_year_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function called laterally: growth from each launch year to the next."""
    name, base = _growth_table_function(spark, sf_dir)
    return spark.sql(f"SELECT y.launch_year AS start_year, g.* FROM (SELECT DISTINCT launch_year FROM {base} WHERE launch_year IS NOT NULL) y, "
                     f"LATERAL {name}(CAST(y.launch_year AS STRING), CAST(y.launch_year + 1 AS STRING)) g")


def _ignoring_case(spark: SparkSession, sf_dir: str) -> Tables:
    """The workload over files with mixed-case texts, read with schemas that compare them without case."""
    t = _t(spark, sf_dir)
    root = f"{t.root}/mixed_case"
    write_delimited(mixed_case(t.raw_project_info, ["main_category", "category"]), f"{root}/project_info")
    write_delimited(mixed_case(t.pledge, ["state", "currency"]), f"{root}/pledge")
    dates = ("launched", "deadline")
    names = tuple(c for c in RAW_PROJECT_INFO_FILE.names if c not in dates)
    raw = read_project_info(spark, f"{root}/project_info", schema=ignoring_case(RAW_PROJECT_INFO_FILE, names))
    country = CL.ignore_case(t.country)
    # lines and dates are read once: a filter over the lazy load would read each line again for each use of a date
    pi = stored(CL.load_project_info(raw), f"{root}/loaded/project_info")
    pledge = stored(read_pledge(spark, f"{root}/pledge", schema=ignoring_case(PLEDGE_RAW)), f"{root}/loaded/pledge")
    return Tables(pi, pledge, country, CL.enrich(pi, pledge, country), raw)


def _without_case(result: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: CL.fold_case(result(_ignoring_case(s, d)))


def _bounds(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple[SparkSession, str]:
    """One stored table with bounds of a column: the session that reads footers, and the path."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/bounds/{name}"
    write_with_bounds({"project_info": t.project_info, "pledge": t.pledge}[name], path, [column])
    return footer_session(spark), path


def _row_counts_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pledge = _bounds(spark, sf_dir, "pledge", "usd_goal_real")
    _, project_info = _bounds(spark, sf_dir, "project_info", "launched")
    one = [file_bounds(s, p).select(F.lit(n).alias("table_name"), "row_count") for n, p in (("pledge", pledge), ("project_info", project_info))]
    return one[0].unionByName(one[1])


def _bounds_of(name: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: file_bounds(*_bounds(s, d, name, column), [column])


def _loads(spark: SparkSession, sf_dir: str) -> dict[str, Loaded]:
    """The checked loads of the raw files: one pass each, counts and quarantine included."""
    files, root = driver_files(spark, sf_dir), _t(spark, sf_dir).root
    return {"pledge": load_checked(spark, files["pledge_lines"], PLEDGE_RAW, f"{root}/checked/pledge", header=False),
            "project_info": load_checked(spark, files["project_info"], RAW_PROJECT_INFO_FILE, f"{root}/checked/project_info",
                                         timestamps=("launched",), dates=("deadline",))}


def _rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined lines, with the folder of the file they came from."""
    out = _loads(spark, sf_dir)["pledge"].rejected
    return out.select("line", "field_count", F.element_at(F.split("file", "/"), -2).alias("folder"))


def _current_database_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain table names read from the current database; the session's own one is current again after."""
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(driver_database(spark, sf_dir))
    try:
        return spark.sql("SELECT 'pledge' AS table_name, count(*) AS row_count FROM pledge "
                         "UNION ALL SELECT 'project_info', count(*) FROM project_info")
    finally:
        spark.catalog.setCurrentDatabase(before)


def _view(name: str):
    """A persistent view of the published database."""
    return lambda s, d: s.table(f"`{driver_database(s, d)}`.`{name}`")


def _country_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup is stored if absent: a second save changes nothing."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/country_kept"
    save_country_dim(t.country, path)
    save_country_dim(t.country.where("countrycode = ''"), path)
    return spark.read.parquet(path)


def _maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells after three arrivals, the second one delivered twice."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/cells"
    for batch in (0, 1, 2, 1):
        add_batch(t.enriched.where(F.pmod("ID", F.lit(3)) == batch), batch, path)
    return stored_cells(spark, path)


def _repair_country_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair as a change of the stored table: only launch years with a repaired project are written."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/project_info_by_year"
    loaded = CL.null_sentinel(t.project_info)
    loaded.withColumn("launch_year", F.year("launched_date")).write.mode("overwrite").partitionBy("launch_year").parquet(path)
    found = CL.repair_currencies(t.project_info, t.pledge)
    apply_changes(spark, path, "launch_year", "ID", found.select("ID", C.country_from_currency("__currency").alias("country")))
    return spark.read.parquet(path).select(*loaded.columns)


def _distinct_cells(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Distinct values per launch year, country code and currency after three arrivals, the second one delivered twice."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/distinct_{column}"
    for batch in (0, 1, 2, 1):
        D.add_batch(t.enriched.where(F.pmod("ID", F.lit(3)) == batch), batch, path, ["launch_year", "country_code", "currency"], column)
    return D.stored_cells(spark, path)


def _countries_per_currency_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-16 from stored cells: the country as loaded, per currency."""
    t = _t(spark, sf_dir)
    path = f"{t.root}/distinct_country"
    rows = t.pledge.select("ID", "currency").join(t.project_info.select("ID", "country"), "ID")
    D.add_batch(rows, 0, path, ["currency"], "country")
    return D.distinct_counts(D.stored_cells(spark, path), ["currency"], "countries_per_currency")


def _extract_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the dashboard extract, published one after the other: without the projects whose ID is
    divisible by three, then with all."""
    t = _t(spark, sf_dir)
    path, out = f"{t.root}/published", []
    for rows in (t.enriched.where(F.pmod("ID", F.lit(3)) != 0), t.enriched):
        df = V.success_rate_full(rows)
        publish(df, path, ["country"])
        out.append(read_published(spark, path, df.schema))
    return out[0], out[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # -- set-up: load, scans, counts, keys, dates --------------------------------
        "row_counts": lambda s, d: I.row_counts({"pledge": _t(s, d).pledge,
                                                 "project_info": _t(s, d).project_info}),
        "pledge_rows": lambda s, d: X.preview(_t(s, d).pledge),
        "project_info_rows": lambda s, d: X.preview(_raw_project_info(s, d)),
        "pk_project_info": lambda s, d: I.check_primary_key(_t(s, d).project_info, "ID"),
        "pk_pledge": lambda s, d: I.check_primary_key(_t(s, d).pledge, "ID"),
        "pk_country": lambda s, d: I.check_primary_key(_t(s, d).country, "countrycode"),
        "fk_pledge_project": lambda s, d: I.check_foreign_key(_t(s, d).pledge, _t(s, d).project_info, "ID", colocated=True),
        "fk_project_country": lambda s, d: I.check_foreign_key(_t(s, d).project_info, _t(s, d).country,
                                                               "country", "code"),
        "cascade_delete": lambda s, d: I.cascade_delete(
            _t(s, d).pledge, X.suspicious_rows(_t(s, d).project_info), "ID", colocated=True),
        "parse_dates": lambda s, d: CL.load_project_info(_raw_project_info(s, d)),
        "load_pledge_csv": lambda s, d: read_pledge(s, driver_files(s, d)["pledge"]),
        "load_project_info_csv": _load_project_info_csv,
        "load_pledge_dirty": lambda s, d: read_pledge(s, driver_files(s, d)["pledge_dirty"]),
        "bad_numbers": lambda s, d: unreadable_numbers(s, driver_files(s, d)["pledge_dirty"], PLEDGE_RAW),
        "stream_load_project_info": _stream_load_project_info,
        "load_counts": lambda s, d: load_counts(s, _loads(s, d)),
        "rejected_lines": _rejected_lines,
        "accepted_lines": lambda s, d: _loads(s, d)["pledge"].rows,
        "current_database_counts": _current_database_counts,
        "country_table": _country_table,
        "unparseable_dates": lambda s, d: CL.unparseable_dates(_raw_project_info(s, d)),
        # -- profiling ------------------------------------------------------------------
        "state_frequency": lambda s, d: X.value_frequency(_t(s, d).pledge, "state"),
        "country_frequency": lambda s, d: X.value_frequency(_t(s, d).project_info, "country", "country_count"),
        "main_category_frequency": lambda s, d: X.value_frequency(_t(s, d).project_info, "main_category",
                                                                  desc=True),
        "category_frequency": lambda s, d: X.value_frequency(_t(s, d).project_info, "category", desc=True),
        "distinct_countries": lambda s, d: X.distinct_count(_t(s, d).project_info, "country", "country_count"),
        "main_category_count": lambda s, d: X.distinct_count(_t(s, d).project_info, "main_category"),
        "subcategory_count": lambda s, d: X.distinct_count(_t(s, d).project_info, "category",
                                                           "subcategory_count"),
        "date_range": lambda s, d: X.date_range(_t(s, d).project_info),
        "launch_years": lambda s, d: X.launch_years(_t(s, d).project_info),
        "suspicious_rows": lambda s, d: X.suspicious_rows(_t(s, d).project_info),
        "live_by_year": lambda s, d: X.live_by_year(_t(s, d).project_info, _t(s, d).pledge),
        "currency_list": lambda s, d: X.currency_list(_t(s, d).pledge),
        "countries_per_currency": lambda s, d: X.countries_per_currency(_t(s, d).project_info, _t(s, d).pledge),
        "goal_range": lambda s, d: X.goal_range(_t(s, d).pledge),
        # -- cleaning -------------------------------------------------------------------
        "country_repair_preview": lambda s, d: CL.country_repair_preview(_t(s, d).project_info, _t(s, d).pledge),
        "repair_country": lambda s, d: CL.repair_country(_t(s, d).project_info, _t(s, d).pledge),
        "repair_country_stored": _repair_country_stored,
        "country_currency_counts": lambda s, d: X.country_currency_counts(
            _t(s, d).project_info, _t(s, d).pledge, repair=True),
        "merge_state": lambda s, d: CL.merge_state(_t(s, d).pledge),
        "enriched_base": lambda s, d: _t(s, d).enriched,
        # -- analysis and views ---------------------------------------------------------
        "top_categories_per_country": lambda s, d: A.top_categories_per_country(_t(s, d).enriched, k=5),
        "avg_project_length": lambda s, d: A.avg_project_length(_t(s, d).enriched),
        "goal_vs_pledged_by_state": lambda s, d: A.goal_vs_pledged_summary(CL.merge_state(_t(s, d).pledge)),
        "goal_vs_pledged_by_country": lambda s, d: A.goal_vs_pledged_summary(_t(s, d).enriched, by="country"),
        "growth_rates": lambda s, d: A.growth_rates(_t(s, d).enriched, 1995, 2000),
        "growth_rate_scalar": lambda s, d: A.growth_rate(_t(s, d).enriched, "BUILDING/1", "1995", "2000"),
        "success_rate": lambda s, d: V.success_rate(_t(s, d).enriched),
        "success_rate_full": lambda s, d: V.success_rate_full(_t(s, d).enriched),
        # the same two views in their window / scaffold-join formulations (for comparison)
        "success_rate_by_window": lambda s, d: V.success_rate(_t(s, d).enriched, by_window=True),
        "success_rate_full_by_join": lambda s, d: V.success_rate_full(_t(s, d).enriched, by_join=True),
        "goal_vs_pledge": lambda s, d: V.goal_vs_pledge(_t(s, d).enriched),
        "extract_success_rate_full": _extract_success_rate_full,
        "avg_success_rate": lambda s, d: A.avg_success_rate(V.success_rate_full(_t(s, d).enriched)),
        "category_leaderboard": lambda s, d: A.category_leaderboard(_success_rate(_t(s, d))),
        "category_leaderboard_country": lambda s, d: A.category_leaderboard(_success_rate(_t(s, d)),
                                                                            country="NATION_5"),
        "category_leaderboard_year": lambda s, d: A.category_leaderboard(_success_rate(_t(s, d)), year=1995),
        "category_leaderboard_sql": _category_leaderboard_sql,
        "growth_rate_sql_function": _growth_rate_sql_function,
        # persistent views of the published database, and rates kept up to date from stored cells
        "success_rate_view": _view("v_success_rate"),
        "success_rate_full_view": _view("success_rate_full"),
        "goal_vs_pledge_view": _view("goal_vs_pledge"),
        "success_rate_maintained": lambda s, d: V.success_rate_of_cells(_maintained(s, d)),
        "success_rate_full_maintained": lambda s, d: V.success_rate_full_of_cells(_maintained(s, d)),
        # exact distinct counts rolled up from stored bitmaps, and the published extract
        "projects_per_year_cells": lambda s, d: D.distinct_counts(_distinct_cells(s, d, "ID"), ["launch_year"], "project_count"),
        "projects_per_country_cells": lambda s, d: D.distinct_counts(_distinct_cells(s, d, "ID"), ["country_code"], "project_count"),
        "subcategory_count_cells": lambda s, d: D.distinct_counts(_distinct_cells(s, d, "category"), [], "subcategory_count"),
        "countries_per_currency_cells": _countries_per_currency_cells,
        "extract_published": lambda s, d: _extract_versions(s, d)[1],
        "extract_changes": lambda s, d: row_changes(*_extract_versions(s, d), ["country", "year", "main_category", "state"]),
        # growth as a table function: one pair of years, and laterally for a list of pairs
        "growth_rates_table_function": _growth_rates_table_function,
        "growth_rates_year_pairs": _growth_rates_year_pairs,
        # texts compared without case in joins, groups and windows
        "state_frequency_ignoring_case": _without_case(lambda t: X.value_frequency(t.pledge, "state", ordered=False)),
        "top_categories_ignoring_case": _without_case(lambda t: A.top_categories_per_country(t.enriched, k=5)),
        "success_rate_ignoring_case": _without_case(lambda t: V.success_rate(t.enriched, by_window=True)),
        "growth_rates_ignoring_case": _without_case(lambda t: A.growth_rates(t.enriched, 1995, 2000)),
        # counts and bounds from Parquet footers
        "row_counts_from_files": _row_counts_from_files,
        "date_range_from_files": _bounds_of("project_info", "launched"),
        "goal_bounds_from_files": _bounds_of("pledge", "usd_goal_real"),
    }
    if llm is not None:
        q |= llm.queries()
        q["pipeline"] = corpus_pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    sql = oracle.statements()
    if llm is not None:
        sql |= llm.SQL
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
