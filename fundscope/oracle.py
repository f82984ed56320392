"""DuckDB statements equivalent to the registered queries (the correctness oracle).

Each statement starts from the driver's raw tables (``orders``, ``lineitem``,
``customer``, ``nation``, ``region``) with the same mapping as
``sources.fixtures`` and the same exact rounding as ``functions.columns``.
"""

from __future__ import annotations

# The workload tables, as CTEs. project_info_raw has text dates; project_info is the
# loaded table (dates parsed, launched_date added); pledge_m adds state_merged; en is
# the enriched analysis base.
BASE = r"""
WITH
li AS (
  SELECT l_orderkey,
         CAST(max(l_shipdate) AS DATE) AS deadline_date,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)))
           AS rev_e4
  FROM lineitem GROUP BY l_orderkey),
country AS (
  SELECT 'C' || CAST(n_nationkey + 10 AS VARCHAR) AS countrycode,
         CASE WHEN n_nationkey IN (3, 4) THEN 'TWIN NATIONS' ELSE n_name END AS countryname,
         CAST(n_nationkey + 10 AS VARCHAR) AS code
  FROM nation WHERE n_nationkey < 20),
o AS (
  SELECT *, strftime(CASE WHEN o_orderkey % 97 = 0 THEN TIMESTAMP '1970-01-01 01:00:00' ELSE o_orderdate END,
                     '%d/%m/%Y %H:%M') AS launch_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey LEFT JOIN li ON li.l_orderkey = o_orderkey),
project_info_raw AS (
  SELECT unnest(list_concat([o_orderkey], list_concat(CASE WHEN o_orderkey % 307 = 0 THEN [o_orderkey] ELSE [] END,
                CASE WHEN o_orderkey % 401 = 0 THEN [NULL] ELSE [] END))) AS ID,
         c_mktsegment || '/' || substring(o_orderpriority, 1, 1) AS main_category,
         CASE WHEN o_orderkey % 139 = 0 THEN ''
              ELSE c_mktsegment || '/' || substring(o_orderpriority, 1, 1) || '/' || CAST(o_orderkey % 4 AS VARCHAR) END AS category,
         CASE WHEN o_orderkey % 131 = 0 THEN replace(launch_text, '/', '-') WHEN o_orderkey % 137 = 0 THEN ''
              ELSE launch_text END AS launched,
         strftime(deadline_date, '%d/%m/%Y') AS deadline,
         CASE WHEN o_orderkey % 50 = 0 THEN '"N' ELSE CAST(c_nationkey + 10 AS VARCHAR) END AS country
  FROM o),
pledge0 AS (
  SELECT *, CASE WHEN r_name = 'EUROPE' THEN 'EUR' ELSE CAST(c_nationkey + 10 AS VARCHAR) || 'D' END AS cur
  FROM o WHERE rev_e4 IS NOT NULL),
pledge1 AS (
  SELECT *, o_orderkey AS ID, cur AS currency FROM pledge0
  UNION ALL SELECT *, o_orderkey, 'USD' FROM pledge0 WHERE o_orderkey % 101 = 0
  UNION ALL SELECT *, -o_orderkey, cur FROM pledge0 WHERE o_orderkey % 211 = 0
  UNION ALL SELECT *, NULL, cur FROM pledge0 WHERE o_orderkey % 409 = 0),
pledge AS (
  SELECT ID,
         CASE o_orderstatus WHEN 'O' THEN 'successful'
              WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'undefined' ELSE 'live' END
              ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'suspended' WHEN o_orderkey % 5 = 1 THEN 'canceled'
                        ELSE 'failed' END
         END AS state,
         currency,
         CAST(CAST(o_totalprice AS DECIMAL(18,4)) + CASE WHEN o_orderkey % 53 = 0 THEN 0.004 ELSE 0 END AS DECIMAL(18,4)) AS usd_goal_real,
         CAST(CAST(rev_e4 AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS usd_pledged_real
  FROM pledge1),
project_info AS (
  SELECT ID, main_category, category,
         try_strptime(launched, '%d/%m/%Y %H:%M') AS launched,
         CAST(try_strptime(deadline, '%d/%m/%Y') AS DATE) AS deadline,
         country,
         CAST(try_strptime(launched, '%d/%m/%Y %H:%M') AS DATE) AS launched_date
  FROM project_info_raw),
pledge_m AS (
  SELECT *, CASE WHEN state IN ('failed', 'canceled', 'suspended') THEN 'failed'
                 WHEN state IN ('undefined', 'live') THEN 'other' ELSE state END AS state_merged
  FROM pledge),
en0 AS (
  SELECT p.ID, p.main_category, p.category, p.launched, p.launched_date,
         CAST(year(p.launched_date) AS INTEGER) AS launch_year, p.deadline,
         CASE WHEN nullif(p.country, '"N') IS NULL
              THEN CASE WHEN r.low <> 'EUR' THEN substring(r.low, 1, 2) ELSE 'Unknown' END
              ELSE p.country END AS country_code,
         m.currency, m.state, m.state_merged, m.usd_goal_real, m.usd_pledged_real
  FROM project_info p JOIN pledge_m m ON p.ID = m.ID
       JOIN (SELECT ID, min(currency) AS low FROM pledge GROUP BY ID) r ON r.ID = p.ID),
en AS (
  SELECT e.ID, e.main_category, e.category, e.launched, e.launched_date, e.launch_year, e.deadline,
         e.country_code, coalesce(c.countryname, e.country_code) AS country, e.currency, e.state,
         e.state_merged, e.usd_goal_real, e.usd_pledged_real
  FROM en0 e LEFT JOIN country c ON c.code = e.country_code),
cells AS (
  SELECT country_code, country, launch_year AS year, main_category,
         count(CASE WHEN state_merged = 'successful' THEN 1 END) AS succ,
         count(CASE WHEN state_merged = 'failed' THEN 1 END) AS fail
  FROM en WHERE state_merged <> 'other'
  GROUP BY country_code, country, launch_year, main_category),
v_success_rate AS (
  SELECT country, year, main_category, state_merged, no_of_projects, total_no,
         {pct} AS percentage
  FROM (SELECT country, year, main_category, state_merged, no_of_projects,
               CAST(sum(no_of_projects) OVER (PARTITION BY country, year, main_category) AS BIGINT) AS total_no
        FROM (SELECT country, launch_year AS year, main_category, state_merged, count(*) AS no_of_projects
              FROM en WHERE state_merged IN ('successful', 'failed')
              GROUP BY country_code, country, launch_year, main_category, state_merged) a) b),
scaffold AS (
  SELECT country, launch_year AS year, main_category, unnest(['successful', 'failed']) AS state
  FROM (SELECT DISTINCT country_code, country, launch_year, main_category FROM en
        WHERE state_merged <> 'other') d),
success_rate_full AS (
  SELECT s.country, s.year, s.main_category, s.state,
         coalesce(r.total_no, 0) AS total_no,
         coalesce(r.percentage, 0.0) AS percentage,
         r.year AS test
  FROM scaffold s LEFT JOIN v_success_rate r
    ON r.country = s.country AND r.year = s.year AND r.main_category = s.main_category
   AND r.state_merged = s.state)
"""


def half_up(num: str, den: str, scale: int) -> str:
    """SQL for exact ``round(num/den, scale)`` ties away from zero, as DOUBLE (see functions.columns)."""
    n, d = f"CAST(({num}) AS HUGEINT)", f"CAST(({den}) AS HUGEINT)"
    mag = f"((2 * {10 ** scale} * abs({n}) + abs({d})) // (2 * abs({d})))"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {d} <> 0 THEN CAST({sign} * {mag} AS DOUBLE) / {float(10 ** scale)} END)"


def half_up_int(num: str, den: str, scale: int) -> str:
    n, d = f"CAST(({num}) AS HUGEINT)", f"CAST(({den}) AS HUGEINT)"
    mag = f"((2 * {10 ** scale} * abs({n}) + abs({d})) // (2 * abs({d})))"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {d} <> 0 THEN {sign} * {mag} END)"


def money_avg(col: str, scale: int) -> str:
    return half_up(f"sum(CAST({col} * 10000 AS BIGINT))", f"count({col}) * 10000", scale)


def _growth(s: str, e: str) -> str:
    r4 = half_up_int(f"{e} - {s}", s, 4)
    r2 = half_up_int(r4, "100", 0)
    return (f"(CASE WHEN {s} > 0 AND {e} > 0 THEN "
            f"CAST(CAST({r2} AS DOUBLE) / 100.0 AS DECIMAL(10,2)) END)")


_BASE = BASE.replace("{pct}", half_up("no_of_projects * 100", "total_no", 2))


def _q(body: str) -> str:
    return _BASE + body


#: The workload without the projects whose ID is divisible by three.
_PART = _BASE.replace("ON c.code = e.country_code),", "ON c.code = e.country_code WHERE e.ID % 3 <> 0),")
_EXTRACT_KEY = "country, year, main_category, state"
_EXTRACT_STATE = ("count(*) AS n, list(struct_pack(t := total_no, p := percentage, y := test) ORDER BY total_no, percentage, test) AS rows "
                  f"FROM success_rate_full GROUP BY {_EXTRACT_KEY}")

_REPAIR = _q(
    "SELECT i.ID, i.main_category, i.category, i.launched, i.deadline, "
    "CASE WHEN nullif(i.country, '\"N') IS NOT NULL THEN i.country "
    "WHEN p.n IS NULL THEN NULL "
    "WHEN p.currency <> 'EUR' THEN substring(p.currency, 1, 2) ELSE 'Unknown' END AS country, "
    "i.launched_date FROM project_info i "
    "LEFT JOIN (SELECT ID, min(currency) AS currency, count(*) AS n FROM pledge GROUP BY ID) p "
    "ON p.ID = i.ID")


def statements() -> dict[str, str]:
    yl = "CAST(year(launched_date) AS INTEGER)"
    growth_counts = ("count(CASE WHEN launch_year = 1995 THEN 1 END) AS start_no, "
                     "count(CASE WHEN launch_year = 2000 THEN 1 END) AS end_no")
    leaderboard = (
        "SELECT main_category, state_merged, avg(CAST(percentage AS FLOAT)) AS avg_success_rate, "
        "sum(CAST(total_no AS FLOAT)) AS project_count FROM v_success_rate "
        "WHERE state_merged = 'successful' AND year <> 1970 AND year <> 2018 {extra}"
        "GROUP BY main_category, state_merged")
    growth_one = (f"SELECT {_growth('start_no', 'end_no')} AS growth_rate FROM ("
                  f" SELECT {growth_counts} FROM en"
                  " WHERE main_category = 'BUILDING/1' AND launch_year IN (1995, 2000) AND launch_year <> 1970) g")
    return {
        # -- set-up --------------------------------------------------------
        "row_counts": _q("SELECT 'pledge' AS table_name, count(*) AS row_count FROM pledge "
                         "UNION ALL SELECT 'project_info', count(*) FROM project_info_raw"),
        "pledge_rows": _q("SELECT * FROM pledge"),
        "project_info_rows": _q("SELECT * FROM project_info_raw"),
        "pk_project_info": _q("SELECT ID, count(*) AS row_count FROM project_info GROUP BY ID "
                              "HAVING count(*) > 1 OR ID IS NULL"),
        "pk_pledge": _q("SELECT ID, count(*) AS row_count FROM pledge GROUP BY ID "
                        "HAVING count(*) > 1 OR ID IS NULL"),
        "pk_country": _q("SELECT countrycode, count(*) AS row_count FROM country GROUP BY countrycode "
                         "HAVING count(*) > 1 OR countrycode IS NULL"),
        "fk_pledge_project": _q("SELECT p.* FROM pledge p WHERE p.ID IS NOT NULL AND NOT EXISTS "
                                "(SELECT 1 FROM project_info i WHERE i.ID = p.ID)"),
        "fk_project_country": _q("SELECT i.* FROM project_info i WHERE i.country IS NOT NULL AND NOT EXISTS "
                                 "(SELECT 1 FROM country c WHERE c.code = i.country)"),
        "cascade_delete": _q("SELECT p.* FROM pledge p WHERE NOT EXISTS (SELECT 1 FROM project_info i "
                             "WHERE year(i.launched_date) = 1970 AND i.ID = p.ID)"),
        "parse_dates": _q("SELECT * FROM project_info"),
        "load_pledge_csv": _q("SELECT * FROM pledge"),
        "load_project_info_csv": _q("SELECT * FROM project_info"),
        "stream_load_project_info": _q("SELECT * FROM project_info"),
        "unparseable_dates": _q(
            "SELECT count(CASE WHEN launched IS NOT NULL AND try_strptime(launched, '%d/%m/%Y %H:%M') IS NULL "
            "THEN 1 END) AS bad_launched, "
            "count(CASE WHEN deadline IS NOT NULL AND try_strptime(deadline, '%d/%m/%Y') IS NULL "
            "THEN 1 END) AS bad_deadline FROM project_info_raw"),
        "bad_numbers": _q(
            "SELECT 0::BIGINT AS \"bad_ID\", count(CASE WHEN ID % 149 = 0 THEN 1 END) AS bad_usd_goal_real, "
            "0::BIGINT AS bad_usd_pledged_real FROM pledge"),
        "load_pledge_dirty": _q(
            "SELECT ID, state, currency, CASE WHEN ID % 149 = 0 THEN NULL ELSE usd_goal_real END AS usd_goal_real, "
            "usd_pledged_real FROM pledge"),
        "load_counts": _q(
            "SELECT 'pledge' AS table_name, count(*) FILTER (NOT coalesce(bad, false)) AS row_count, count(*) FILTER (bad) AS rejected_count, "
            "count(*) FILTER (ID IS NULL) AS null_keys, count(*) FILTER (ID % 149 = 0 AND NOT bad) AS bad_numbers, 0::BIGINT AS bad_dates "
            "FROM (SELECT *, ID % 173 = 0 OR ID % 179 = 0 AS bad FROM pledge) p UNION ALL "
            "SELECT 'project_info', count(*), 0, count(*) FILTER (ID IS NULL), 0, "
            "count(*) FILTER (launched IS NOT NULL AND try_strptime(launched, '%d/%m/%Y %H:%M') IS NULL) "
            "+ count(*) FILTER (deadline IS NOT NULL AND try_strptime(deadline, '%d/%m/%Y') IS NULL) FROM project_info_raw"),
        "rejected_lines": _q(
            "SELECT concat_ws(',', ID, state || CASE WHEN ID % 173 = 0 THEN ',extra' WHEN ID % 181 = 0 THEN NULL ELSE '' END, "
            "CASE WHEN ID % 173 <> 0 AND ID % 181 = 0 THEN 'two' || chr(10) || 'lines' END, currency, "
            "CASE WHEN ID % 149 = 0 THEN 'n/a' ELSE CAST(usd_goal_real AS VARCHAR) END, "
            "CASE WHEN ID % 173 = 0 THEN CAST(usd_pledged_real AS VARCHAR) END) AS line, "
            "CASE WHEN ID % 173 = 0 THEN 6 ELSE 4 END AS field_count, 'pledge_lines' AS folder "
            "FROM pledge WHERE ID % 173 = 0 OR ID % 179 = 0"),
        "accepted_lines": _q(
            "SELECT ID, CASE WHEN ID % 181 = 0 THEN 'two' || chr(10) || 'lines' ELSE state END AS state, currency, "
            "CASE WHEN ID % 149 = 0 THEN NULL ELSE usd_goal_real END AS usd_goal_real, usd_pledged_real "
            "FROM pledge WHERE (ID % 173 <> 0 AND ID % 179 <> 0) OR ID IS NULL"),
        "current_database_counts": _q("SELECT 'pledge' AS table_name, count(*) AS row_count FROM pledge "
                                      "UNION ALL SELECT 'project_info', count(*) FROM project_info_raw"),
        "country_table": _q("SELECT * FROM country"),
        # -- profiling -----------------------------------------------------
        "state_frequency": _q("SELECT state, count(state) AS project_count FROM pledge GROUP BY state"),
        "country_frequency": _q("SELECT country, count(country) AS country_count FROM project_info GROUP BY country"),
        "main_category_frequency": _q("SELECT main_category, count(main_category) AS project_count "
                                      "FROM project_info GROUP BY main_category"),
        "category_frequency": _q("SELECT category, count(category) AS project_count "
                                 "FROM project_info GROUP BY category"),
        "distinct_countries": _q("SELECT count(DISTINCT country) AS country_count FROM project_info"),
        "main_category_count": _q("SELECT count(DISTINCT main_category) AS main_category_count FROM project_info"),
        "subcategory_count": _q("SELECT count(DISTINCT category) AS subcategory_count FROM project_info"),
        "date_range": _q("SELECT min(launched) AS start_date, max(launched) AS end_date FROM project_info"),
        "launch_years": _q("SELECT DISTINCT CAST(year(CAST(launched AS DATE)) AS INTEGER) AS year FROM project_info"),
        "suspicious_rows": _q("SELECT * FROM project_info WHERE year(launched_date) = 1970"),
        "live_by_year": _q(f"SELECT {yl} AS year_launched, CAST(year(deadline) AS INTEGER) AS year_deadline, "
                           "count(*) AS project_count FROM project_info i JOIN pledge p ON p.ID = i.ID "
                           "WHERE state = 'live' GROUP BY 1, 2"),
        "currency_list": _q("SELECT currency, row_number() OVER (ORDER BY currency NULLS FIRST) AS currency_count "
                            "FROM pledge GROUP BY currency"),
        "countries_per_currency": _q("SELECT currency, count(DISTINCT country) AS countries_per_currency "
                                     "FROM pledge p JOIN project_info i ON p.ID = i.ID GROUP BY currency"),
        "goal_range": _q(f"SELECT CAST(min(usd_goal_real) AS DOUBLE) AS min_goal_usd, "
                         f"{money_avg('usd_goal_real', 6)} AS avg_goal_usd, "
                         f"CAST(max(usd_goal_real) AS DOUBLE) AS max_goal_usd FROM pledge"),
        # -- cleaning ------------------------------------------------------
        "country_repair_preview": _q(
            "SELECT nullif(i.country, '\"N') AS country, p.currency, "
            "coalesce(nullif(i.country, '\"N'), substring(p.currency, 1, 2)) AS country_new "
            "FROM pledge p JOIN project_info i ON i.ID = p.ID WHERE nullif(i.country, '\"N') IS NULL"),
        "repair_country": _REPAIR,
        "repair_country_stored": _REPAIR,
        "country_currency_counts": _q("SELECT country_code AS country, currency, count(*) AS project_count "
                                      "FROM en GROUP BY country_code, currency"),
        "merge_state": _q("SELECT * FROM pledge_m"),
        "enriched_base": _q("SELECT * FROM en"),
        # -- analysis ------------------------------------------------------
        "top_categories_per_country": _q(
            "SELECT country, main_category, no_of_projects, state_merged, top_no FROM ("
            " SELECT country, main_category, no_of_projects, state_merged,"
            "  CAST(dense_rank() OVER (PARTITION BY country ORDER BY no_of_projects DESC) AS INTEGER) AS top_no"
            " FROM (SELECT country, main_category, state_merged, count(ID) AS no_of_projects FROM en"
            "       WHERE state_merged = 'successful'"
            "       GROUP BY country_code, country, main_category, state_merged) c) r WHERE top_no <= 5"),
        "avg_project_length": _q(
            "SELECT country, "
            + half_up("sum(datediff('day', launched_date, deadline))",
                      "count(datediff('day', launched_date, deadline))", 4)
            + " AS avg_project_length, state_merged FROM en "
              "WHERE year(launched_date) <> 1970 AND state_merged <> 'other' "
              "GROUP BY country_code, country, state_merged"),
        "goal_vs_pledged_by_state": _q(
            f"SELECT state_merged, {money_avg('usd_goal_real', 2)} AS avg_goal_usd, "
            f"{money_avg('usd_pledged_real', 2)} AS avg_pledged_usd FROM pledge_m "
            "WHERE state_merged <> 'other' GROUP BY state_merged"),
        "goal_vs_pledged_by_country": _q(
            f"SELECT country, state_merged, {money_avg('usd_goal_real', 2)} AS avg_goal_usd, "
            f"{money_avg('usd_pledged_real', 2)} AS avg_pledged_usd FROM en "
            "WHERE state_merged <> 'other' GROUP BY country_code, country, state_merged"),
        "growth_rates": _q(
            f"SELECT main_category, start_no, end_no, {_growth('start_no', 'end_no')} AS growth_rate FROM ("
            f" SELECT main_category, {growth_counts} FROM en"
            " WHERE launch_year IN (1995, 2000) AND launch_year <> 1970 GROUP BY main_category) g"),
        "growth_rate_scalar": _q(growth_one),
        "success_rate": _q("SELECT * FROM v_success_rate"),
        "success_rate_full": _q("SELECT * FROM success_rate_full"),
        "success_rate_by_window": _q("SELECT * FROM v_success_rate"),
        "success_rate_full_by_join": _q("SELECT * FROM success_rate_full"),
        "extract_success_rate_full": _q("SELECT * FROM success_rate_full"),
        "goal_vs_pledge": _q("SELECT ID, country, main_category, state_merged, launched_date, usd_goal_real, "
                             "usd_pledged_real FROM en WHERE state_merged <> 'other'"),
        "avg_success_rate": _q(
            "SELECT " + half_up("sum(CAST(round(percentage * 100) AS BIGINT))",
                                "count(percentage) * 100", 6)
            + " AS avg_success_rate FROM success_rate_full WHERE state = 'successful'"),
        "category_leaderboard": _q(leaderboard.format(extra="")),
        "category_leaderboard_country": _q(leaderboard.format(extra="AND country = 'NATION_5' ")),
        "category_leaderboard_year": _q(leaderboard.format(extra="AND year = 1995 ")),
        "category_leaderboard_sql": _q(leaderboard.format(extra="")),
        "growth_rate_sql_function": _q(growth_one),
        "success_rate_view": _q("SELECT * FROM v_success_rate"),
        "success_rate_full_view": _q("SELECT * FROM success_rate_full"),
        "goal_vs_pledge_view": _q("SELECT ID, country, main_category, state_merged, launched_date, usd_goal_real, "
                                  "usd_pledged_real FROM en WHERE state_merged <> 'other'"),
        "success_rate_maintained": _q("SELECT * FROM v_success_rate"),
        "success_rate_full_maintained": _q("SELECT * FROM success_rate_full"),
        "projects_per_year_cells": _q("SELECT launch_year, count(DISTINCT ID) AS project_count FROM en GROUP BY launch_year"),
        "projects_per_country_cells": _q("SELECT country_code, count(DISTINCT ID) AS project_count FROM en GROUP BY country_code"),
        "subcategory_count_cells": _q("SELECT count(DISTINCT category) AS subcategory_count FROM en"),
        "countries_per_currency_cells": _q("SELECT currency, count(DISTINCT country) AS countries_per_currency "
                                           "FROM pledge p JOIN project_info i ON p.ID = i.ID GROUP BY currency"),
        "growth_rates_table_function": _q(
            f"SELECT main_category, start_no, end_no, {_growth('start_no', 'end_no')} AS growth_rate FROM ("
            f" SELECT main_category, {growth_counts} FROM en"
            " WHERE launch_year IN (1995, 2000) AND launch_year <> 1970 GROUP BY main_category) g"),
        "growth_rates_year_pairs": _q(
            f"SELECT start_year, main_category, start_no, end_no, {_growth('start_no', 'end_no')} AS growth_rate FROM ("
            " SELECT y.launch_year AS start_year, main_category, count(CASE WHEN en.launch_year = y.launch_year THEN 1 END) AS start_no, "
            " count(CASE WHEN en.launch_year = y.launch_year + 1 THEN 1 END) AS end_no"
            " FROM (SELECT DISTINCT launch_year FROM en WHERE launch_year IS NOT NULL) y"
            " JOIN en ON en.launch_year IN (y.launch_year, y.launch_year + 1) AND en.launch_year <> 1970"
            " GROUP BY y.launch_year, main_category) g"),
        "state_frequency_ignoring_case": _q("SELECT lower(state) AS state, count(state) AS project_count FROM pledge GROUP BY lower(state)"),
        "top_categories_ignoring_case": _q(
            "SELECT country, main_category, no_of_projects, state_merged, top_no FROM ("
            " SELECT country, main_category, no_of_projects, state_merged,"
            "  CAST(dense_rank() OVER (PARTITION BY country ORDER BY no_of_projects DESC) AS INTEGER) AS top_no"
            " FROM (SELECT lower(country) AS country, lower(main_category) AS main_category, state_merged, count(ID) AS no_of_projects"
            "       FROM en WHERE state_merged = 'successful'"
            "       GROUP BY lower(country_code), lower(country), lower(main_category), state_merged) c) r WHERE top_no <= 5"),
        "success_rate_ignoring_case": _q("SELECT * REPLACE (lower(country) AS country, lower(main_category) AS main_category) FROM v_success_rate"),
        "growth_rates_ignoring_case": _q(
            f"SELECT main_category, start_no, end_no, {_growth('start_no', 'end_no')} AS growth_rate FROM ("
            f" SELECT lower(main_category) AS main_category, {growth_counts} FROM en"
            " WHERE launch_year IN (1995, 2000) AND launch_year <> 1970 GROUP BY lower(main_category)) g"),
        "row_counts_from_files": _q("SELECT 'pledge' AS table_name, count(*) AS row_count FROM pledge "
                                    "UNION ALL SELECT 'project_info', count(*) FROM project_info_raw"),
        "date_range_from_files": _q("SELECT count(*) AS row_count, count(launched) AS count_launched, min(launched) AS min_launched, "
                                    "max(launched) AS max_launched FROM project_info"),
        "goal_bounds_from_files": _q("SELECT count(*) AS row_count, count(usd_goal_real) AS count_usd_goal_real, min(usd_goal_real) AS min_usd_goal_real, "
                                     "max(usd_goal_real) AS max_usd_goal_real FROM pledge"),
        "extract_published": _q("SELECT * FROM success_rate_full"),
        "extract_changes": (
            "SELECT coalesce(o.country, n.country) AS country, coalesce(o.year, n.year) AS year, coalesce(o.main_category, n.main_category) "
            "AS main_category, coalesce(o.state, n.state) AS state, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' "
            f"ELSE 'changed' END AS change FROM ({_PART} SELECT {_EXTRACT_KEY}, {_EXTRACT_STATE}) o "
            f"FULL JOIN ({_BASE} SELECT {_EXTRACT_KEY}, {_EXTRACT_STATE}) n ON o.country IS NOT DISTINCT FROM n.country "
            "AND o.year IS NOT DISTINCT FROM n.year AND o.main_category IS NOT DISTINCT FROM n.main_category AND o.state = n.state "
            "WHERE o.n IS NULL OR n.n IS NULL OR o.rows <> n.rows"),
    }
