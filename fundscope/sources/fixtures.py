"""Adapter: the driver's TPC-H-like tables presented as the three workload tables.

The mapping plants the defects the cleaning steps exist for: a corrupt country
value, a 1970 placeholder launch date, an ambiguous currency (EUR) and a lookup
that lacks some codes and shows two codes under one name. Every order is a project;
an order without line items has no pledge and no deadline. Some projects have a second
pledge in another currency, some pledges name no project, some keys repeat or are NULL,
some texts are empty and some dates are written with other separators. Money is exact
decimals, some of it with parts of cents. Dates are rendered as the day-first text of the
raw files, so the date parser runs on every load.

``order_facts`` is ONE pass over ``lineitem`` and ``orders``: the per-order line
aggregate (deadline and pledged sum together, partially aggregated before its
shuffle) joined to orders on the order key and to the customer's nation and
region. ``raw_tables`` projects both fact tables from it; ``plans.workload``
stores it once, so the mapping's joins run once per session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import COUNTRY_SENTINEL, format_day_first

# ---------------------------------------------------------------------------
# Fixed values of the mapping (the DuckDB oracle uses the same ones)
# ---------------------------------------------------------------------------
CODE_OFFSET = 10            # nation key + 10 = two-character country code
LOOKUP_NATIONS_BELOW = 20   # only nations 0..19 are in the lookup
CORRUPT_COUNTRY_EVERY = 50  # order key % 50 == 0 -> corrupt country
PLACEHOLDER_DATE_EVERY = 97  # order key % 97 == 0 -> launched 1970-01-01 01:00
PLACEHOLDER_LAUNCH = "1970-01-01 01:00:00"
EURO_REGION = "EUROPE"
SHARED_NAME, SHARED_NATIONS = "TWIN NATIONS", (3, 4)  # two codes shown under one name
SECOND_PLEDGE_EVERY = 101   # order key % 101 == 0 -> a second pledge row, in USD
ORPHAN_PLEDGE_EVERY = 211   # -> a pledge row whose ID (minus the key) is no project
REPEATED_KEY_EVERY = 307    # -> the project row twice
NULL_PROJECT_EVERY, NULL_PLEDGE_EVERY = 401, 409  # -> one more row with a NULL ID
DASHED_DATE_EVERY, EMPTY_DATE_EVERY, EMPTY_TEXT_EVERY = 131, 137, 139
PART_CENT_EVERY, PART_CENT = 53, "0.004"  # goal with parts of a cent
BAD_NUMBER_EVERY = 149      # in the dirty pledge file: the goal is no number
MIXED_SPELLINGS = 3         # ID % 3 == 0 -> upper case, 1 -> lower case, in the mixed-case files
EXTRA_FIELD_EVERY, CUT_LINE_EVERY, LINE_FEED_EVERY = 173, 179, 181  # in the file of broken lines
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(nationkey) -> F.Column:
    return (nationkey + F.lit(CODE_OFFSET)).cast("string")


def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``country``: 20 of the 25 nations, so some codes fall back to the bare code."""
    n = read_table(spark, sf_dir, "nation")
    return (n.where(F.col("n_nationkey") < LOOKUP_NATIONS_BELOW)
             .select(F.concat(F.lit("C"), _code(F.col("n_nationkey"))).alias("countrycode"),
                     F.when(F.col("n_nationkey").isin(*SHARED_NATIONS), SHARED_NAME).otherwise(F.col("n_name")).alias("countryname"),
                     _code(F.col("n_nationkey")).alias("code")))


MONEY = "decimal(18,4)"

# column layout of the raw project_info file written from these tables
RAW_PROJECT_INFO_FILE = T.StructType([
    T.StructField("ID", T.LongType(), True),
    T.StructField("main_category", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("launched", T.StringType(), True),
    T.StructField("deadline", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])


@dataclass(frozen=True)
class RawTables:
    project_info: DataFrame
    pledge: DataFrame
    country: DataFrame


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the order, its customer's nation/region
    and the per-order line aggregate. Both fact tables are projections of it."""
    li = read_table(spark, sf_dir, "lineitem")
    # exact pledged sum in whole 1/10000 units with long arithmetic (price in cents x
    # (100 - discount in percent)); far cheaper than DECIMAL(38,4) per row
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    keep_pct = F.lit(100) - F.round(F.col("l_discount") * 100).cast("long")
    per_order = li.groupBy("l_orderkey").agg(
        F.max("l_shipdate").cast("date").alias("deadline_date"),
        F.sum(cents * keep_pct).alias("rev_e4"),
    )
    # only the columns and the part of the priority that the mapping uses are carried through the joins
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # no join hints: Catalyst broadcasts nation/region because their measured size is
    # under the broadcast threshold, and plans a shuffle join otherwise
    named = nation.join(region, F.col("n_regionkey") == region.r_regionkey).select("n_nationkey", "r_name")
    oc = orders.join(customer, orders.o_custkey == customer.c_custkey)
    # the region is put on behind the large joins
    return (oc.join(per_order, oc.o_orderkey == per_order.l_orderkey, "left")
              .join(named, F.col("c_nationkey") == named.n_nationkey)
              .select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                      "c_nationkey", "c_mktsegment", "r_name", "deadline_date", "rev_e4"))


def raw_tables(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> RawTables:
    """The three workload tables. ``facts`` may be a stored copy of ``order_facts``."""
    facts = order_facts(spark, sf_dir) if facts is None else facts
    k = F.col("o_orderkey")
    segment_priority = F.concat(F.col("c_mktsegment"), F.lit("/"), F.substring("o_orderpriority", 1, 1))
    launched = (F.when(k % PLACEHOLDER_DATE_EVERY == 0,
                       F.lit(PLACEHOLDER_LAUNCH).cast("timestamp_ntz"))
                 .otherwise(F.col("o_orderdate").cast("timestamp_ntz")))
    text = format_day_first(launched)
    null = F.lit(None).cast("long")
    ids = F.concat(F.array(k), F.when(k % REPEATED_KEY_EVERY == 0, F.array(k)).otherwise(F.array().cast("array<long>")),
                   F.when(k % NULL_PROJECT_EVERY == 0, F.array(null)).otherwise(F.array().cast("array<long>")))
    category = F.concat(segment_priority, F.lit("/"), (k % 4).cast("string"))
    project_info = facts.select(
        F.explode(ids).alias("ID"),
        segment_priority.alias("main_category"),
        F.when(k % EMPTY_TEXT_EVERY == 0, F.lit("")).otherwise(category).alias("category"),
        F.when(k % DASHED_DATE_EVERY == 0, F.translate(text, "/", "-"))
         .when(k % EMPTY_DATE_EVERY == 0, F.lit("")).otherwise(text).alias("launched"),
        format_day_first(F.col("deadline_date"), with_time=False).alias("deadline"),
        F.when(k % CORRUPT_COUNTRY_EVERY == 0, F.lit(COUNTRY_SENTINEL))
         .otherwise(_code(F.col("c_nationkey"))).alias("country"),
    )
    status = F.col("o_orderstatus")
    state = (F.when(status == "O", F.lit("successful"))
              .when(status == "P", F.when(k % 3 == 0, F.lit("undefined")).otherwise(F.lit("live")))
              .otherwise(F.when(k % 5 == 0, F.lit("suspended"))
                          .when(k % 5 == 1, F.lit("canceled"))
                          .otherwise(F.lit("failed"))))
    currency = (F.when(F.col("r_name") == EURO_REGION, F.lit("EUR"))
                 .otherwise(F.concat(_code(F.col("c_nationkey")), F.lit("D"))))
    row = lambda key, cur: F.array(F.struct(key.alias("ID"), cur.alias("currency")))
    none = F.array().cast("array<struct<ID:bigint,currency:string>>")
    rows = F.concat(row(k, currency),
                    F.when(k % SECOND_PLEDGE_EVERY == 0, row(k, F.lit("USD"))).otherwise(none),
                    F.when(k % ORPHAN_PLEDGE_EVERY == 0, row(-k, currency)).otherwise(none),
                    F.when(k % NULL_PLEDGE_EVERY == 0, row(null, currency)).otherwise(none))
    goal = F.col("o_totalprice").cast(MONEY) + F.when(k % PART_CENT_EVERY == 0, F.lit(PART_CENT)).otherwise("0").cast(MONEY)
    pledge = (facts.where(F.col("rev_e4").isNotNull())
              .select(F.explode(rows).alias("p"), state.alias("state"), goal.cast(MONEY).alias("usd_goal_real"),
                      (F.col("rev_e4").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(MONEY).alias("usd_pledged_real"))
              .select("p.ID", "state", "p.currency", "usd_goal_real", "usd_pledged_real"))
    return RawTables(project_info, pledge, country_lookup(spark, sf_dir))


def with_bad_numbers(pledge: DataFrame) -> DataFrame:
    """The pledge rows as they would be in a dirty file: some goals are no number."""
    bad = F.col("ID") % BAD_NUMBER_EVERY == 0
    return pledge.withColumn("usd_goal_real", F.when(bad, F.lit("n/a")).otherwise(F.col("usd_goal_real").cast("string")))


def broken_lines(pledge: DataFrame) -> DataFrame:
    """The dirty pledge rows as lines (``value``): some have a separator inside the state, some lack the last field,
    some hold a lone line feed in a text."""
    d, null = with_bad_numbers(pledge), F.lit("\\N")
    extra, cut, feed = (F.coalesce(F.col("ID") % n == 0, F.lit(False)) for n in (EXTRA_FIELD_EVERY, CUT_LINE_EVERY, LINE_FEED_EVERY))
    state = F.when(extra, F.concat("state", F.lit(",extra"))).when(feed, "two\nlines").otherwise(F.col("state"))
    text = [F.coalesce(c.cast("string"), null) for c in (F.col("ID"), state, F.col("currency"), F.col("usd_goal_real"))]
    last = F.when(cut & ~extra, F.lit(None)).otherwise(F.coalesce(F.col("usd_pledged_real").cast("string"), null))
    return d.select(F.concat_ws(",", *text, last).alias("value"))


def mixed_case(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``columns`` in the spelling their ID gives them: upper case, lower case or as they are."""
    k = F.pmod("ID", F.lit(MIXED_SPELLINGS))
    return df.withColumns({c: F.when(k == 0, F.upper(c)).when(k == 1, F.lower(c)).otherwise(F.col(c)) for c in columns})
