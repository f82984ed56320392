"""One country holding a third of all rows: results stay exact, and the hot key is spread out."""

import datetime as dt

from pyspark.sql import functions as F

from fundscope.operators import analysis as A
from fundscope.operators import views as V
from fundscope.plans.joins import lookup_join


def _skewed_base(spark, n=30000):
    base = spark.range(0, n, numPartitions=8).select(
        F.col("id").alias("ID"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("id") % 40).cast("string")))
         .alias("country_code"),
        F.concat(F.lit("cat"), (F.col("id") % 7).cast("string")).alias("main_category"),
        F.when(F.col("id") % 5 < 2, F.lit("successful")).otherwise(F.lit("failed")).alias("state_merged"),
        F.make_date(F.lit(2010) + (F.col("id") % 6).cast("int"), F.lit(1), F.lit(1)).alias("launched_date"))
    return (base.withColumn("country", F.col("country_code"))
                .withColumn("launch_year", F.year("launched_date"))
                .withColumn("deadline", F.date_add("launched_date", 30)))


def test_rates_with_a_hot_country_match_brute_force(spark):
    en = _skewed_base(spark)
    got = {(r.country, r.year, r.main_category, r.state_merged): (r.no_of_projects, r.total_no)
           for r in V.success_rate(en, ordered=False).collect()}
    rows = en.select("country", "launch_year", "main_category", "state_merged").collect()
    want = {}
    for r in rows:
        k = (r.country, r.launch_year, r.main_category, r.state_merged)
        want[k] = want.get(k, 0) + 1
    totals = {}
    for (c, y, m, s), n in want.items():
        totals[(c, y, m)] = totals.get((c, y, m), 0) + n
    assert got == {k: (n, totals[k[:3]]) for k, n in want.items()}
    plan = V.success_rate(en)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan          # map-side combine before the shuffle
    top = A.top_categories_per_country(en, k=3)
    assert top.where(F.col("country") == "HOT").count() >= 3


def test_lookup_of_a_hot_key_is_split_by_the_skew_join(spark):
    en = _skewed_base(spark)
    dim = spark.createDataFrame([("HOT", "Hotland")] + [(f"C{i}", f"Country {i}") for i in range(40)],
                                "code string, name string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        j = lookup_join(en, dim, "country_code", "code", "left")
        rows = j.collect()
        assert sum(r.country_code == "HOT" and r.name == "Hotland" for r in rows) == 10000 and len(rows) == 30000
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_global_row_number_spreads_a_hot_key(spark):
    from pyspark.sql import Window
    from fundscope.plans.joins import global_row_number
    df = spark.range(0, 9000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"))   # a third of rows k = 5
    out = global_row_number(df, ["k"], "rn", partitions=8)
    rows = out.collect()
    assert sorted(r.rn for r in rows) == list(range(1, 9001))
    by_rn = [r.k for r in sorted(rows, key=lambda r: r.rn)]
    assert by_rn == sorted(by_rn)                                    # numbering follows the key order
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k")).cast("long"))
    assert {(r.k, r.rn) for r in ref.where(F.col("k") != 5).collect()} == \
           {(r.k, r.rn) for r in rows if r.k != 5}                   # untied keys get the same numbers
