"""Plan shape: the physical strategies the operators are designed to get."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import analysis as A
from fundscope.operators import cleaning as CL
from fundscope.operators import explore as X
from fundscope.operators import integrity as I
from fundscope.operators import views as V
from fundscope.plans.joins import global_row_number, lookup_join
from fundscope.plans.workload import driver_tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.collect()  # runs the DataFrame's own query execution, so AQE's final plan is kept
    return _plan(df)


def test_lookup_is_broadcast_and_no_cross_join(spark):
    t = driver_tables(spark, SF01)
    p = _plan(CL.enrich(t.project_info, t.pledge, t.country))
    assert "BroadcastHashJoin" in p and "LeftOuter" in p
    for df in (V.success_rate_full(t.enriched), V.success_rate(t.enriched)):
        p = _plan(df)
        assert "NestedLoopJoin" not in p and "Cartesian" not in p
        assert "Join" not in p              # one conditional aggregation, no join at all
        assert "Window" not in p


def test_top_k_uses_window_group_limit(spark):
    t = driver_tables(spark, SF01)
    assert "WindowGroupLimit" in _plan(A.top_categories_per_country(t.enriched, k=5))


def test_year_filter_prunes_partitions_and_columns(spark):
    t = driver_tables(spark, SF01)
    p = _plan(A.growth_rates(t.enriched, 1995, 2000))
    assert "PartitionFilters: [isnotnull(launch_year" in p
    scan = [line for line in p.splitlines() if "FileScan" in line][0]
    assert "ReadSchema: struct<main_category:string>" in scan


def test_state_filter_pushed_to_scan(spark):
    t = driver_tables(spark, SF01)
    p = _plan(A.top_categories_per_country(t.enriched))
    assert "PushedFilters: [IsNotNull(state_merged), EqualTo(state_merged,successful)]" in p


def test_lookup_join_shuffles_above_the_threshold_with_the_same_rows(spark):
    facts = spark.range(0, 5000).select(F.col("id").alias("ID"),
                                        F.when(F.col("id") % 3 == 0, "A").otherwise((F.col("id") % 7).cast("string"))
                                        .alias("k"))
    dim = spark.createDataFrame([("A", "hot"), ("1", "one"), ("2", "two")], "code string, name string")
    a = lookup_join(facts, dim, "k", "code", "left").collect()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = lookup_join(facts, dim, "k", "code", "left")
        assert "BroadcastHashJoin" not in _plan(b)
        assert sorted(map(str, a)) == sorted(map(str, b.collect())) and len(a) == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_global_row_number_matches_window_with_and_without_exchange_reuse(spark):
    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20011).alias("v"))
    b = df.withColumn("rn", F.row_number().over(Window.orderBy("v")).cast("long"))
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            a = global_row_number(df, ["v"], "rn", partitions=8)
            assert a.exceptAll(b).count() == 0 and a.count() == 20000
            many = global_row_number(spark.range(2_000_000).select((F.col("id") % 1000).alias("v")), ["v"], "rn", partitions=8)
            got = many.agg(F.count_distinct("rn").alias("n"), F.max("rn").alias("top")).first()
            assert (got.n, got.top) == (2_000_000, 2_000_000)
        finally:
            spark.conf.set("spark.sql.exchange.reuse", old)


def test_currency_list_takes_few_exchanges(spark):
    t = driver_tables(spark, SF01)
    p = _plan(X.currency_list(t.pledge))
    assert p.count("Exchange ") - p.count("BroadcastExchange ") <= 3


def test_key_checks_on_stored_tables_do_not_shuffle(spark):
    t = driver_tables(spark, SF01)
    for df in (I.check_foreign_key(t.pledge, t.project_info, "ID", colocated=True),
               I.cascade_delete(t.pledge, X.suspicious_rows(t.project_info), "ID", colocated=True)):
        p = _plan(df)
        assert "Exchange" not in p and p.count("Bucketed: true") == 2 and "SortMergeJoin" in p


def test_repaired_counts_shuffle_only_the_counts(spark):
    """The repair joins co-located buckets; no window gathers an ID."""
    t = driver_tables(spark, SF01)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(X.country_currency_counts(t.project_info, t.pledge, repair=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert p.count("SortMergeJoin") == 3 and p.count("Bucketed: true") == 4 and p.count("Exchange ") == 1 and "Window" not in p


def test_placeholder_year_prunes_and_date_range_is_pushed(spark):
    t = driver_tables(spark, SF01)
    assert "PartitionFilters: [isnotnull(launch_year" in _plan(A.avg_project_length(t.enriched))
    assert "GreaterThanOrEqual(launched_date,1970-01-01)" in _plan(X.suspicious_rows(t.project_info))


def test_repair_joins_only_missing_rows(spark):
    t = driver_tables(spark, SF01)
    p = _plan(CL.repair_country(t.project_info, t.pledge))
    assert "Union" in p


def test_success_rate_window_variant_matches(spark):
    t = driver_tables(spark, SF01)
    a = V.success_rate(t.enriched, ordered=False)
    b = V.success_rate(t.enriched, by_window=True, ordered=False)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_success_rate_full_join_variant_matches(spark):
    t = driver_tables(spark, SF01)
    a = V.success_rate_full(t.enriched)
    b = V.success_rate_full(t.enriched, by_join=True)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    p = _plan(b)
    assert "NestedLoopJoin" not in p and "Cartesian" not in p


def test_currency_list_distinct_then_numbered(spark):
    t = driver_tables(spark, SF01)
    rows = X.currency_list(t.pledge).collect()
    assert [r.currency_count for r in rows] == list(range(1, len(rows) + 1))
    assert [r.currency for r in rows] == sorted(r.currency for r in rows)


def test_project_pledge_join_is_colocated_without_broadcast(spark):
    """At scale neither side is broadcast; the bucketed tables join without a shuffle."""
    t = driver_tables(spark, SF01)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(CL.enrich(t.project_info, t.pledge, t.country))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = p.splitlines()
    i = next(k for k, line in enumerate(lines) if "SortMergeJoin [ID" in line)
    depth = lines[i].index("SortMergeJoin")
    sub = [lines[i]]
    for line in lines[i + 1:]:
        body = line.lstrip(" :+-")
        if len(line) - len(body) <= depth:
            break
        sub.append(line)
    smj = "\n".join(sub)
    assert "Exchange" not in smj and "Window" not in smj
    assert smj.count("Bucketed: true") == 4  # the two tables, and once more for projects without a country


def _exchanges(df) -> int:
    return _plan(df).count("Exchange hashpartitioning") + _plan(df).count("REBALANCE_PARTITIONS")


def test_the_store_shuffles_no_finished_table_again(spark, monkeypatch):
    """Order facts and the enriched base are written as their joins leave them."""
    from pyspark.sql import DataFrame

    hints = []
    monkeypatch.setattr(DataFrame, "hint", lambda df, name, *cols, f=DataFrame.hint: (hints.append(name), f(df, name, *cols))[1])
    t = driver_tables(spark, SF01, refresh=True)
    assert "rebalance" not in hints
    assert _exchanges(CL.enrich(t.project_info, t.pledge, t.country)) == 0
    assert t.enriched.count() == CL.enrich(t.project_info, t.pledge, t.country).count()


def test_texts_without_case_are_parsed_once_not_in_filters(spark):
    import __spark_entry__ as E

    t = E._ignoring_case(spark, SF01)
    p = _plan(A.growth_rates(t.enriched, 1995, 2000))
    assert "FileScan text" not in p and "split(" not in p
    assert t.project_info.count() == driver_tables(spark, SF01).project_info.count()
    assert t.pledge.count() == driver_tables(spark, SF01).pledge.count()
