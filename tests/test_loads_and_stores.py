"""Checked loads with quarantine and counts, stored changes, maintained cells, persistent views, hot IDs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import cleaning as CL
from fundscope.operators import explore as X
from fundscope.operators import views as V
from fundscope.plans.workload import driver_database, driver_tables
from fundscope.schemas import PLEDGE_RAW, PROJECT_INFO_RAW
from fundscope.sources.delimited import read_delimited
from fundscope.sources.loads import load_checked
from fundscope.sources.stored import apply_changes
from fundscope.streaming import cells
from fundscope.streaming.incremental import load_available

HEAD = b"ID,state,currency,usd_goal_real,usd_pledged_real\r\n"


def _files(scratch):
    box = os.path.join(scratch, "in")
    os.mkdir(box)
    with open(f"{box}/a.csv", "wb") as f:
        f.write(HEAD + b"1,two\nlines,GBP,1.5,2\r\n2,cr\ronly,GBP,n/a,\\N\r\n3,\"N,0,GBP,1,1\r\n\r\n4,live\r\n,live,USD,,0.0001\r\n")
    with open(f"{box}/b.csv", "wb") as f:
        f.write(HEAD + b"5,live,EUR,1,1")
    return box


def test_rows_end_at_crlf_only(spark, scratch):
    box = _files(scratch)
    got = {r.ID: r.state for r in read_delimited(spark, box, PLEDGE_RAW).collect()}
    assert got == {1: "two\nlines", 2: "cr\ronly", 3: '"N', 4: "live", None: "live", 5: "live"}
    out = load_available(spark, box, PLEDGE_RAW, f"{scratch}/table", f"{scratch}/ckpt")
    assert {r.ID: r.state for r in out.collect()} == got
    # another line end is a parameter
    lf = read_delimited(spark, box, PLEDGE_RAW, line_sep="\n").where("state = 'two'")
    assert lf.count() == 1


def test_every_line_is_in_the_table_or_the_quarantine(spark, scratch):
    box = _files(scratch)
    got = load_checked(spark, box, PLEDGE_RAW, f"{scratch}/t")
    assert sorted((r.ID or 0, r.state) for r in got.rows.collect()) == [(0, "live"), (1, "two\nlines"), (2, "cr\ronly"), (5, "live")]
    assert got.rows.schema == PLEDGE_RAW
    assert sorted((r.line, r.field_count, os.path.basename(r.file)) for r in got.rejected.collect()) == [
        ("", 1, "a.csv"), ('3,"N,0,GBP,1,1', 6, "a.csv"), ("4,live", 2, "a.csv")]
    # '' is no number: key and goal of the line without them
    assert got.counts == {"row_count": 4, "rejected_count": 3, "null_keys": 1, "bad_numbers": 3, "bad_dates": 0}
    again = load_checked(spark, box, PLEDGE_RAW, f"{scratch}/t")
    assert again.counts == got.counts and again.rows.count() == 4


def test_load_counts_bad_dates_and_empty_input(spark, scratch):
    path = f"{scratch}/p.csv"
    with open(path, "wb") as f:
        f.write(b"h\r\n1,n,c,m,31/04/2015,01/02/2015 9:05,GB\r\n2,n,c,m,1/2/2015,bad,GB\r\n3,n,c,m,\\N,,GB\r\n")
    got = load_checked(spark, path, PROJECT_INFO_RAW, f"{scratch}/t", timestamps=("launched",), dates=("deadline",))
    assert got.counts == {"row_count": 3, "rejected_count": 0, "null_keys": 0, "bad_numbers": 0, "bad_dates": 3}
    with open(f"{scratch}/e.csv", "wb"):
        pass
    empty = load_checked(spark, f"{scratch}/e.csv", PLEDGE_RAW, f"{scratch}/e")
    assert empty.counts["row_count"] == 0 and empty.rows.count() == 0 and empty.rejected.count() == 0


def test_stored_change_writes_touched_partitions_only(spark, scratch):
    path = f"{scratch}/t"
    rows = [(1, "a", 1, 2000), (2, None, 2, 2000), (3, "c", 3, 2001), (3, "c", 4, 2001), (4, "d", 5, 2002), (None, "e", 6, 2003), (5, "f", 7, None)]
    schema = "ID long, country string, extra long, year int"
    spark.createDataFrame(rows, schema).write.partitionBy("year").parquet(path)
    files = lambda: {f for f in glob.glob(f"{path}/*/*.parquet")}
    before = files()
    changes = spark.createDataFrame([(2, "b"), (3, "c"), (5, None), (9, "z"), (None, "y")], "ID long, country string")
    assert apply_changes(spark, path, "year", "ID", changes) == 2  # 2000 and the null year
    after = files()
    kept = {f for f in before if "=2001" in f or "=2002" in f or "=2003" in f}
    assert kept == before & after and len(after - before) >= 2
    got = sorted((r.extra, r.ID, r.country, r.year) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, "a", 2000), (2, 2, "b", 2000), (3, 3, "c", 2001), (4, 3, "c", 2001), (5, 4, "d", 2002), (6, None, "e", 2003), (7, 5, None, None)]
    assert apply_changes(spark, path, "year", "ID", changes) == 0 and files() == after


def test_cells_of_a_stream_equal_the_recomputed_views(spark, scratch):
    t = driver_tables(spark, SF01)
    box, path, ckpt = (f"{scratch}/{x}" for x in ("in", "cells", "ckpt"))
    os.mkdir(box)
    whole = lambda: V.success_rate_full(spark.read.schema(t.enriched.schema).parquet(box))
    for part in range(3):
        t.enriched.where(F.pmod("ID", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(box)
        cells.start_cells(spark.readStream.schema(t.enriched.schema).parquet(box), path, ckpt).awaitTermination()
        got = V.success_rate_full_of_cells(cells.stored_cells(spark, path))
        assert got.count() == whole().count() and got.exceptAll(whole()).count() == 0
    cells.add_batch(t.enriched.where(F.pmod("ID", F.lit(3)) == 1), 1, path)  # a replayed batch
    assert V.success_rate_full_of_cells(cells.stored_cells(spark, path)).exceptAll(whole()).count() == 0
    cells.compact(spark, path, f"{scratch}/small")
    a, b = (V.success_rate_of_cells(cells.stored_cells(spark, p)) for p in (path, f"{scratch}/small"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and len(glob.glob(f"{scratch}/small/batch=*")) == 1


def test_persistent_views_are_read_by_another_session_with_pruned_scans(spark):
    db = driver_database(spark, SF01)
    other = spark.newSession()
    df = other.sql(f"SELECT main_category, avg(percentage) AS p FROM `{db}`.v_success_rate WHERE year = 1995 GROUP BY main_category")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(launch_year" in plan and "usd_goal_real" not in plan
    t = driver_tables(spark, SF01)
    want = V.success_rate(t.enriched, ordered=False)
    assert other.table(f"`{db}`.v_success_rate").exceptAll(want).count() == 0
    assert {r.viewName for r in other.sql(f"SHOW VIEWS IN `{db}`").collect()} >= {"v_success_rate", "success_rate_full", "goal_vs_pledge"}


@pytest.mark.parametrize("make", [lambda t: CL.enrich(t.project_info, t.pledge, t.country),
                                  lambda t: X.country_currency_counts(t.project_info, t.pledge, repair=True)])
def test_no_window_over_a_hot_id(spark, make):
    plan = make(driver_tables(spark, SF01))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_hot_id_is_repaired_once(spark):
    pi = spark.createDataFrame([(1, '"N'), (2, "GB")], "ID long, country string")
    pl = spark.range(30000).selectExpr("if(id < 10000, 1, 2) ID", "if(id = 77, 'AUD', 'USD') currency")
    got = {(r.country, r.currency): r.project_count for r in X.country_currency_counts(pi, pl, repair=True).collect()}
    assert got == {("AU", "AUD"): 1, ("AU", "USD"): 9999, ("GB", "USD"): 20000}
