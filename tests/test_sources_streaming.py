"""Delimited load/write, extracts, and the incremental (streaming) load."""

import glob
import os

from pyspark.sql import functions as F

from conftest import SF01
from fundscope.operators import cleaning as CL
from fundscope.operators import views as V
from fundscope.plans.workload import driver_files, driver_tables, load_files
from fundscope.schemas import PLEDGE_RAW
from fundscope.sources.delimited import read_delimited, read_pledge, read_project_info, unreadable_numbers, write_delimited
from fundscope.sources.extract import read_extract, write_extract
from fundscope.sources.fixtures import RAW_PROJECT_INFO_FILE
from fundscope.streaming.incremental import load_available


def test_delimited_round_trip_keeps_raw_text(spark):
    t = driver_tables(spark, SF01)
    files = driver_files(spark, SF01)
    back = read_project_info(spark, files["project_info"], schema=RAW_PROJECT_INFO_FILE)
    assert back.exceptAll(t.raw_project_info).count() == 0
    assert back.where(F.col("country") == '"N').count() > 0
    first = sorted(glob.glob(files["project_info"] + "/*.csv"))[0]
    with open(first, newline="") as f:
        head = f.read(200)
    assert head.startswith("ID,main_category,category,launched,deadline,country\r\n")


def test_incremental_load_is_exactly_once(spark, scratch):
    t = driver_tables(spark, SF01)
    raw = t.raw_project_info
    inbox, target, ckpt = (os.path.join(scratch, x) for x in ("inbox", "table", "checkpoint"))
    write_delimited(raw.where(F.col("ID") % 2 == 0), os.path.join(inbox, "batch1"))
    # the file source reads the files of one folder; move batch parts into the inbox root
    for f in glob.glob(os.path.join(inbox, "batch1", "*.csv")):
        os.rename(f, os.path.join(inbox, "b1-" + os.path.basename(f)))
    out = load_available(spark, inbox, RAW_PROJECT_INFO_FILE, target, ckpt, transform=CL.load_project_info)
    n1 = out.count()
    assert n1 == raw.where(F.col("ID") % 2 == 0).count()
    # second arrival; a re-run loads only the new files
    write_delimited(raw.where((F.col("ID") % 2 == 1) | F.col("ID").isNull()), os.path.join(inbox, "batch2"))
    for f in glob.glob(os.path.join(inbox, "batch2", "*.csv")):
        os.rename(f, os.path.join(inbox, "b2-" + os.path.basename(f)))
    out = load_available(spark, inbox, RAW_PROJECT_INFO_FILE, target, ckpt, transform=CL.load_project_info)
    assert out.count() == raw.count()
    out = load_available(spark, inbox, RAW_PROJECT_INFO_FILE, target, ckpt, transform=CL.load_project_info)
    assert out.count() == raw.count()                       # nothing loaded twice
    assert out.exceptAll(t.project_info).count() == 0
    assert dict(out.dtypes)["launched"] == "timestamp_ntz"


def test_write_extract(spark, scratch):
    t = driver_tables(spark, SF01)
    rates = V.success_rate(t.enriched, ordered=False)
    p1 = os.path.join(scratch, "rates_csv")
    write_extract(rates, p1, "csv")
    assert read_extract(spark, p1, rates.schema).exceptAll(rates).count() == 0
    p3 = os.path.join(scratch, "full_parquet")
    write_extract(V.success_rate_full(t.enriched), p3, "parquet", partition_by="year")
    assert spark.read.parquet(p3).count() == V.success_rate_full(t.enriched).count()


def test_extract_keeps_every_text(spark, scratch):
    texts = [" x ", "", None, "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", "\\", "\\N x", '"', "tab\t", "é😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, t string")
    write_extract(df, os.path.join(scratch, "texts"), "csv")
    back = {r.ID: r.t for r in read_extract(spark, os.path.join(scratch, "texts"), df.schema).collect()}
    assert back == dict(enumerate(texts))


def test_raw_layout_is_unquoted_and_keeps_blanks_and_empties(spark, scratch):
    texts = [" x ", "", None, '"N', 'a "b" c', "#c", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, t string")
    path = os.path.join(scratch, "raw")
    write_delimited(df.coalesce(1), path)
    with open(glob.glob(path + "/*.csv")[0], "rb") as f:
        raw = f.read()
    assert raw == ("ID,t\r\n" + "".join(f"{i},{chr(92) + 'N' if t is None else t}\r\n" for i, t in enumerate(texts))).encode()
    back = {r.ID: r.t for r in read_delimited(spark, path, df.schema).collect()}
    assert back == dict(enumerate(texts))
    write_delimited(spark.createDataFrame([(1, "a,b")], df.schema), path)  # the layout can't hide a separator
    assert read_delimited(spark, path, df.schema).first().t == "a"


def test_bad_numbers_are_null_and_counted(spark, scratch):
    p = os.path.join(scratch, "pledge.csv")
    with open(p, "w", newline="") as f:
        f.write("ID,state,currency,usd_goal_real,usd_pledged_real\r\n1,live,GBP,bad,1.5\r\nxx,live,GBP,1,\\N\r\n3,,GBP,,0.0001\r\n")
    rows = read_pledge(spark, p).collect()
    assert [(r.ID, r.state, r.usd_goal_real) for r in rows] == [(1, "live", None), (None, "live", 1), (3, "", None)]
    assert tuple(unreadable_numbers(spark, p, PLEDGE_RAW).first()) == (1, 2, 0)


def test_two_loads_leave_one_copy(spark):
    import __spark_entry__ as E

    t = driver_tables(spark, SF01)
    for name in ("extract_success_rate_full", "stream_load_project_info"):
        n = {E.queries()[name](spark, SF01).count() for _ in range(2)}
        assert len(n) == 1
    assert len(glob.glob(f"{t.root}/extracts/*")) == 1 and len(glob.glob(f"{t.root}/stream*")) == 1


def test_load_files_reproduces_the_workload(spark):
    t = driver_tables(spark, SF01)
    files = driver_files(spark, SF01)
    w = load_files(spark, files["project_info"], files["pledge"], t.country,
                   project_info_schema=RAW_PROJECT_INFO_FILE)
    assert w.enriched.exceptAll(t.enriched).count() == 0 and w.enriched.count() == t.enriched.count()
    assert w.project_info.exceptAll(t.project_info).count() == 0
    current = spark.catalog.currentDatabase()
    plain = load_files(spark, files["project_info"], files["pledge"], t.country,
                       project_info_schema=RAW_PROJECT_INFO_FILE, bucketed=False)
    in_db = load_files(spark, files["project_info"], files["pledge"], t.country,
                       project_info_schema=RAW_PROJECT_INFO_FILE, database="fundscope_test_db")
    assert spark.catalog.currentDatabase() == "fundscope_test_db"
    assert any(tb.name.endswith("_pledge") for tb in spark.catalog.listTables("fundscope_test_db"))
    assert in_db.enriched.exceptAll(t.enriched).count() == 0
    spark.catalog.setCurrentDatabase(current)
    assert plain.enriched.exceptAll(t.enriched).count() == 0 and plain.enriched.count() == t.enriched.count()
