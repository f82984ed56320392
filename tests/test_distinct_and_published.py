"""Distinct counts rolled up from bitmaps, and extracts published by changed cell."""

import glob
import os

from pyspark.sql import functions as F

from fundscope.operators import distinct as D
from fundscope.sources.published import latest_version, publish, read_published, row_changes

SCHEMA = "year int, code string, name string"


def _brute(rows, keys):
    at = {"year": 0, "code": 1}
    out = {}
    for r in rows:
        held = out.setdefault(tuple(r[at[k]] for k in keys), set())
        if r[2] is not None:
            held.add(r[2])
    return {k: len(v) for k, v in out.items()}


def test_distinct_counts_roll_up_like_recounting(spark, scratch):
    path, keys = f"{scratch}/d", ["year", "code"]
    batches = [[(2000, "a", "x"), (2000, "b", "x"), (2001, "a", None), (None, "a", "y"), (2000, "a", "x")],
               [],
               [(2001, "a", "z"), (2001, None, "x"), (2002, "c", None), (2002, "c", ""), (2000, "b", "y")]]
    for i in (0, 1, 2, 0, 2):  # two batches are delivered again
        D.add_batch(spark.createDataFrame(batches[i], SCHEMA), i, path, keys, "name")
    rows = [r for b in batches for r in b]
    cells = D.stored_cells(spark, path)
    for some in (["year", "code"], ["code"], ["year"], []):
        got = {tuple(r)[:-1]: r.distinct_count for r in D.distinct_counts(cells, some).collect()}
        assert got == (_brute(rows, some) if rows else {})
    numbers = spark.read.parquet(f"{path}/dictionary").select("position").collect()
    assert sorted(r.position for r in numbers) == [1, 2, 3, 4]  # '', x, y, z: dense, none twice


def test_distinct_counts_over_several_bitmaps_and_an_empty_store(spark, scratch):
    rows = spark.range(70000).select((F.col("id") % 3).cast("int").alias("year"), F.lit("a").alias("code"),
                                     (F.col("id") % 50000).alias("name"))
    D.add_batch(rows, 0, f"{scratch}/d", ["year"], "name")
    cells = D.stored_cells(spark, f"{scratch}/d")
    assert D.distinct_counts(cells).first()[0] == 50000
    want = {r.year: r.n for r in rows.groupBy("year").agg(F.count_distinct("name").alias("n")).collect()}
    assert {r.year: r.distinct_count for r in D.distinct_counts(cells, ["year"]).collect()} == want
    D.add_batch(rows.limit(0), 0, f"{scratch}/e", ["year"], "name")
    assert D.distinct_counts(D.stored_cells(spark, f"{scratch}/e")).first()[0] == 0


def test_roll_up_reads_the_cells_only_and_unites_before_the_shuffle(spark, scratch):
    D.add_batch(spark.createDataFrame([(1, "a", "x")], SCHEMA), 0, f"{scratch}/d", ["year", "code"], "name")
    plan = D.distinct_counts(D.stored_cells(spark, f"{scratch}/d"), ["year"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_or_agg" in plan and "/dictionary" not in plan and "code" not in plan.split("ReadSchema:")[1]


def test_stream_keeps_distinct_cells(spark, scratch):
    box = f"{scratch}/in"
    for part in range(2):
        spark.createDataFrame([(2000, "a", f"n{part}"), (2000, "b", "n0")], SCHEMA).coalesce(1).write.mode("append").parquet(box)
        D.start_cells(spark.readStream.schema(SCHEMA).parquet(box), f"{scratch}/d", f"{scratch}/c", ["year", "code"], "name").awaitTermination()
    got = {r.code: r.distinct_count for r in D.distinct_counts(D.stored_cells(spark, f"{scratch}/d"), ["code"]).collect()}
    assert got == {"a": 2, "b": 1}


def _files(path):
    return set(glob.glob(f"{path}/data/*/*/*.parquet"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_publish_writes_changed_cells_only(spark, scratch):
    path, schema = f"{scratch}/x", "country string, year int, rate double"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [("a", 1, 0.5), ("a", 2, None), ("b", 1, 1.0), (None, 1, 2.0), ("", 1, 3.0), ("gone", 1, 4.0), ("b", 1, 1.0)]
    one = frame(first)
    assert publish(one, path, ["country"]) == 5
    before = _files(path)
    assert publish(one, path, ["country"]) == 0 and _files(path) == before and latest_version(spark, path) == 1
    held = read_published(spark, path, one.schema)  # a reader that started before the next publication
    second = [("a", 1, 0.5), ("a", 2, 7.0), ("b", 1, 1.0), ("b", 1, 1.0), (None, 1, 2.0), ("", 1, 3.0), ("new", 1, 5.0)]
    assert publish(frame(second), path, ["country"]) == 2
    assert before <= _files(path) and len(_files(path) - before) == 2  # cells a and new
    assert _rows(held) == _rows(one) and _rows(read_published(spark, path, one.schema)) == _rows(frame(second))
    assert _rows(read_published(spark, path, one.schema, version=1)) == _rows(one)
    # a cell that only went away is a publication too; one that came back unchanged is written again
    assert publish(frame(second[:-1]), path, ["country"]) == 0 and latest_version(spark, path) == 3
    assert _rows(read_published(spark, path, one.schema)) == _rows(frame(second[:-1]))


def test_an_unfinished_publication_is_not_read(spark, scratch):
    path = f"{scratch}/x"
    df = spark.createDataFrame([("a", 1)], "country string, n int")
    publish(df, path, ["country"])
    os.makedirs(f"{path}/manifest/version=2/_temporary")
    os.makedirs(f"{path}/data/__version=2/__cell=0")
    assert latest_version(spark, path) == 1 and _rows(read_published(spark, path, df.schema)) == [("a", 1)]
    more = spark.createDataFrame([("a", 2)], "country string, n int")
    assert publish(more, path, ["country"]) == 1 and _rows(read_published(spark, path, df.schema)) == [("a", 2)]
    empty = df.limit(0)
    assert publish(empty, f"{scratch}/e", ["country"]) == 0 and read_published(spark, f"{scratch}/e", df.schema).count() == 0


def test_row_changes_of_nulls_repeats_and_moved_values(spark):
    schema = "k string, a string, b string"
    old = spark.createDataFrame([("1", "x", None), ("2", "y", "z"), (None, "n", "n"), ("r", "1", "2"), ("r", "1", "2"), ("s", "1", "2"), ("s", "3", "4")], schema)
    new = spark.createDataFrame([("1", None, "x"), ("2", "y", "z"), (None, "n", None), ("r", "1", "2"), ("s", "3", "4"), ("s", "1", "2"), ("5", "", "")], schema)
    got = {r.k: r.change for r in row_changes(old, new, ["k"]).collect()}
    assert got == {"1": "changed", None: "changed", "r": "changed", "5": "added"}
    assert {r.k: r.change for r in row_changes(new, old, ["k"]).collect()}["5"] == "removed"
    assert row_changes(old, old, ["k"]).count() == 0
