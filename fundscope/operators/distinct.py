"""Exact distinct counts that add up: bitmaps over a dictionary, stored per cell.

A count of distinct values can't be summed over cells, a set of values can be united. Every distinct
value gets a number once (the dictionary, dense from 1), a cell (one combination of the key columns)
stores its values as bitmaps of 32768 numbers each, and any roll-up unites the bitmaps of its cells and
counts bits: the rows are not read again. New rows come in batches; a replayed batch replaces what it
wrote before.

Bounds: a cell holds one bitmap of 4 KB per 32768 numbers that it touches, whatever its rows. Equal rows
are removed before the shuffle, so a key or value with a third of all rows costs a row per task and cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import global_row_number
from ..session import checkpoint_root


def add_batch(rows: DataFrame, batch: int, path: str, keys: Sequence[str], column: str) -> None:
    """Add the values of ``column`` per cell of ``keys`` to the store at ``path`` (``foreachBatch`` of a stream).

    Batches are numbered in their order of arrival; a replayed one finds the same new values and numbers.
    NULL is no value, but its cell exists (and counts 0 if it has nothing else); NULL keys are a cell like any other.
    """
    spark, batch = rows.sparkSession, int(batch)
    if {"value", "position", "bucket", "bits", "batch"} & set(keys):
        raise ValueError("a key column has a name the store uses")
    aside = f"{checkpoint_root(spark)}/distinct-{uuid.uuid4().hex[:12]}"
    rows.select(*keys, F.col(column).alias("value")).distinct().write.parquet(aside)
    pairs = spark.read.parquet(aside)
    kind = dict(pairs.dtypes)["value"]
    values = pairs.select("value").where("value IS NOT NULL").distinct()
    last = 0
    if _exists(spark, f"{path}/dictionary"):
        known = _dictionary(spark, path, kind).where(F.col("batch") < batch)
        values = values.join(known, "value", "left_anti")
        last = known.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    (global_row_number(values, ["value"], name="position").withColumn("position", F.col("position") + F.lit(last))
     .write.mode("overwrite").parquet(f"{path}/dictionary/batch={batch}"))
    numbers = _dictionary(spark, path, kind).where(F.col("batch") <= batch).select("value", "position")
    cells = (pairs.join(numbers, "value", "left")
             .groupBy(*keys, F.bitmap_bucket_number("position").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits")))
    cells.write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")
    _delete(spark, aside)


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps of all batches: key columns, ``bucket``, ``bits`` (a cell may occur once per batch)."""
    return spark.read.parquet(f"{path}/cells").drop("batch")


def distinct_counts(cells: DataFrame, keys: Sequence[str] = (), alias: str = "distinct_count") -> DataFrame:
    """Exact number of distinct values per combination of ``keys``, any subset of the cells' keys (none: one
    row for the whole). The bitmaps of a bucket are united map-side first."""
    united = cells.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(alias))


def start_cells(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], column: str, available_now: bool = True):
    """Keep the distinct values of a stream of rows; returns the running query."""
    w = rows.writeStream.foreachBatch(lambda df, batch: add_batch(df, batch, path, keys, column)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _dictionary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"value {kind}, position long, batch long").parquet(f"{path}/dictionary")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
