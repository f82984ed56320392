"""The success-rate cells, kept up to date as cleaned rows arrive.

Cell counts (country code, shown country, year, main category, merged state) add up, so each micro-batch
writes only its own counts, into the folder of its batch number: a batch that is replayed replaces
what it wrote before, and the views are computed from the sums, never from the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

CELL_SCHEMA = "country_code string, country string, launch_year int, main_category string, state_merged string, n long"
_KEYS = ["country_code", "country", "launch_year", "main_category", "state_merged"]


def cell_counts(enriched: DataFrame) -> DataFrame:
    """Rows per cell and merged state, 'other' left out."""
    return enriched.where(F.col("state_merged") != F.lit(C.OTHER)).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))


def add_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Store the cells of one batch of enriched rows (``foreachBatch`` of a stream); idempotent per batch."""
    cell_counts(rows).write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches, added up."""
    cells = spark.read.schema(CELL_SCHEMA + ", batch long").parquet(path)
    return cells.groupBy(*_KEYS).agg(F.sum("n").alias("n"))


def start_cells(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Keep the cells of a stream of enriched rows; returns the running query."""
    w = rows.writeStream.foreachBatch(lambda df, batch: add_batch(df, batch, path)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The cells of all batches as one batch below ``target``, for a store of many small ones; the stream
    goes on with new batch numbers there."""
    last = spark.read.schema(CELL_SCHEMA + ", batch long").parquet(path).agg(F.max("batch")).first()[0]
    stored_cells(spark, path).write.mode("overwrite").parquet(f"{target}/batch={last}")
