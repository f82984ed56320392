"""Incremental load: delimited files arriving in a folder -> stored Parquet table.

The same read as ``sources.delimited.read_delimited`` (declared schema, no
quoting), run as a Structured Streaming file source. Each micro-batch is
transformed by a stateless DataFrame function (for project_info: the date
parsing of the load step) and appended to a Parquet table. The file sink and
the checkpoint make the load exactly-once: a restarted or re-triggered run
picks up only files it has not committed yet, and a lost executor only
re-runs its tasks.

``available_now=True`` processes everything present and stops (a scheduled
batch load); ``False`` keeps the query running with ``processing_time``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.delimited import LINE_SEP, NULL, read_lines, split_lines


def read_delimited_stream(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ",",
                          header: bool = True, null_value: str = NULL,
                          max_files_per_trigger: int | None = None, line_sep: str = LINE_SEP,
                          header_line: str | None = None) -> DataFrame:
    """Streaming read of delimited files with a declared schema and quoting off. ``header_line``: how
    the header of the files reads, by default the names of the schema."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    head = (header_line or sep.join(schema.names)) if header else None
    return read_lines(r, folder, head, line_sep).where("line <> ''").select(*split_lines(F.col("line"), schema, sep, null_value))


def start_incremental_load(spark: SparkSession, folder: str, schema: T.StructType, target: str,
                           checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                           available_now: bool = True, processing_time: str = "1 minute",
                           partition_by: str | None = None,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the load; returns the running query (``awaitTermination`` it for available-now runs).

    ``checkpoint`` must be in shared storage (e.g. below ``spark.checkpoint.dir``).
    ``max_files_per_trigger`` bounds the size of each micro-batch.
    """
    df = read_delimited_stream(spark, folder, schema, max_files_per_trigger=max_files_per_trigger)
    if transform is not None:
        df = transform(df)
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", target).option("checkpointLocation", checkpoint))
    if partition_by:
        w = w.partitionBy(partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def load_available(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                   transform: Callable[[DataFrame], DataFrame] | None = None,
                   timeout_sec: int | None = None) -> DataFrame:
    """Load every file not loaded yet, wait for it, and return the stored table.

    ``timeout_sec``: stop and raise after that time; what was committed stays and is not read again."""
    q = start_incremental_load(spark, folder, schema, target, checkpoint, transform, available_now=True)
    finished = q.awaitTermination(timeout_sec) if timeout_sec else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError(f"incremental load of {folder} did not finish in {timeout_sec} s")
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(_output_schema(spark, folder, schema, transform)).parquet(target)


def _output_schema(spark: SparkSession, folder: str, schema: T.StructType,
                   transform: Callable[[DataFrame], DataFrame] | None) -> T.StructType:
    df = spark.createDataFrame([], schema)
    return (transform(df) if transform else df).schema
