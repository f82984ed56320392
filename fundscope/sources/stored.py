"""Changes to stored, partitioned tables: only partitions that hold a changed row are written again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


def apply_changes(spark: SparkSession, path: str, partition_col: str, key: str, changes: DataFrame) -> int:
    """Set the columns of ``changes`` (key, new values) in the Parquet table at ``path``, partitioned by
    ``partition_col``. Returns how many partitions were written.

    A change that equals the stored row (NULL equals NULL) changes nothing, so a repeated run writes no file; keys
    without a row are ignored, and rows that repeat a key all change. ``changes`` has one row per
    key and does not touch the partition column. The new partitions are first written aside: the table is
    replaced partition by partition from finished files (dynamic overwrite).
    """
    new_values = [c for c in changes.columns if c != key]
    table = spark.read.parquet(path)
    aside = f"{checkpoint_root(spark)}/changes-{uuid.uuid4().hex[:12]}"
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in new_values], F.lit(True).alias("__hit"))
    differs = F.lit(False)
    for c in new_values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    touched = table.join(new, F.col(key) == F.col("__key")).where(differs).select(F.col(partition_col).alias("__p")).distinct()
    touched.write.parquet(f"{aside}/partitions")
    touched = spark.read.parquet(f"{aside}/partitions")
    count = touched.count()
    if count:
        rows = table.join(touched, F.col(partition_col).eqNullSafe(F.col("__p")), "left_semi")
        told = rows.join(new, F.col(key) == F.col("__key"), "left")
        fixed = told.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
                              for c in table.columns])
        fixed.write.parquet(f"{aside}/rows")
        (spark.read.schema(table.schema).parquet(f"{aside}/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition_col).parquet(path))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return count
