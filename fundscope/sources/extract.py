"""Extracts for a dashboard tool: results written as files, in parallel, one file per task.

CSV extracts keep every value: blanks at the ends of a text, empty texts (quoted), NULL (as ``\\N``),
separators, quotes and line breaks (quoted); ``read_extract`` reads them back the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_CSV = {"header": True, "nullValue": "\\N", "emptyValue": "", "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_extract(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Write ``df`` to ``path`` as CSV (with header) or Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.options(**_CSV | {"emptyValue": '""'}).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def read_extract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV extract with its declared schema."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)
