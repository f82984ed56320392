"""The country lookup (code -> display name).

The lookup is a parameter: a delimited file or Parquet table with the columns
``countrycode, countryname, code`` (the public ISO 3166 list: alpha-3 key,
English short name, alpha-2 join code), or any DataFrame with them. It is a
small dimension: every join to it goes through ``plans.joins.lookup_join``,
which broadcasts it only after checking its row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .delimited import read_delimited


def country_dim(spark: SparkSession, source: str | DataFrame, fmt: str | None = None) -> DataFrame:
    """Load the lookup from a path (``fmt`` 'csv' with a header line, or 'parquet';
    guessed from the extension) or take a DataFrame; returns the declared schema."""
    if isinstance(source, DataFrame):
        df = source
    else:
        fmt = fmt or ("parquet" if source.rstrip("/").endswith(".parquet") else "csv")
        if fmt == "parquet":
            df = spark.read.parquet(source)
        else:
            # the lookup is a clean file: quoted names (with commas) are allowed here
            df = read_delimited(spark, source, schemas.COUNTRY, quoting=True)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.COUNTRY.fields])


def save_country_dim(df: DataFrame, path: str) -> None:
    """Store the lookup as Parquet (the ``CREATE TABLE IF NOT EXISTS`` step: kept when present)."""
    df.write.mode("ignore").parquet(path)
