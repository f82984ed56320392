"""Row counts, minima and maxima answered from Parquet file statistics.

Spark's v2 Parquet reader answers ``count``, ``min`` and ``max`` from the footers (``PushedAggregation`` in
the plan), so no row group is read. It does so for whole numbers and dates only, and it stops at a row group
that holds nothing but NULL. ``write_with_bounds`` therefore stores two BIGINT companions of each bounded
column: its value as a whole number, with the largest BIGINT (for the minimum) or the smallest (for the
maximum) in place of NULL. ``file_bounds`` aggregates the companions and turns them back. A companion costs
8 bytes a row before encoding. A column without any value has NULL bounds and count 0, as has an empty table.
Text columns have no exact statistics (footers cut long texts): parse them first, they are refused here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW, _HIGH = "__low_", "__high_"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_DAY_US = 86_400_000_000


def _whole(name: str, t: T.DataType) -> Column:
    """The value as BIGINT, in the order of the values and independent of the session time zone."""
    c = F.col(name)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(t, T.DecimalType) and t.precision <= 18:
        return (c * F.lit(10 ** t.scale)).cast("long")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(t, T.TimestampNTZType):
        seconds = F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
        return (F.unix_date(c.cast("date")).cast("long") * F.lit(_DAY_US) + seconds.cast("long") * F.lit(1_000_000)
                + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long"))
    raise ValueError(f"no file statistics for column {name} of type {t.simpleString()}")


def _value(c: Column, t: T.DataType) -> Column:
    """What ``_whole`` was made from."""
    if isinstance(t, T.DecimalType):
        return (c.cast("decimal(20,0)") / F.lit(10 ** t.scale).cast("decimal(19,0)")).cast(t)
    if isinstance(t, T.DateType):
        return F.date_from_unix_date(c.cast("int"))
    if isinstance(t, T.TimestampNTZType):
        seconds = (c.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return c.cast(t)


def write_with_bounds(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Write ``df`` as Parquet with the companions of ``columns``, in the one pass of the write."""
    out = [F.col(c) for c in df.columns]
    for name in columns:
        whole = _whole(name, df.schema[name].dataType)
        out += [F.coalesce(whole, F.lit(_MOST)).alias(_LOW + name), F.coalesce(whole, F.lit(_LEAST)).alias(_HIGH + name)]
    df.select(*out).write.mode(mode).parquet(path)


def read_with_bounds(spark: SparkSession, path: str) -> DataFrame:
    """The table without its companions."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if not c.startswith((_LOW, _HIGH))])


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet reader is the v2 one with aggregate push-down; the
    caller's settings stay as they are."""
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def file_bounds(spark: SparkSession, path: str, columns: list[str] = ()) -> DataFrame:
    """One row from the footers of ``path``: ``row_count`` and, per column, ``count_<c>`` (values that are not
    NULL), ``min_<c>`` and ``max_<c>`` in the column's own type. ``spark`` is a ``footer_session``."""
    df = spark.read.parquet(path)
    found = df.agg(F.count(F.lit(1)).alias("row_count"),
                   *[a for c in columns for a in (F.count(c).alias(f"count_{c}"), F.min(_LOW + c).alias(f"min_{c}"),
                                                  F.max(_HIGH + c).alias(f"max_{c}"))])
    def count(name: str) -> Column:
        # the pushed count of files without a row group is NULL
        return F.when(F.col(name) > 0, F.col(name)).otherwise(F.lit(0).cast("long")).alias(name)

    out = [count("row_count")]
    for c in columns:
        some, t = F.col(f"count_{c}") > 0, df.schema[c].dataType
        out += [count(f"count_{c}"), *[_value(F.when(some, F.col(f"{b}_{c}")), t).alias(f"{b}_{c}") for b in ("min", "max")]]
    return found.select(*out)
