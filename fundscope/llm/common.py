"""Shared helpers: input tables, stored intermediate tables, byte and word conventions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundscope.session import checkpoint_root

#: One word: a run of characters other than blank, tab and the four line separators of ASCII.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, zstd: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, so lost
    executors recompute from files, and gives the planner the real size of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd" if zstd else "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote, through the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that operators of this package stored for results of this session's
    shared folder. Results that were not written elsewhere can't be read any more."""
    remove(spark, f"{checkpoint_root(spark)}/llm")


def set_aside(df: DataFrame, names: tuple[str, ...]):
    """Rename the columns of ``df`` that an operator's own result columns would replace. Returns the
    renamed frame and a function that picks the original columns, by their names, from a result."""
    own = {c: f"__in_{c}" for c in df.columns if c in names}
    renamed = df.select(*[F.col(c).alias(own.get(c, c)) for c in df.columns])
    return renamed, lambda out: out.select(*[F.col(own.get(c, c)).alias(c) for c in df.columns])


def row_name(id_col: str, text_col: str):
    """16 bytes that name a row by its id and text; a null differs from every value."""
    told = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(told[0], F.lit("\x01"), told[1]).cast("binary")))


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(col):
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
