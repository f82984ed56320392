"""Extracts that are published again and again: only cells whose rows changed are written, and a reader
sees one publication whole.

A cell is one combination of the cell columns. Layout below ``path``: ``data/__version=N/__cell=<digest>``
holds the rows of the cells that publication N wrote, ``manifest/version=N`` one row per cell of
publication N with the version that holds its rows, the number of its rows and their digest. A
publication counts once its manifest has its success marker, which is one file created at the very
end; until then readers use the manifest before it, whose data is never changed. One publisher at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "cell string, rows long, low decimal(38,0), high decimal(38,0), version long"
_OWN = ("__cell", "__version")


def _row_digests(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit digests of a row; NULL and its place count."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return tuple(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") for seed in (1, 2))


def row_changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between two extracts: ``key`` columns and ``change`` (``added``, ``removed``,
    ``changed``). Both sides are added up per key in one aggregation, so NULL keys are keys, and a repeated
    key compares the rows it has on each side, in any order. Columns are those of ``old``."""
    low, high = _row_digests(old.columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*key, F.lit(sign).alias("__n"), (low * F.lit(sign)).alias("__low"), (high * F.lit(sign)).alias("__high"))

    both = side(old, -1).unionByName(side(new, 1))
    per_key = both.groupBy(*key).agg(F.count_if(F.col("__n") < 0).alias("__old"), F.count_if(F.col("__n") > 0).alias("__new"),
                                     F.sum("__low").alias("__low"), F.sum("__high").alias("__high"))
    change = (F.when(F.col("__old") == 0, "added").when(F.col("__new") == 0, "removed")
              .when((F.col("__old") != F.col("__new")) | (F.col("__low") != 0) | (F.col("__high") != 0), "changed"))
    return per_key.select(*key, change.alias("change")).where("change IS NOT NULL")


def publish(df: DataFrame, path: str, cell_columns: Sequence[str]) -> int:
    """Publish ``df`` at ``path``; returns how many cells were written. Rows of unchanged cells stay in the files
    they are in, cells without rows leave the manifest, and a publication equal to the last one writes
    nothing. ``df`` is read twice (digests, then the changed cells only), so it must be repeatable, as a
    stored table is. A folder is written per changed cell: choose columns with a moderate number of values."""
    if set(_OWN) & set(df.columns):
        raise ValueError(f"columns {_OWN} are used by the extract")
    spark, (low, high) = df.sparkSession, _row_digests(df.columns)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in cell_columns]
    rows = df.withColumn("__cell", F.md5(F.concat_ws("\u0001", *parts)))
    now = rows.groupBy(F.col("__cell").alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(low).cast("decimal(38,0)").alias("low"), F.sum(high).cast("decimal(38,0)").alias("high"))
    last = latest_version(spark, path)
    version = (last or 0) + 1
    before = spark.createDataFrame([], _MANIFEST) if last is None else _manifest(spark, path, last)
    draft_path = f"{path}/manifest-draft"
    # a cell keeps its version if count and digests are those of the last publication
    (now.join(before.withColumnRenamed("version", "kept"), ["cell", "rows", "low", "high"], "left")
     .withColumn("version", F.coalesce("kept", F.lit(version).cast("long"))).drop("kept")
     .write.mode("overwrite").parquet(draft_path))
    draft = spark.read.schema(_MANIFEST).parquet(draft_path)
    changed = draft.where(F.col("version") == version).select(F.col("cell").alias("__cell"))
    count = changed.count()
    if last is not None and count == 0 and draft.count() == before.count():
        return 0
    (rows.join(changed, "__cell", "left_semi").hint("rebalance", "__cell")
     .write.mode("overwrite").partitionBy("__cell").parquet(f"{path}/data/__version={version}"))
    draft.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return count


def read_published(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of one publication (default: the latest complete one). Which files belong to it is settled
    by its manifest, so a publication that runs meanwhile is not seen."""
    manifest = _manifest(spark, path, version or latest_version(spark, path))
    whole = T.StructType([*schema.fields, T.StructField("__cell", T.StringType()), T.StructField("__version", T.LongType())])
    data = spark.read.schema(whole).parquet(f"{path}/data")
    held = manifest.select(F.col("cell").alias("__cell"), F.col("version").alias("__version"))
    return data.join(held, ["__cell", "__version"], "left_semi").select(*[F.col(f"`{c}`") for c in schema.names])


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the latest publication whose manifest is complete."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(folder)
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}")
